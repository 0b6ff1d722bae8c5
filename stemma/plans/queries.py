"""Queries over the driver tables, one or more per operator of the engine, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import places as country
from stemma.functions import text as tx
from stemma.functions.dates import date_similarity, with_dates, with_normalized_dates, year_of
from stemma.operators import blocking, graph, relations
from stemma.operators.snapshot_diff import snapshot_changes, transitions
from stemma.plans import sqlgate
from stemma.tables import settle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- snapshots

_N = r"lower(nfc_normalize(regexp_replace(coalesce({}, ''), '\s+', '', 'g')))"


@query(
    f"""
with force as (select distinct tree_id, generation, unnest(map_entries(active_snapshots)) e from sync_manifests),
g as (select tree_id, generation, e.key source_id, e.value sid from force),
st as (select distinct prev, sid from (select *, lag(sid) over (partition by tree_id, source_id order by generation) prev from g) where prev <> sid),
r as (select distinct snapshot_id, uid, kind, {_N.format("label")} l, {_N.format("event_date")} dd, {_N.format("event_place")} p,
  list_sort(list_filter(list_transform(coalesce(attributes, []), lambda x: {_N.format("x")}), lambda x: x <> '')) a from snapshot_records),
o as (select st.prev, st.sid, r.* from st join r on r.snapshot_id = st.prev), w as (select st.prev, st.sid, r.* from st join r on r.snapshot_id = st.sid)
select coalesce(o.prev, w.prev) prev_snapshot_id, coalesce(o.sid, w.sid) snapshot_id, coalesce(o.uid, w.uid) uid,
  case when o.uid is null then 'created' when w.uid is null then 'removed' else 'updated' end change_kind
from o full join w on o.prev = w.prev and o.sid = w.sid and o.uid = w.uid
where o.uid is null or w.uid is null or (o.kind, o.l, o.dd, o.p, o.a) is distinct from (w.kind, w.l, w.dd, w.p, w.a)"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshot_changes(table(spark, d, "snapshot_records"), transitions(table(spark, d, "sync_manifests")))
    return changes.select("prev_snapshot_id", "snapshot_id", "uid", "change_kind")


@query("""
with f as (select distinct tree_id, generation, unnest(map_entries(active_snapshots)) e from sync_manifests),
g as (select tree_id, generation, e.key source_id, e.value sid from f)
select tree_id, source_id, cast(generation as bigint) generation, prev prev_snapshot_id, sid snapshot_id
from (select *, lag(sid) over (partition by tree_id, source_id order by generation) prev from g) where prev <> sid""")
def snapshot_transitions(spark: SparkSession, d: str) -> DataFrame:
    return transitions(table(spark, d, "sync_manifests")).withColumn("generation", F.col("generation").cast("long"))


@query("""
with l as (select distinct snapshot_id from snapshots), f as (select distinct unnest(map_values(active_snapshots)) snapshot_id from sync_manifests)
select snapshot_id from l where snapshot_id not in (select snapshot_id from f)""")
def never_in_force(spark: SparkSession, d: str) -> DataFrame:
    force = table(spark, d, "sync_manifests").select(F.explode(F.map_values("active_snapshots")).alias("snapshot_id"))
    return relations.missing(table(spark, d, "snapshots").select("snapshot_id").distinct(), force, ["snapshot_id"])


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Refs of the records, and refs of the merged identities: two states of one set."""
    old = table(spark, d, "individuals").select("source_ref").where("source_ref is not null")
    return old, table(spark, d, "identities").select(F.explode("source_refs").alias("source_ref")).where("source_ref is not null")


@query("select distinct unnest(source_refs) source_ref from identities except select source_ref from individuals")
def snapshot_diff_add(spark: SparkSession, d: str) -> DataFrame:
    return relations.slices_diff(*_refs(spark, d), ["source_ref"])[0]


@query("select source_ref from individuals where source_ref is not null except select unnest(source_refs) from identities")
def snapshot_diff_del(spark: SparkSession, d: str) -> DataFrame:
    return relations.slices_diff(*_refs(spark, d), ["source_ref"])[1]


@query("""
select o_orderkey, o_orderstatus from orders where o_orderstatus not in (select 'P') or o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def tombstone_apply(spark: SparkSession, d: str) -> DataFrame:
    """Orders without those in progress that have a returned item."""
    o, dead = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.where("o_orderstatus != 'P'").unionByName(relations.missing(o.where("o_orderstatus = 'P'"), dead, ["o_orderkey"]))


@query("""
with b as (select p_brand person, sha256(p_name || chr(10) || p_type) hash, p_size from part),
x as (select person, hash, cast(1 as bigint) g from b where p_size <= 30 union all
 select person, hash, cast(2 as bigint) g from b where p_size >= 20 and hash not in (select sha256(p_name || chr(10) || p_type) from part where p_size = 50))
select person, hash, min(g) first_generation, max(g) last_generation, count(*) observations from x group by all""")
def block_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("person"), F.sha2(F.concat_ws("\n", "p_name", "p_type"), 256).alias("hash"), "p_size")
    state = p.where("p_size <= 30").withColumn("generation", F.lit(1).cast("long"))
    incoming = p.where("p_size >= 20").withColumn("generation", F.lit(2).cast("long"))
    return relations.reconcile_blocks(state, incoming, p.where("p_size = 50").select("hash"))


# ---------------------------------------------------------------- blocking


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Parts as people of two sources, with three keys each."""
    keys = F.array(
        F.concat_ws("|", F.lit("name"), "p_name"), F.concat_ws("|", F.lit("brand-size"), "p_brand", "p_size"), F.concat_ws("|", F.lit("type-size"), "p_type", "p_size")
    )
    return table(spark, d, "part").withColumn("source", (F.col("p_partkey") % 2).cast("int")).withColumn("keys", keys)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return blocking.explode_keys(_people(spark, d), F.col("keys"), "p_partkey", "source", "p_retailprice")


_KEYED = """k as (select p_partkey, cast(p_partkey % 2 as int) source, p_retailprice, unnest(['name|' || p_name, 'brand-size|' || p_brand || '|' || p_size, 'type-size|' || p_type || '|' || p_size]) key from part)"""
_PAIRS = f"""{_KEYED}, e as (select key, count(*) n from k group by 1 having count(*) between 2 and 128),
c as (select a.p_partkey l, b.p_partkey r, e.n, a.key, abs(a.p_retailprice - b.p_retailprice) gap from k a join k b on a.key = b.key and a.p_partkey < b.p_partkey and a.source <> b.source join e on e.key = a.key),
o as (select l, r, key, n from (select *, row_number() over (partition by l, r order by n, key) i from c) where i = 1)"""


@query(f"with {_KEYED} select key, count(*) n from k group by 1")
def blocking_key_freq(spark: SparkSession, d: str) -> DataFrame:
    return blocking.key_frequencies(_keyed(spark, d))


@query(f"with {_KEYED} select key, count(*) n from k group by 1 having count(*) between 2 and 128")
def bounded_buckets(spark: SparkSession, d: str) -> DataFrame:
    return blocking.bounded_buckets(_keyed(spark, d))


@query(f"""
with {_KEYED}, f as (select key, count(*) n from k group by 1), e as (select * from k where key in (select key from f where n between 2 and 128)),
p as (select key, source, count(*) c from e group by all), q as (select key, sum(c) n, sum(c * (c - 1) / 2) w from p group by 1),
r as (select cast(coalesce(sum(n * (n - 1) / 2 - w), 0) as bigint) raw_pairs from q), t as (select count(*) people, count(distinct p_partkey % 2) sources from part),
u as (select count(*) keys, count(*) filter (n between 2 and 128) eligible_keys, max(n) largest_bucket from f)
select *, least(raw_pairs, people * 16, 50000) scored_bound, least(raw_pairs, people * 16, 50000, 250) adjudication_bound from t, u, r""")
def dup_plan_estimate(spark: SparkSession, d: str) -> DataFrame:
    return blocking.plan_estimate(_people(spark, d), _keyed(spark, d), "source")


@query(f"with {_PAIRS} select l, r, key, n from o")
def candidate_pairs_owner_key(spark: SparkSession, d: str) -> DataFrame:
    return blocking.owner_pairs(_keyed(spark, d), "p_partkey", "source")


@query(None)
def candidate_pairs_capped(spark: SparkSession, d: str) -> DataFrame:
    """The greedy caps depend on order; tested against a plain loop."""
    return blocking.capped_pairs(blocking.owner_pairs(_keyed(spark, d), "p_partkey", "source"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Weighted evidence: type .5, brand .3, size .2, over owner pairs."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    pairs = blocking.owner_pairs(_keyed(spark, d), "p_partkey", "source")
    a = p.select(F.col("p_partkey").alias("l"), F.struct("p_type", "p_brand", "p_size").alias("a"))
    b = p.select(F.col("p_partkey").alias("r"), F.struct("p_type", "p_brand", "p_size").alias("b"))
    parts = [("p_type", 50), ("p_brand", 30), ("p_size", 20)]
    score = sum((F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), w).otherwise(0) for c, w in parts), F.lit(0))
    return pairs.join(a, "l").join(b, "r").select("l", "r", score.cast("long").alias("score"))


_SCORE = "cast(case when a.p_type = b.p_type then 50 else 0 end + case when a.p_brand = b.p_brand then 30 else 0 end + case when a.p_size = b.p_size then 20 else 0 end as bigint) score"


@query(f"with {_PAIRS} select l, r, {_SCORE} from o join part a on a.p_partkey = l join part b on b.p_partkey = r")
def weighted_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query(f"with {_PAIRS} select l, r, {_SCORE} from o join part a on a.p_partkey = l join part b on b.p_partkey = r order by score desc, l, r limit 5000")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocking.top_candidates(_scored(spark, d), 5000)


# ---------------------------------------------------------------- scalars


@query("""
select p_partkey, trim(list_aggregate(string_split(p_name, ' ')[1:-2], 'string_agg', ' ')) given, string_split(p_name, ' ')[-1] surname from part""")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("n", tx.name_split(F.col("p_name"))).select("p_partkey", "n.given", "n.surname")


@query("select c_custkey, substr(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 1, 12) key from customer")
def key_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tx.key_text(F.col("c_name"), 12).alias("key"))


@query(f"""
select individual_id, {country.country_sql("trim(string_split(birth_place, ',')[-1])")} country from individuals where birth_place is not null""")
def country_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "individuals").where("birth_place is not null")
    return p.select("individual_id", country.country(F.trim(F.element_at(F.split("birth_place", ","), -1))).alias("country"))


@query(r"select individual_id, cast(nullif(regexp_extract(coalesce(birth_date, ''), '\b(\d{4})\b', 1), '') as int) birth_year from individuals")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "individuals").select("individual_id", year_of(F.col("birth_date")).alias("birth_year"))


@query("""
select o_orderkey, l_linenumber, l_partkey, l_quantity, cast(case when o_orderdate = l_shipdate then 100 when year(o_orderdate) = year(l_shipdate) then 90
 when abs(year(o_orderdate) - year(l_shipdate)) <= 5 then 100 - 20 * abs(year(o_orderdate) - year(l_shipdate)) else 0 end as int) score
from orders join lineitem on o_orderkey = l_orderkey""")
def date_bounds_similarity(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.year("o_orderdate"), F.year("l_shipdate")
    return j.select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity", date_similarity(a, a, b, b, F.col("o_orderdate") == F.col("l_shipdate")).cast("int").alias("score"))


@query(None)
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Typed dates of every person in parts; forms are tested one by one."""
    return with_dates(table(spark, d, "individuals").select("individual_id", "birth_date"), {"birth_date": "d"}).select("individual_id", "d.*")


@query(None)
def ocr_normalize(spark: SparkSession, d: str) -> DataFrame:
    from stemma.functions.ocr import normalize_ocr

    return table(spark, d, "documents").select("doc_id", normalize_ocr("text").alias("text"))


@query(None)
def utf8_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Documents as wrapped note lines of at most 255 bytes; joining them again is tested."""
    from stemma.sources.gedcom_writer import wrap_notes

    return wrap_notes(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


# ---------------------------------------------------------------- graph

_GRAPH = "e as (select distinct 'o' || l_orderkey a, 's' || l_suppkey b from lineitem)"


def _bipartite(spark: SparkSession, d: str) -> DataFrame:
    """Orders and the suppliers of their items."""
    i = table(spark, d, "lineitem")
    return i.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


@query(f"with recursive {_GRAPH}, w as (select a x, b y from e union all select b, a from e), r as (select 'o' || min(l_orderkey) n from lineitem union select y from r join w on w.x = r.n) select n node from r")
def connected_component(spark: SparkSession, d: str) -> DataFrame:
    root = table(spark, d, "lineitem").agg(F.concat(F.lit("o"), F.min("l_orderkey")).alias("node"))
    return graph.connected(_bipartite(spark, d), root).select("node")


@query("""
with recursive e as (select unnest(source_refs) a, canonical_ref b from match_links where disposition = 'merged' and canonical_ref is not null),
s as (select min(a) n from e), w as (select a x, b y from e union all select b, a from e), r as (select n from s union select y from r join w on w.x = r.n) select n node from r""")
def connected_identity(spark: SparkSession, d: str) -> DataFrame:
    """Everything merged with the smallest ref, over refs and identities."""
    e = table(spark, d, "match_links").where("disposition = 'merged' and canonical_ref is not null").select(F.explode("source_refs").alias("src"), F.col("canonical_ref").alias("dst")).distinct()
    return graph.connected(e, e.agg(F.min("src").alias("node"))).select("node")


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    """Parent and child of every part: a fixed family tree over its keys."""
    return table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor((F.col("p_partkey") - 1) / 3).cast("long").alias("parent"))


@query("""
with recursive e as (select p_partkey child, (p_partkey - 1) // 3 parent from part where p_partkey > 0),
r as (select cast(700 as bigint) n, 0 depth union all select e.parent, depth + 1 from r join e on e.child = r.n where depth < 4) select n node, min(depth) depth from r group by 1""")
def ancestors_k(spark: SparkSession, d: str) -> DataFrame:
    edges = _lineage(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return graph.reach(edges, spark.range(700, 701).select(F.col("id").alias("node")), 4)


@query("""
with recursive e as (select p_partkey child, (p_partkey - 1) // 3 parent from part where p_partkey > 0),
r as (select cast(5 as bigint) n, 0 depth union all select e.child, depth + 1 from r join e on e.parent = r.n where depth < 3) select n node, min(depth) depth from r group by 1""")
def descendants_k(spark: SparkSession, d: str) -> DataFrame:
    edges = _lineage(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return graph.reach(edges, spark.range(5, 6).select(F.col("id").alias("node")), 3)


# ---------------------------------------------------------------- joins and rules


@query("""
select o_orderkey, l_linenumber, l_partkey, l_quantity, cast(date_diff('day', o_orderdate, l_shipdate) as bigint) days_apart from orders join lineitem on o_orderkey = l_orderkey
where date_diff('day', o_orderdate, l_shipdate) < -365 or date_diff('day', o_orderdate, l_shipdate) > 1500""")
def parent_child_range_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    days = F.datediff("l_shipdate", "o_orderdate")
    return relations.range_violations(o, i, "k", days < -365, days > 1500).select(F.col("k").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", days.cast("long").alias("days_apart"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and exists (select 1 from customer where c_custkey = o_custkey)")
def reciprocity_anti(spark: SparkSession, d: str) -> DataFrame:
    """Orders of existing customers without a returned item."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return relations.one_sided(table(spark, d, "orders").select("o_orderkey", "o_custkey"), back, ["o_orderkey"], known, "o_custkey").select("o_orderkey")


@query("select distinct r source_ref from (select unnest(source_refs) r from identities) where r not in (select source_ref from individuals where source_ref is not null)")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "identities").select(F.explode("source_refs").alias("source_ref")).distinct()
    return relations.missing(refs, table(spark, d, "individuals"), ["source_ref"])


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def empty_family(spark: SparkSession, d: str) -> DataFrame:
    return relations.missing(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


_RULES = """f as (
 select 'MISSING_NAME' code, 'high' severity, cast(individual_id as varchar) id from individuals where coalesce(trim(full_name), '') = '' union all
 select 'MISSING_BIRTH_DATE', 'medium', cast(individual_id as varchar) from individuals where coalesce(trim(birth_date), '') = '' union all
 select 'MISSING_BIRTH_PLACE', 'medium', cast(individual_id as varchar) from individuals where coalesce(trim(birth_place), '') = '' union all
 select 'MISSING_DEATH_PLACE', 'low', cast(individual_id as varchar) from individuals where coalesce(trim(death_date), '') <> '' and coalesce(trim(death_place), '') = '' union all
 select 'BIRTH_AFTER_DEATH', 'critical', cast(individual_id as varchar) from y where b > e union all
 select 'IMPLAUSIBLE_LIFESPAN', 'high', cast(individual_id as varchar) from y where e - b > 120)"""
_YEARS = r"""y as (select individual_id, cast(nullif(regexp_extract(coalesce(birth_date, ''), '\b(\d{4})\b', 1), '') as int) b, cast(nullif(regexp_extract(coalesce(death_date, ''), '\b(\d{4})\b', 1), '') as int) e from individuals)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    from stemma.operators.quality import person_findings

    return person_findings(table(spark, d, "individuals"), "individual_id")


@query(f"with {_YEARS}, {_RULES} select code, severity, id from f")
def rule_union(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)


@query(f"with {_YEARS}, {_RULES} select severity, count(*) n from f group by 1")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query("select rule_code, count(*) records, count(distinct canonical_ref) identities from identities group by 1")
def merge_accounting(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "identities").groupBy("rule_code").agg(F.count("*").alias("records"), F.countDistinct("canonical_ref").alias("identities"))


@query("""
select p_partkey, v.v, row_number() over (order by v.r, v.num nulls first, v.t nulls first, p_partkey) position from (select p_partkey, case when p_partkey % 10 = 0 then {'r': 0, 'num': null::hugeint, 't': null, 'v': null}
 when p_partkey % 3 = 0 then {'r': 1, 'num': p_size::hugeint, 't': null, 'v': p_size::varchar} else {'r': 2, 'num': null, 't': lower(p_name), 'v': p_name} end v from part)""")
def semantic_sort(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = F.when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("string")).when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return relations.ranked(p.select("p_partkey", v.alias("v")), [relations.semantic_key(F.col("v")), "p_partkey"], "position").select("p_partkey", "v", F.col("position").cast("long").alias("position"))


@query("select individual_id, coalesce(nullif(trim(birth_place), ''), nullif(trim(death_place), ''), nullif(trim(occupation), '')) is not null known, coalesce(case when trim(birth_place) <> '' then birth_place end, case when trim(death_place) <> '' then death_place end) place from individuals")
def alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    first = relations.first_filled("birth_place", "death_place", "occupation").isNotNull()
    return table(spark, d, "individuals").select("individual_id", first.alias("known"), relations.first_filled("birth_place", "death_place").alias("place"))


@query("""
select c_custkey, field, value from (select c_custkey, unnest([{'field': 'c_mktsegment', 'value': c_mktsegment}, {'field': 'c_nationkey', 'value': cast(c_nationkey as varchar)}], recursive := true) from customer)
where value is not null and trim(value) <> ''""")
def unpivot_unknown(spark: SparkSession, d: str) -> DataFrame:
    return relations.unpivot_rest(table(spark, d, "customer"), "c_custkey", ["c_name", "c_acctbal"])


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when p.p_partkey is not null then 'first' when s.s_suppkey is not null then 'second' end owner_kind, coalesce(p.p_partkey, s.s_suppkey) owner_id
from lineitem left join (select p_partkey from part where p_size > 25) p on p.p_partkey = l_partkey left join (select s_suppkey from supplier where s_acctbal > 0) s on s.s_suppkey = l_suppkey""")
def owner_priority_join(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    a, b = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return relations.owner_first(i, a, b, "l_partkey", "l_suppkey")


@query("""
select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_discount < 0.02) and p_partkey not in (select l_partkey from lineitem where not l_discount < 0.02 and l_returnflag = 'R')""")
def safe_source_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").where("l_discount < 0.02 or l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_discount")
    return relations.safe_only(table(spark, d, "part").select("p_partkey"), uses, "p_partkey", F.col("l_discount") < 0.02)


@query("select '@I' || row_number() over (order by c_name, c_custkey) || '@' xref, c_custkey from customer")
def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    c = relations.ranked(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"])
    return c.select(F.concat(F.lit("@I"), "rank", F.lit("@")).alias("xref"), "c_custkey")


# ---------------------------------------------------------------- files


def _as_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, records and blocks of the individuals written as GEDCOM, one file per source file."""
    from stemma.sources import gedcom

    blank = lambda c: F.coalesce(F.regexp_replace(c, r"[\r\n]", " "), F.lit(""))
    people = table(spark, d, "individuals").where("pointer is not null")
    record = F.array(
        F.concat(F.lit("0 "), "pointer", F.lit(" INDI")), F.concat(F.lit("1 NAME "), blank(F.col("given_name")), F.lit(" /"), blank(F.col("surname")), F.lit("/")), F.lit("1 BIRT"), F.concat(F.lit("2 PLAC "), blank(F.col("birth_place")))
    )
    person = people.select(F.col("source_file").alias("source"), F.lit(1).alias("section"), F.col("individual_id").alias("n"), F.posexplode(record).alias("i", "raw"))
    files = people.select(F.col("source_file").alias("source")).distinct()
    end = lambda section, text: files.select("source", F.lit(section).alias("section"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"), F.lit(text).alias("raw"))
    # lines are placed by a sort over all files, so no file is gathered in one task
    placed = relations.ranked(end(0, "0 HEAD").unionByName(person).unionByName(end(2, "0 TRLR")), ["source", "section", "n", "i"], "pos")
    ls = settle(gedcom.strict(gedcom.parsed(placed.withColumn("ord", F.lit(1)))))
    return ls, gedcom.records(ls), gedcom.blocks(ls)


@query("select source_file source, count(*) people, count(*) - count(distinct pointer) repeated from individuals where pointer is not null group by 1")
def gedcom_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records of every file, and pointers that it declares again."""
    r = _as_files(spark, d)[1].where("tag = 'INDI'")
    return r.groupBy("source").agg(F.count("*").alias("people"), (F.count("*") - F.countDistinct("pointer")).alias("repeated"))


@query(r"""
select distinct source_file source, pointer, trim(regexp_replace(coalesce(given_name, ''), '\s+', ' ', 'g')) given, trim(coalesce(surname, '')) surname from individuals where pointer is not null""")
def gedcom_names(spark: SparkSession, d: str) -> DataFrame:
    from stemma.sources import gedcom

    _, recs, bs = _as_files(spark, d)
    return gedcom.names(bs, recs).select("source", "pointer", "given", "surname").distinct()


@query("select distinct source_file source, pointer, trim(coalesce(birth_place, '')) place from individuals where pointer is not null")
def gedcom_places(spark: SparkSession, d: str) -> DataFrame:
    from stemma.sources import gedcom

    _, recs, bs = _as_files(spark, d)
    return gedcom.facts(bs, recs, tags=("BIRT",)).select("source", "pointer", "place").distinct()


@query(None)
def date_standard(spark: SparkSession, d: str) -> DataFrame:
    """Typed dates in the standard form; forms are tested one by one."""
    return with_normalized_dates(table(spark, d, "individuals").select("individual_id", "birth_date"), {"birth_date": "standard"}).select("individual_id", "standard")


@query(None)
def profile_key_freq(spark: SparkSession, d: str) -> DataFrame:
    """How many people have each key of the identity profile; the keys are tested one by one."""
    from stemma.operators.identity import profile_keys

    keys = profile_keys(*(F.col(c) for c in ("surname", "given_name", "gender", "birth_date", "birth_place", "death_date", "death_place", "full_name")))
    return blocking.key_frequencies(blocking.explode_keys(table(spark, d, "individuals"), keys, "individual_id"))


# ---------------------------------------------------------------- event log


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return relations.event_log(e, "user_id", ["event_id"], ["event_type"], F.col("event_type") == "purchase")


_LOG = """g as (select user_id, event_id, event_type, lag(event_type) over w p, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) t from events window w as (partition by user_id order by event_id)),
s as (select user_id, row_number() over (partition by user_id order by event_id) as "sequence", event_id, event_type from g where coalesce(p, '') <> event_type and coalesce(t, 0) = 0)"""


@query(f'with {_LOG} select user_id, "sequence", event_id, event_type from s')
def event_log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) k from events) where k <= 256")
def retain_last_n(spark: SparkSession, d: str) -> DataFrame:
    return relations.keep_last(table(spark, d, "events").select("user_id", "event_id"), "user_id", [F.desc("event_id")], 256)


# ---------------------------------------------------------------- SQL gateway: one text for both engines

GATED = {
    "gate_projection_case": "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'much' end band, cast(c_nationkey as bigint) nation from customer where c_name like 'Customer%' and c_nationkey between 3 and 9",
    "gate_inner_join": "select n_name, r_name, count(*) customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name",
    "gate_left_join": "select o_orderkey, count(l_orderkey) items from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey",
    "gate_full_join": "select coalesce(a.p_brand, b.p_brand) brand, a.n small, b.n large from (select p_brand, count(*) n from part where p_size < 10 group by p_brand) a full join (select p_brand, count(*) n from part where p_size > 40 group by p_brand) b on a.p_brand = b.p_brand",
    "gate_exists": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    "gate_not_exists": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    "gate_theta_join": "select a.n_nationkey x, b.n_nationkey y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey",
    "gate_scalar_subquery": "select s_suppkey from supplier where s_acctbal > (select avg(s_acctbal) from supplier)",
    "gate_correlated": "select p_partkey from part p where p_retailprice >= (select max(q.p_retailprice) from part q where q.p_brand = p.p_brand)",
    "gate_in_subquery": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "gate_union": "select c_nationkey k from customer union select s_nationkey from supplier",
    "gate_union_all": "select c_nationkey k from customer where c_acctbal > 9000 union all select s_nationkey from supplier where s_acctbal > 9000",
    "gate_intersect": "select c_nationkey k from customer where c_acctbal > 9900 intersect select s_nationkey from supplier",
    "gate_except": "select n_nationkey k from nation except select s_nationkey from supplier where s_acctbal > 5000",
    "gate_having": "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty, round(avg(l_discount), 6) disc from lineitem group by l_returnflag, l_linestatus having count(*) > 10",
    "gate_distinct_agg": "select l_suppkey, count(distinct l_partkey) parts, count(*) filter (where l_quantity > 25) many from lineitem group by l_suppkey",
    "gate_window_rank": "select c_custkey, rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey) r, ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) q from customer",
    "gate_window_lag": "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) prev, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) next from orders",
    "gate_window_frame": "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) n, first_value(o_orderkey) over (partition by o_custkey order by o_orderkey) f from orders",
    "gate_cte": "with big as (select o_custkey, count(*) n from orders group by o_custkey having count(*) > 12) select c_name, n from big join customer on c_custkey = o_custkey",
    "gate_order_limit": "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 50 offset 10",
}
#: Gated queries whose SQL is written differently in the other engine.
GATED_PAIRS = {
    "gate_json": ("select event_id, cast(get_json_object(props, '$.k') as bigint) k from events", "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events"),
    "gate_listagg": ("select n_regionkey, listagg(n_name, ',') within group (order by n_name) names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) names from nation group by n_regionkey"),
    "gate_date_parts": ("select year(o_orderdate) y, month(o_orderdate) m, count(*) n from orders group by 1, 2", "select cast(year(o_orderdate) as int) y, cast(month(o_orderdate) as int) m, count(*) n from orders group by 1, 2"),
    "gate_rollup": ("select n_regionkey, n_name, count(*) n from nation group by rollup(n_regionkey, n_name)", "select n_regionkey, n_name, count(*) n from nation group by rollup(n_regionkey, n_name)"),
}


def _gated(sql: str) -> Query:
    return lambda spark, d: sqlgate.run(spark, d, sql)


for _name, _sql in GATED.items():
    QUERIES[_name], SQL[_name] = _gated(_sql), _sql
for _name, (_sql, _other) in GATED_PAIRS.items():
    QUERIES[_name], SQL[_name] = _gated(_sql), _other


@query("select o_orderkey from orders order by o_orderkey limit 100")
def query_cap(spark: SparkSession, d: str) -> DataFrame:
    """The row cap of the gateway: 100 rows of a larger result."""
    return sqlgate.capped(spark, d, "select o_orderkey from orders order by o_orderkey").rows
