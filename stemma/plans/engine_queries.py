"""More queries over the driver tables, each through an operator of the engine, with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import dates, normal, ocr
from stemma.functions import places as country
from stemma.functions import text as tx
from stemma.operators import graph, identity, quality, relations, sync
from stemma.plans.queries import query
from stemma.sources import gedcom, gedcom_writer, structure
from stemma.streaming import joblog
from stemma.tables import settle, table

# ---------------------------------------------------------------- values

_SPACES = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"


def _spaced(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({text}), '{_SPACES}', ' ', 'g'))"


@query("""
select o_orderkey, case when o_orderkey % 5 = 0 then 0.0 when o_orderkey % 5 = 1 then 0.0 when o_orderkey % 5 = 2 then 0.0 when o_orderkey % 5 = 3 then (o_orderkey % 100) / 100.0 else 0.0 end confidence from orders""")
def confidence_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from 0 to 1 stay, all else is 0: words, what is no number, and numbers beyond."""
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, "nan").when(k % 5 == 1, "true").when(k % 5 == 2, "-0.5").when(k % 5 == 3, F.concat(F.lit("0."), F.lpad((k % 100).cast("string"), 2, "0"))).otherwise("1.5")
    return table(spark, d, "orders").select("o_orderkey", normal.confidence(said).alias("confidence"))


_P = f"string_split({_spaced('birth_place')}, ',')"
_PART = r"regexp_replace(lower(trim(regexp_replace(x, '\s+', ' ', 'g'))), '([\p{L}\p{N}_])[.;](\s|$)', '\1\2', 'g')"


@query(f"""
with p as (select individual_id, {_spaced("coalesce(full_name, '')")} n, {_spaced("coalesce(gender, '')")} g, list_transform({_P}, lambda x: {_PART}) parts from individuals)
select individual_id, lower(n) name_value, lower(g) sex_value, case when parts is null then '' else array_to_string(list_append(parts[1:-2], coalesce({country.country_sql("parts[-1]")}, '')), ',') end place_value from p""")
def tag_values(spark: SparkSession, d: str) -> DataFrame:
    """Names, sexes and places in the form in which their tags compare them."""
    p = table(spark, d, "individuals").select("individual_id", "full_name", "gender", "birth_place")
    for tag, column, out in (("NAME", "full_name", "name_value"), ("SEX", "gender", "sex_value"), ("PLAC", "birth_place", "place_value")):
        p = normal.with_normal_values(p.withColumn("tag", F.lit(tag)), "tag", column, out)
    return p.select("individual_id", "name_value", "sex_value", "place_value")


@query(f"select doc_id, {_spaced('title')} title from documents")
def normal_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normal.normal_space(F.col("title")).alias("title"))


@query("select distinct substr('_RM_' || upper(regexp_replace(occupation, '[^A-Za-z0-9_]', '_', 'g')), 1, 31) tag from individuals where occupation is not null")
def retained_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "individuals").where("occupation is not null").select(normal.retained_tag(F.col("occupation")).alias("tag")).distinct()


@query(r"select doc_id, trim(regexp_replace(replace(replace(coalesce(text, ''), '\', '\\'), '|', '\|'), '[\r\n]', ' ', 'g')) cell from documents")
def markdown_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normal.markdown(F.col("text")).alias("cell"))


@query("""select cast(c_custkey as varchar) c_custkey, c_mktsegment, '{"data":"' || to_base64(encode(c_name)) || '","encoding":"base64"}' name_bytes, case when c_custkey % 3 = 0 then '{"data":"nan","encoding":"float"}' when c_custkey % 3 = 1 then '{"data":"-inf","encoding":"float"}' end odd from customer""")
def result_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a result as text: bytes and numbers that are not finite as small objects."""
    odd = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 3 == 1, F.lit(float("-inf")))
    return normal.cells(table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.encode("c_name", "UTF-8").alias("name_bytes"), odd.alias("odd")))


@query("select doc_id, left(text, list_max(list_filter(range(0, 256), lambda n: strlen(left(text, n)) <= 255))) beginning from documents")
def utf8_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normal.byte_prefix(F.col("text"), 255).alias("beginning"))


@query("select doc_id, true short, sha256(coalesce(text, '')) rejoined from documents")
def utf8_wrap_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts wrapped as note lines and joined again: no line over 255 bytes, and nothing lost."""
    lines = gedcom_writer.wrap_notes(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    rest = F.regexp_replace("line", r"^\d+ \w+ ?", "")
    piece = F.when(F.col("line").startswith("2 CONT"), F.concat(F.lit("\n"), rest)).otherwise(rest)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"]), "")
    return lines.groupBy("doc_id").agg((F.max(F.octet_length("line")) <= gedcom_writer.MAX_BYTES).alias("short"), F.sha2(whole, 256).alias("rejoined"))


@query("""
select doc_id, list_aggregate(list_filter(l, lambda x, i: x <> '' and list_position(l, x) = i), 'string_agg', chr(10)) lines from
(select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) l from documents)""")
def ocr_line_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Blanks collapsed, blank and repeated lines dropped, order kept; letters as they are."""
    return table(spark, d, "documents").select("doc_id", ocr.distinct_lines(F.col("text")).alias("lines"))


def _bounds(c: str) -> str:
    y = rf"list_transform(regexp_extract_all(coalesce({c}, ''), '\b(\d{{4}})\b', 1), lambda y: cast(y as int))"
    w = f"upper(substr(trim({c}), 1, 4))"
    lo = f"list_min({y}) + case when {w} in ('ABT ', 'CAL ', 'EST ') then -2 when {w} = 'BEF ' then -5 when {w} = 'AFT ' then 1 else 0 end"
    hi = f"list_max({y}) + case when {w} in ('ABT ', 'CAL ', 'EST ') then 2 when {w} = 'BEF ' then -1 when {w} = 'AFT ' then 5 else 0 end"
    return f"{lo} {c}_lo, {hi} {c}_hi"


@query(f"""
with b as (select individual_id, birth_date, death_date, {_bounds("birth_date")}, {_bounds("death_date")} from individuals), g as (select *, greatest(birth_date_lo - death_date_hi, death_date_lo - birth_date_hi) gap from b)
select individual_id, cast(case when birth_date is null or death_date is null then null when lower(trim(birth_date)) = lower(trim(death_date)) then 100 when birth_date_lo is null or death_date_lo is null then 0
 when gap <= 0 then 90 when gap <= 5 then 100 - 20 * gap else 0 end as int) score from g""")
def date_bounds_qualified(spark: SparkSession, d: str) -> DataFrame:
    """Dates with ABT, CAL, EST, BEF and AFT by their bounds: birth against death of one person."""
    return table(spark, d, "individuals").select("individual_id", dates.text_date_similarity(F.col("birth_date"), F.col("death_date")).cast("int").alias("score"))


# ---------------------------------------------------------------- identity


def _lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence of two columns of at most 120 letters, a row of bits at a time."""
    full = f"((1::hugeint << len({x})::int) - 1)"
    masks = f"list_transform(string_split({y}, ''), lambda c: coalesce(list_sum(list_transform(range(1, len({x}) + 1), lambda i: case when {x}[i] = c then (1::hugeint << (i - 1)::int) else 0::hugeint end)), 0)::hugeint)"
    return f"(len({x}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda w, m: ((w + (w & m)) | (w - (w & m))) & {full})))"


def _tokens(c: str) -> str:
    return rf"coalesce(list_aggregate(list_sort(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')), 'string_agg', ' '), '')"


def _text(x: str, y: str) -> str:
    return f"case when {x} = {y} then 100.0 when {x} = '' or {y} = '' then 0.0 else 200.0 * {_lcs(x, y)} / (len({x}) + len({y})) end"


def _date(a: str, b: str) -> str:
    gap = f"greatest({a}_lo - {b}_hi, {b}_lo - {a}_hi)"
    return f"case when lower(trim({a})) = lower(trim({b})) then 100.0 when {a}_lo is null or {b}_lo is null then 0.0 when {gap} <= 0 then 90.0 else greatest(0.0, 100.0 - 20.0 * {gap}) end"


_FIELDS = ("full_name", "birth_date", "birth_place", "death_date", "death_place", "gender", "occupation")
_KNOWN = ", ".join(f"'{c}'" for c in country.KNOWN_COUNTRIES)


def _land(place: str) -> str:
    name = country.country_sql(f"string_split({place}, ',')[-1]")
    return f"case when {name} in ({_KNOWN}) then {name} end"


_WEIGHT = {"n": 30, "bd": 12, "bp": 8, "bc": 7, "dd": 8, "dp": 6, "dc": 5, "s": 4, "o": 5}
_SIDES = ", ".join(f"nullif({f}, '') {f}" for f in _FIELDS)
_ASSESS = f"""
one as (select source_ref, {", ".join(f"arg_min({f}, individual_id) {f}" for f in _FIELDS)} from (select source_ref, individual_id, {", ".join(f"coalesce({f}, '') {f}" for f in _FIELDS)} from individuals where source_ref is not null) group by 1),
g as (select distinct canonical_ref, unnest(source_refs) r from identities where canonical_ref is not null), h as (select canonical_ref, r from g join one on source_ref = r),
m as (select canonical_ref, min(r) l from h group by 1), pr as (select distinct m.l, h.r from m join h using (canonical_ref) where h.r <> m.l),
e as (select source_ref, {", ".join(f"nullif({f}, '') {f}" for f in _FIELDS)}, {_tokens("full_name")} tn, {_tokens("birth_place")} tbp, {_tokens("death_place")} tdp, {_tokens("occupation")} t_o,
 {_land("birth_place")} bl, {_land("death_place")} dl from one),
y as (select *, {_bounds("birth_date")}, {_bounds("death_date")} from e),
z as (select pr.l, pr.r, {", ".join(f"a.{c} a_{c}, b.{c} b_{c}" for c in (*_FIELDS, "tn", "tbp", "tdp", "t_o", "bl", "dl", "birth_date_lo", "birth_date_hi", "death_date_lo", "death_date_hi"))}
 from pr join y a on a.source_ref = pr.l join y b on b.source_ref = pr.r),
s as (select l, r, case when a_full_name is not null and b_full_name is not null then {_text("a_tn", "b_tn")} end n,
 case when a_birth_date is not null and b_birth_date is not null then {_date("a_birth_date", "b_birth_date")} end bd, case when a_birth_place is not null and b_birth_place is not null then {_text("a_tbp", "b_tbp")} end bp,
 case when a_bl is not null and b_bl is not null then {_text("a_bl", "b_bl")} end bc, case when a_death_date is not null and b_death_date is not null then {_date("a_death_date", "b_death_date")} end dd,
 case when a_death_place is not null and b_death_place is not null then {_text("a_tdp", "b_tdp")} end dp, case when a_dl is not null and b_dl is not null then {_text("a_dl", "b_dl")} end dc,
 case when a_gender is not null and b_gender is not null then case when lower(a_gender) = lower(b_gender) then 100.0 else 0.0 end end s, case when a_occupation is not null and b_occupation is not null then {_text("a_t_o", "b_t_o")} end o,
 a_bl <> b_bl bcc, a_dl <> b_dl dcc, @years_b byc, @years_d dyc from z)"""
# the years of a side are those of its one date, so the bounds without the leading word are compared
_YEARS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '\b(\d{{4}})\b', 1), lambda y: cast(y as int))"
_APART = "(len({0}) > 0 and len({1}) > 0 and len(list_filter({0}, lambda p: len(list_filter({1}, lambda q: abs(p - q) <= 5)) > 0)) = 0)"
_SPREAD = "coalesce(list_max({0}) - list_min({0}) > 5, false)"


def _year_conflict(f: str) -> str:
    a, b = _YEARS.format(f"a_{f}"), _YEARS.format(f"b_{f}")
    return f"(cast({_APART.format(a, b)} as int) + cast({_SPREAD.format(a)} or {_SPREAD.format(b)} as int))"


_ASSESS = _ASSESS.replace("@years_b", _year_conflict("birth_date")).replace("@years_d", _year_conflict("death_date"))
_COUNT = " + ".join(f"cast({k} is not null as int)" for k in _WEIGHT)
_TOTAL = " + ".join(f"case when {k} is not null then {w} else 0 end" for k, w in _WEIGHT.items())
_SUM = " + ".join(f"coalesce({k}, 0) * {w}" for k, w in _WEIGHT.items())


@query(f"""
with {_ASSESS}, c as (select l, r, {_COUNT} fields, cast({_TOTAL} as double) weight, {_SUM} total,
 coalesce(cast(n < 55 as int), 0) + coalesce(cast(s < 100 as int), 0) + coalesce(byc, 0) + coalesce(dyc, 0) + coalesce(cast(bcc as int), 0) + coalesce(cast(dcc as int), 0) conflicts from s),
w as (select *, case when weight > 0 then total / weight else 0.0 end base from c), k as (select *, case when fields = 1 then least(base, 88.0) when weight < 45 then least(base, 94.0) else base end held from w)
select l, r, cast(round(round(greatest(0.0, least(100.0, case when conflicts > 0 then least(held - least(36.0, 12.0 * conflicts), 84.0) else held end)), 2) + 1e-9, 1) as double) score, weight, cast(fields as int) fields, cast(conflicts as int) conflicts from k""")
def identity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Evidence scores of the first record of each merged identity against its others: names, vital events, sex and occupation."""
    fields = [F.coalesce(F.col(f), F.lit("")).alias(f) for f in _FIELDS]
    one = table(spark, d, "individuals").where("source_ref is not null").groupBy("source_ref").agg(F.min_by(F.struct(*fields), "individual_id").alias("p")).select("source_ref", "p.*")
    refs = table(spark, d, "identities").where("canonical_ref is not null").select("canonical_ref", F.explode("source_refs").alias("r")).distinct().join(one.select(F.col("source_ref").alias("r")), "r")
    first = refs.groupBy("canonical_ref").agg(F.min("r").alias("l"))
    pairs = refs.join(first, "canonical_ref").where("l != r").select("l", "r").distinct()
    some = lambda c: F.col(c) != ""
    event = lambda date, place: F.when(some(date) | some(place), F.array(F.struct(F.lit("").alias("value"), F.col(date).alias("date"), F.col(place).alias("place"), F.lit("").alias("country"))))
    fact = F.when(some("occupation"), F.array(F.struct(F.lit("OCCU").alias("tag"), F.col("occupation").alias("value"), F.lit("").alias("date"), F.lit("").alias("place"), F.lit("").alias("country"))))
    typed = {f.name: f.dataType for f in spark.createDataFrame([], identity.PERSON).schema.fields}
    given = {
        "pointer": F.col("source_ref"), "source": F.lit("s"), "names": F.when(some("full_name"), F.array("full_name")), "sex": F.col("gender"), "birth": event("birth_date", "birth_place"), "death": event("death_date", "death_place"), "facts": fact,
    }
    text = ("pointer", "source", "sex")
    people = one.select(*(given[n].cast(t).alias(n) if n in text else F.coalesce(given.get(n, F.lit(None)).cast(t), F.array().cast(t)).alias(n) for n, t in typed.items()))
    s = identity.score_pairs(pairs, people)
    return s.select("l", "r", F.round(F.col("score") + 1e-9, 1).alias("score"), "weight", F.size("fields").alias("fields"), F.size("conflicts").alias("conflicts"))


_PICK = """case when coalesce({0}.{2}, '') = '' then coalesce({1}.{2}, '') when coalesce({1}.{2}, '') = '' then {0}.{2} else {3} end {2}"""
_W = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query(rf"""
with one as (select source_ref, min(individual_id) a, max(individual_id) b from individuals where source_ref is not null group by 1 having count(*) > 1)
select one.source_ref, {_PICK.format("x", "y", "surname", "x.surname")}, {_PICK.format("x", "y", "birth_date", "case when len(x.birth_date) >= len(y.birth_date) then x.birth_date else y.birth_date end")},
 {_PICK.format("x", "y", "birth_place", f"case when len(list_filter({_W.format('x.birth_place')}, lambda w: not list_contains({_W.format('y.birth_place')}, w))) = 0 and len(list_filter({_W.format('y.birth_place')}, lambda w: not list_contains({_W.format('x.birth_place')}, w))) > 0 then y.birth_place else x.birth_place end")}
from one join individuals x on x.individual_id = a join individuals y on y.individual_id = b""")
def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that survive when the first and last import of a record become one."""
    p = table(spark, d, "individuals").where("source_ref is not null").select("source_ref", F.struct("individual_id", "surname", "birth_date", "birth_place").alias("p"))
    both = p.groupBy("source_ref").agg(F.min_by("p", "p.individual_id").alias("x"), F.max_by("p", "p.individual_id").alias("y"), F.count("*").alias("n")).where("n > 1")
    names = ("surname", "birth_date", "birth_place")
    chosen = identity.choose_fields({n: F.col(f"x.{n}") for n in names}, {n: F.col(f"y.{n}") for n in names})
    return both.select("source_ref", *(c.alias(n) for n, c in chosen.items()))


# ---------------------------------------------------------------- sync

_LAST = """f as (select distinct tree_id, generation, unnest(map_entries(active_snapshots)) e from sync_manifests), gg as (select tree_id, generation, e.key source_id, min(e.value) sid from f group by all),
t as (select *, lag(sid) over (partition by tree_id, source_id order by generation) prev from gg), st as (select tree_id, source_id, arg_max(prev, generation) prev, arg_max(sid, generation) sid from t where prev <> sid group by all),
r as (select snapshot_id, uid, min(coalesce(label, '')) l, min(coalesce(event_date, '')) dd, min(case kind when 'person-block' then 'OCCU' when 'family-block' then 'MARR' else 'SOUR' end) tag, max(len(coalesce(attributes, [])) > 1) cited from snapshot_records where uid is not null group by all),
b as (select *, sha256(l || chr(10) || dd) hash, sha256(tag || chr(10) || dd) logical from r),
own as (select distinct st.tree_id || '|' || b.uid person, b.* from st join b on b.snapshot_id = st.prev), new as (select distinct st.tree_id || '|' || b.uid person, b.* from st join b on b.snapshot_id = st.sid)"""


def _sync_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of the master, blocks of the snapshots, snapshots in force): the last change of snapshot of each tree and source."""
    from stemma.operators.snapshot_diff import transitions

    steps = transitions(table(spark, d, "sync_manifests")).groupBy("tree_id", "source_id").agg(F.max_by("prev_snapshot_id", "generation").alias("prev"), F.max_by("snapshot_id", "generation").alias("sid"))
    steps = settle(steps)
    tag = F.when(F.col("kind") == "person-block", "OCCU").when(F.col("kind") == "family-block", "MARR").otherwise("SOUR")
    text = lambda c: F.min(F.coalesce(c, F.lit(""))).alias(c)
    r = table(spark, d, "snapshot_records").where("uid is not null").groupBy("snapshot_id", "uid").agg(text("label"), text("event_date"), F.min(tag).alias("tag"), F.max(F.size(F.coalesce("attributes", F.array().cast("array<string>"))) > 1).alias("cited"))
    b = settle(r.select("snapshot_id", "uid", "tag", "cited", tx.sha_key(F.col("label"), F.col("event_date")).alias("hash"), tx.sha_key(F.col("tag"), F.col("event_date")).alias("logical")))
    of = lambda c: steps.select("tree_id", F.col(c).alias("snapshot_id")).join(b, "snapshot_id").select(F.concat_ws("|", "tree_id", "uid").alias("person"), "hash", "tag", "logical", "cited", F.col("snapshot_id").alias("snapshot")).distinct()
    return of("prev"), of("sid"), steps.select(F.col("sid").alias("snapshot")).distinct()


@query(f"""
with {_LAST}, prior as (select person, hash, min(tag) tag, min(logical) logical, max(hash < '2') guarded, list_sort(list_distinct(list(snapshot_id))) obs from own group by all),
dead as (select distinct person, hash from new where hash >= 'f'), deadl as (select distinct person, logical from new where hash >= 'f'),
seen as (select person, hash, min(tag) tag, min(logical) logical, max(m) own, max(cited) cited, list_sort(list_distinct(coalesce(list(sid) filter (sid is not null), []))) snaps from
 (select person, hash, tag, logical, cited, 1 m, null sid from own where hash not like '%0' union all select person, hash, tag, logical, cited, 0, snapshot_id from new) group by all),
gone as (select distinct s.person, s.hash from (select person, hash, logical from own where hash not like '%0' union select person, hash, logical from new) s left join dead using (person, hash) left join deadl using (person, logical) where dead.person is not null or deadl.person is not null),
j as (select coalesce(p.person, s.person) person, coalesce(p.hash, s.hash) hash, coalesce(p.tag, s.tag) tag, coalesce(p.guarded, false) guarded, coalesce(p.obs, []) obs, coalesce(s.own, 0) own, coalesce(s.cited, false) cited, g.person is not null dead,
 case when g.person is not null then [] else coalesce(s.snaps, []) end snaps from prior p full join seen s on p.person = s.person and p.hash = s.hash left join gone g on g.person = s.person and g.hash = s.hash),
k as (select *, list_sort(list_distinct(list_concat(obs, snaps))) obs2, len(list_filter(snaps, lambda x: not list_contains(obs, x))) > 0 is_new from j), act as (select list(distinct sid) a from st),
q as (select k.*, own = 1 and not list_has_any(obs2, a) and not guarded absent from k, act)
select person, hash, case when dead and own = 0 then 'tombstone' when absent and tag in ('OCCU', 'MARR') and not cited then 'removed' when absent then 'kept' when is_new then 'added' else 'same' end fate, array_to_string(obs2, ',') observations from q""")
def sync_registry(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every block of a tree at its last change of snapshots.

    The master has the blocks of the snapshot before, some of which are guarded; some blocks of the new one have a tombstone.
    """
    old, new, active = _sync_inputs(spark, d)
    prior = old.groupBy("person", "hash").agg(
        F.min("tag").alias("tag"), F.min("logical").alias("logical"), F.when(F.max(F.col("hash") < "2"), F.array(F.lit("baseline"))).otherwise(F.array().cast("array<string>")).alias("protected"),
        F.array_sort(F.collect_set("snapshot")).alias("observations"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"),
    )
    seen = old.where(~F.col("hash").endswith("0")).withColumn("snapshot", F.lit(None).cast("string")).unionByName(new)
    dead = new.where("hash >= 'f'").select("person", "hash", "logical").distinct()
    out = sync.register(prior, seen, dead, active, 2)
    return out.select("person", "hash", "fate", F.array_join("observations", ",").alias("observations"))


@query("""
select canonical_ref, source_ref, cast(n as bigint) copies from (select canonical_ref, source_ref, max(c) n from (select canonical_ref, rule_code, source_ref, count(*) c from (select canonical_ref, rule_code, unnest(source_refs) source_ref from identities) group by all) group by all)""")
def citation_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "identities").select(F.col("canonical_ref").alias("block"), F.col("rule_code").alias("origin"), F.explode("source_refs").alias("key"))
    return sync.citation_union(c).select(F.col("block").alias("canonical_ref"), F.col("key").alias("source_ref"), F.col("copies").cast("long").alias("copies"))


@query("select cast(p_partkey as varchar) pointer, cast(min(p_partkey) over (partition by p_type, p_name) as varchar) representative from part")
def consolidated_records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select(F.col("p_partkey").alias("pointer"), F.col("p_type").alias("tag"), F.col("p_name").alias("content"))
    return sync.consolidate(r).select(F.col("pointer").cast("string"), F.col("representative").cast("string"))


@query("""
with n as (select s_suppkey item, row_number() over (order by s_name, s_suppkey) - 1 v from supplier), u as (select distinct p_size n from part where p_size >= 3), f as (select n - 3 - (row_number() over (order by n) - 1) v from u)
select s_suppkey, '@M_S' || (3 + n.v + (select count(*) from f where f.v <= n.v)) || '@' pointer from n join supplier on s_suppkey = item""")
def allocated_pointers(spark: SparkSession, d: str) -> DataFrame:
    """New pointers for suppliers from 3 on, beside those that sizes of parts have taken."""
    from stemma.plans.sync import allocate

    items = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.lit("S").alias("prefix"), F.col("s_name").alias("key"))
    used = table(spark, d, "part").select(F.concat(F.lit("@M_S"), F.col("p_size").cast("string"), F.lit("@")).alias("pointer"))
    return allocate(items, used, {"S": 3})[0].select(F.col("item").alias("s_suppkey"), "pointer")


@query("select tree_id, generation, len(map_keys(active_snapshots)) sources from (select *, row_number() over (partition by tree_id order by generation desc, updated_at desc) k from sync_manifests) where k = 1")
def latest_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sync_manifests").withColumn("version", F.struct("generation", "updated_at"))
    return relations.latest_versions(m.select("tree_id", "generation", F.size(F.map_keys("active_snapshots")).cast("long").alias("sources"), "version"), "tree_id", "version").select("tree_id", "generation", "sources")


# ---------------------------------------------------------------- relations through their operators


@query("select s.source_id, s.tree_id, count(distinct vendor) vendors from snapshots s group by all having count(distinct vendor) > 1")
def continuity_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a tree whose vendor is not the same in every snapshot."""
    return relations.inconsistent(table(spark, d, "snapshots"), ["source_id", "tree_id"], "vendor", "vendors")


@query("select doc_id, sha256(coalesce(lang, '') || chr(10) || coalesce(source, '') || chr(10) || coalesce(text, '')) block_key from documents")
def sha_block_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.sha_key(F.col("lang"), F.col("source"), F.col("text")).alias("block_key"))


@query("select sha256(text) text_key, count(*) n, min(doc_id) first_doc from documents where text is not null group by 1 having count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return relations.text_groups(table(spark, d, "documents"), "text", "doc_id").withColumnRenamed("first", "first_doc")


@query("select source_ref, count(distinct birth_date) alternatives from individuals where trim(birth_date) <> '' group by 1 having count(distinct birth_date) > 1")
def distinct_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return relations.alternatives(table(spark, d, "individuals"), "source_ref", "birth_date")


@query("""
select canonical_ref, list_aggregate(list_sort(list_distinct(flatten(list(source_refs)))), 'string_agg', ',') refs, len(list_distinct(flatten(list(source_refs)))) n_refs from identities group by 1""")
def merge_identity_grouping(spark: SparkSession, d: str) -> DataFrame:
    return relations.group_refs(table(spark, d, "identities"), "canonical_ref", "source_refs")


@query("""
select canonical_ref, source_ref, n from (select canonical_ref, source_ref, max(c) n from (select canonical_ref, rule_code, source_ref, count(*) c from
(select canonical_ref, rule_code, unnest(source_refs) source_ref from identities) group by all) group by all) where n > 1""")
def citation_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """The largest number of times that one origin cites a ref."""
    c = table(spark, d, "identities").select("canonical_ref", "rule_code", F.explode("source_refs").alias("source_ref"))
    return relations.multiplicity(c, ["canonical_ref", "source_ref"], "rule_code").where("n > 1")


_WRITTEN = {"individuals": ("source_ref in (select unnest(source_refs) from identities)", "source_ref"), "snapshots": ("snapshot_id in (select unnest(map_values(active_snapshots)) from sync_manifests)", "snapshot_id"), "orders": ("o_orderkey in (select l_orderkey from lineitem)", "o_orderkey")}


@query(" union all ".join(f"select '{t}' table_name, count(*) n_rows, count(*) - count(*) filter ({w}) lost from {t} having count(*) > count(*) filter ({w})" for t, (w, _) in _WRITTEN.items()))
def loss_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables that have no part in what was made of them; only tables that lose any."""
    made = {
        "individuals": table(spark, d, "identities").select(F.explode("source_refs").alias("source_ref")),
        "snapshots": table(spark, d, "sync_manifests").select(F.explode(F.map_values("active_snapshots")).alias("snapshot_id")),
        "orders": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")),
    }
    return relations.losses([(t, table(spark, d, t), table(spark, d, t).join(made[t].distinct(), key, "left_semi")) for t, (_, key) in _WRITTEN.items()])


@query("select placeid, len(list_distinct(list(a))) names, list_aggregate(list_sort(list_distinct(list(a))), 'string_agg', '|') listed from (select placeid, unnest(list_append(alternate_names, string_split(name, ',')[1])) a from placetable) where a is not null group by 1")
def place_multimap(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "placetable").select("placeid", F.explode(F.concat("alternate_names", F.array(F.element_at(F.split("name", ","), 1)))).alias("a"))
    return relations.multimap(names, "placeid", "a").select("placeid", F.size("values").cast("long").alias("names"), F.array_join("values", "|").alias("listed"))


@query("select ownerid, nameid, full_name from (select *, row_number() over (partition by tree_file, surname order by coalesce(isprimary, 0) desc, lower(full_name), nameid) k from nametable where surname is not null) where k = 1")
def primary_name_first(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nametable").where("surname is not null")
    return relations.first_of(n, ["tree_file", "surname"], [F.coalesce("isprimary", F.lit(0)).desc(), F.lower("full_name"), F.col("nameid")]).select("ownerid", "nameid", "full_name")


@query("select tree_id, max(generation) + 1 next_generation from sync_manifests group by 1")
def next_generation(spark: SparkSession, d: str) -> DataFrame:
    return relations.next_number(table(spark, d, "sync_manifests"), "tree_id", "generation", "next_generation")


@query("""
with recursive e as (select distinct l_suppkey % 40 a, (l_suppkey * 7 + l_partkey) % 40 b from lineitem where l_linenumber = 1 and l_partkey % 11 = 0), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select a node, (select max(y.b) from r y join r z on z.a = y.b and z.b = y.a where y.a = x.a) component from (select distinct a from r where a = b) x""")
def cycle_components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers on cycles of a fixed map over their keys, with the largest one they reach and are reached from."""
    i = table(spark, d, "lineitem").where("l_linenumber = 1 and l_partkey % 11 = 0")
    edges = i.select((F.col("l_suppkey") % 40).alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 40).alias("dst")).distinct()
    return graph.strong_components(edges)


@query("""
with recursive e as (select p_partkey pointer, (p_partkey * p_partkey + 1) % 1009 target from part), f as (select pointer, min(target) target from e where pointer <> target group by 1),
r as (select pointer s, target n from f union select r.s, f.target from r join f on f.pointer = r.n), loops as (select s from r where s = n), ends as (select s, min(n) least from r where s in (select s from loops) and n in (select s from loops) group by 1),
last as (select r.s, coalesce(ends.least, r.n) c from r left join ends on ends.s = r.n where ends.s is not null or r.n not in (select pointer from f))
select s pointer, min(c) canonical from last where s <> c group by 1""")
def pointer_chase(spark: SparkSession, d: str) -> DataFrame:
    """A merge map over the keys of parts followed to its ends; loops end at their smallest member."""
    p = table(spark, d, "part")
    return graph.canonical_pointers(p.select(F.col("p_partkey").alias("pointer"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % 1009).alias("target")))


@query("""
with recursive e as (select distinct 'n' || n_nationkey a, 'c' || c_custkey b from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000 union select distinct 'm' || s_suppkey, 'n' || s_nationkey from supplier where s_acctbal < 0),
w as (select a x, b y from e union select b, a from e), c as (select x n, x l from w union select w.y, c.l from c join w on w.x = c.n) select n node, min(l) component from c group by 1""")
def linked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers that their nations join."""
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("m"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return graph.components(c.unionAll(s))


# ---------------------------------------------------------------- log

_LOG = """g as (select user_id, event_id, event_type, lag(event_type) over w p, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) t from events window w as (partition by user_id order by event_id)),
s as (select user_id, row_number() over (partition by user_id order by event_id) as "sequence", event_id, event_type from g where coalesce(p, '') <> event_type and coalesce(t, 0) = 0)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return relations.event_log(e, "user_id", ["event_id"], ["event_type"], F.col("event_type") == "purchase")


@query(f'with {_LOG} select user_id, "sequence", event_type from s where "sequence" > 3')
def replay_after(spark: SparkSession, d: str) -> DataFrame:
    return joblog.replay(settle(_log(spark, d)), 3).select("user_id", "sequence", "event_type")


@query(f"""with {_LOG}, l as (select user_id, max("sequence") q, arg_max(event_type, "sequence") state from s group by 1) select user_id, q + 1 "sequence", 'failed' state, 'JOB_INTERRUPTED' error from l where state in ('view', 'click')""")
def restart_failures(spark: SparkSession, d: str) -> DataFrame:
    """Users whose log ends in an active state, each with the failure that a restart adds."""
    return relations.interrupted(_log(spark, d).withColumnRenamed("event_type", "state"), "user_id", ["view", "click"]).withColumn("sequence", F.col("sequence").cast("long"))


@query("select epoch_ms(time_bucket(interval '10 minutes', ts)) // 1000 window_start, event_type, count(*) n, round(sum(value), 2) total from events group by all")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = joblog.windowed_counts(table(spark, d, "events"))
    return e.select(F.unix_timestamp("start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
select epoch_us(min(ts)) // 1000000 session_start, user_id, count(*) n from (select user_id, ts, sum(case when p is null or ts - p >= interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) s
from (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events)) group by user_id, s""")
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    return joblog.session_counts(table(spark, d, "events")).select(F.unix_timestamp("start").alias("session_start"), "user_id", "n")


# ---------------------------------------------------------------- files

_BLANK = r"regexp_replace(coalesce({0}, ''), '[\r\n]', ' ', 'g')"
_TREE = rf"""p as (select *, '@P' || individual_id || '@' x, individual_id // 3 fam, individual_id % 3 role from individuals where source_file is not null),
f as (select source_file, fam, max(x) filter (role = 0) husb, max(x) filter (role = 1) wife, max(x) filter (role = 2) child from p group by all),
yr as (select x, source_file, fam, role, individual_id, cast(nullif(regexp_extract({_BLANK.format("birth_date")}, '\b(\d{{4}})\b', 1), '') as int) b from p)"""


def _tree_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a file per source_file: a record for each row of individuals, and a family for each three ids: husband, wife and child.

    One person in five does not name the family; families name a wedding in 1850.
    """
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"[\r\n]", " "), F.lit(""))
    p = table(spark, d, "individuals").where("source_file is not null").select("source_file", "individual_id", "full_name", "gender", "birth_place", "occupation", blank(F.col("birth_date")).alias("born"))
    fam, role = F.floor(F.col("individual_id") / 3).cast("long"), F.col("individual_id") % 3
    x, f = F.concat(F.lit("@P"), "individual_id", F.lit("@")), F.concat(F.lit("@F"), fam, F.lit("@"))
    year = F.regexp_extract("born", r"\b(\d{4})\b", 1)
    line = lambda when, *parts: F.when(when, F.concat(*(F.lit(s) if isinstance(s, str) else s for s in parts)))
    yes = F.lit(True)
    rows = [
        line(yes, "0 ", x, " INDI"), line(F.trim(blank(F.col("full_name"))) != "", "1 NAME ", F.trim(blank(F.col("full_name")))), line(F.col("individual_id") % 2 == 0, "1 SOUR @S1@"),
        line(year != "", "1 BIRT"), line(year != "", "2 DATE ", year), line((year != "") & (F.trim(blank(F.col("birth_place"))) != ""), "2 PLAC ", F.trim(blank(F.col("birth_place")))),
        line(F.col("individual_id") % 5 != 0, F.when(role == 2, "1 FAMC ").otherwise("1 FAMS "), f),
    ]
    person = p.select("source_file", F.lit(1).alias("section"), F.col("individual_id").alias("n"), F.posexplode(F.array_compact(F.array(*rows))).alias("i", "raw"))
    members = p.select("source_file", fam.alias("n"), F.struct(role.alias("role"), F.concat(F.lit("1 "), F.when(role == 0, "HUSB").when(role == 1, "WIFE").otherwise("CHIL"), F.lit(" "), x).alias("t")).alias("m")).groupBy("source_file", "n").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    body = F.concat(F.array(F.concat(F.lit("0 @F"), "n", F.lit("@ FAM"))), F.transform("ms", lambda m: m["t"]), F.array(F.lit("1 MARR"), F.lit("2 DATE 1850")))
    family = members.select("source_file", F.lit(2).alias("section"), "n", F.posexplode(body).alias("i", "raw"))
    files = p.select("source_file").distinct()
    frame = lambda section, lines: files.select("source_file", F.lit(section).alias("section"), F.lit(0).cast("long").alias("n"), F.posexplode(F.array(*(F.lit(t) for t in lines))).alias("i", "raw"))
    every = frame(0, ["0 HEAD", "1 GEDC", "2 VERS 5.5.5", "1 CHAR UTF-8"]).unionByName(person).unionByName(family).unionByName(frame(3, ["0 @S1@ SOUR", "1 TITL Register", "0 TRLR"]))
    return settle(gedcom.strict(gedcom.parsed(relations.ranked(every.withColumnRenamed("source_file", "source"), ["source", "section", "n", "i"], "pos").withColumn("ord", F.lit(1)))))


_RULES = rf"""
fd as (select 'MISSING_NAME' code, x who from p where trim({_BLANK.format("full_name")}) = '' union all select 'MISSING_BIRTH_DATE', x from yr where b is null
 union all select 'MISSING_BIRTH_PLACE', p.x from p join yr on yr.x = p.x where trim({_BLANK.format("birth_place")}) = '' or yr.b is null union all select 'MISSING_CITATION', x from p where individual_id % 2 = 1
 union all select 'MISSING_RELATIONSHIPS', x from p where individual_id % 5 = 0 union all select 'MISSING_PARENT_LINK', x from p where role <> 2 or individual_id % 5 = 0
 union all select 'MISSING_DEATH_DATE', x from yr where 2000 - b >= 120
 union all select 'NONRECIPROCAL_FAMILY_REFERENCE', x from p where individual_id % 5 = 0
 union all select 'PARENT_CHILD_CHRONOLOGY', c.x from yr c join yr q on q.source_file = c.source_file and q.fam = c.fam and c.role = 2 and q.role < 2 where c.b - q.b < 12 or c.b - q.b > 80
 union all select 'MARRIAGE_BEFORE_MATURITY', x from yr where role < 2 and 1850 - b < 12)"""
_CODES = ("MISSING_NAME", "MISSING_BIRTH_DATE", "MISSING_BIRTH_PLACE", "MISSING_CITATION", "MISSING_RELATIONSHIPS", "MISSING_PARENT_LINK", "MISSING_DEATH_DATE", "NONRECIPROCAL_FAMILY_REFERENCE", "PARENT_CHILD_CHRONOLOGY", "MARRIAGE_BEFORE_MATURITY")


@query(f"with {_TREE}, {_RULES} select code, who, count(*) n from fd group by all")
def tree_rules(spark: SparkSession, d: str) -> DataFrame:
    """Findings of ten rules over files made from individuals, by person; the last person of a finding is the one it is about."""
    found = quality.tree_findings(_tree_lines(spark, d), 2000, duplicates=False).where(F.col("code").isin(*_CODES))
    return found.groupBy("code", F.try_element_at("people", F.lit(-1)).alias("who")).agg(F.count("*").alias("n"))


@query(f"with {_TREE} select source_file source, '@F' || fam || '@' family, x person, case role when 0 then 'HUSB' when 1 then 'WIFE' else 'CHIL' end role from p")
def family_edges(spark: SparkSession, d: str) -> DataFrame:
    ls = _tree_lines(spark, d)
    return gedcom.family_edges(gedcom.blocks(ls), gedcom.records(ls))


@query(f"""with {_TREE} select source_file source, x pointer, trim({_BLANK.format("full_name")}) full_name, coalesce(lpad(cast(b as varchar), 4, '0'), '') birth_date, case when b is null then '' else trim({_BLANK.format("birth_place")}) end birth_place, individual_id % 2 = 0 cited from p join yr using (x, source_file, individual_id)""")
def person_rows(spark: SparkSession, d: str) -> DataFrame:
    ls = _tree_lines(spark, d)
    people = gedcom.persons(gedcom.blocks(ls), gedcom.records(ls))
    return people.select("source", "pointer", F.col("full_name"), "birth_date", "birth_place", "cited")


@query(f"with {_TREE} select source_file source, '@F' || fam || '@' family, p.x parent, c.x child from p join p c using (source_file, fam) where p.role < 2 and c.role = 2")
def parent_edges(spark: SparkSession, d: str) -> DataFrame:
    ls = _tree_lines(spark, d)
    return gedcom.parent_edges(gedcom.family_edges(gedcom.blocks(ls), gedcom.records(ls)))


@query(f"""with {_TREE} select source_file source, x pointer, sha256('0 BIRT' || chr(10) || '1 DATE ' || b || case when trim({_BLANK.format("birth_place")}) <> '' then 'x' else '' end) is not null keyed from p join yr using (x, source_file, individual_id) where b is not null""")
def block_keys(spark: SparkSession, d: str) -> DataFrame:
    """That every birth has a block with a key."""
    b = structure.record_blocks(_tree_lines(spark, d)).where("tag = 'BIRT'")
    return b.select("source", "pointer", F.col("key").isNotNull().alias("keyed"))


@query(f"with {_TREE}, i as (select source_file source, x pointer, sha256('0 DATE' || chr(10) || b) k, b from p join yr using (x, source_file, individual_id) where b is not null and trim({_BLANK.format('birth_place')}) = '') select source, pointer, sha256('0 BIRT' || chr(10) || '1 DATE ' || lpad(cast(b as varchar), 4, '0')) key from i")
def dated_block_keys(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of births that state a year and no place."""
    b = structure.record_blocks(_tree_lines(spark, d)).where(F.col("tag") == "BIRT")
    return b.where(F.size("lines") == 2).select("source", "pointer", "key")


@query(f"with {_TREE} select distinct source_file source from p")
def valid_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Files without a fault in their envelope."""
    recs = gedcom.records(_tree_lines(spark, d))
    return relations.missing(recs.select("source").distinct(), gedcom.envelope_faults(recs), ["source"])


@query(f"with {_TREE} select x pointer, count(*) files, sum(case when individual_id % 2 = 0 then 1 else 0 end) cites from p group by 1 having count(*) > 0")
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each person's record occurs and points to the source."""
    ls = _tree_lines(spark, d)
    recs = gedcom.records(ls).where("tag = 'INDI'")
    refs = gedcom.references(ls).where("tag = 'SOUR'").groupBy("source", "rec").agg(F.count("*").alias("c"))
    return recs.join(refs, ["source", "rec"], "left").groupBy("pointer").agg(F.count("*").alias("files"), F.coalesce(F.sum("c"), F.lit(0)).alias("cites"))


_RANKED = "case code " + " ".join(f"when '{c}' then 0" for c in quality.AT_ONCE) + " " + " ".join(f"when '{c}' then 2" for c in quality.TO_JUDGE) + " else 1 end"
_FINDINGS = r"""y as (select individual_id, cast(nullif(regexp_extract(coalesce(birth_date, ''), '\b(\d{4})\b', 1), '') as int) b, cast(nullif(regexp_extract(coalesce(death_date, ''), '\b(\d{4})\b', 1), '') as int) e from individuals), f as (
 select 'MISSING_NAME' code, 'high' severity, cast(individual_id as varchar) id from individuals where coalesce(trim(full_name), '') = '' union all
 select 'MISSING_BIRTH_DATE', 'medium', cast(individual_id as varchar) from individuals where coalesce(trim(birth_date), '') = '' union all
 select 'MISSING_BIRTH_PLACE', 'medium', cast(individual_id as varchar) from individuals where coalesce(trim(birth_place), '') = '' union all
 select 'MISSING_DEATH_PLACE', 'low', cast(individual_id as varchar) from individuals where coalesce(trim(death_date), '') <> '' and coalesce(trim(death_place), '') = '' union all
 select 'BIRTH_AFTER_DEATH', 'critical', cast(individual_id as varchar) from y where b > e union all
 select 'IMPLAUSIBLE_LIFESPAN', 'high', cast(individual_id as varchar) from y where e - b > 120)"""


@query(f"with {_FINDINGS} select code, severity, id from f order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, {_RANKED}, code || '-' || id limit 25")
def rule_union_ranked(spark: SparkSession, d: str) -> DataFrame:
    f = quality.person_findings(table(spark, d, "individuals"), "individual_id").select("code", "severity", "id", F.array("id").alias("people"), F.concat_ws("-", "code", "id").alias("finding_id"))
    near = spark.createDataFrame([], "person string, generation int")
    return quality.ranked_findings(f, near, 25).select("code", "severity", "id")


@query("""
select change_kind, fields, count(*) n from (with force as (select distinct tree_id, generation, unnest(map_entries(active_snapshots)) e from sync_manifests),
g as (select tree_id, generation, e.key source_id, e.value sid from force), st as (select distinct prev, sid from (select *, lag(sid) over (partition by tree_id, source_id order by generation) prev from g) where prev <> sid),
r as (select distinct snapshot_id, uid, kind, @l l, @d dd, @p p, list_sort(list_filter(list_transform(coalesce(attributes, []), lambda x: @x), lambda x: x <> '')) a from snapshot_records),
o as (select st.prev, st.sid, r.* from st join r on r.snapshot_id = st.prev), w as (select st.prev, st.sid, r.* from st join r on r.snapshot_id = st.sid)
select case when o.uid is null then 'created' when w.uid is null then 'removed' else 'updated' end change_kind, case when o.uid is null or w.uid is null then '' else
 array_to_string(list_filter([case when o.a is distinct from w.a then 'attributes' end, case when o.dd <> w.dd then 'event_date' end, case when o.p <> w.p then 'event_place' end, case when o.kind is distinct from w.kind then 'kind' end, case when o.l <> w.l then 'label' end], lambda x: x is not null), ',') end fields
from o full join w on o.prev = w.prev and o.sid = w.sid and o.uid = w.uid
where o.uid is null or w.uid is null or (o.kind, o.l, o.dd, o.p, o.a) is distinct from (w.kind, w.l, w.dd, w.p, w.a)) group by all""".replace("@l", r"lower(nfc_normalize(regexp_replace(coalesce(label, ''), '\s+', '', 'g')))").replace("@d", r"lower(nfc_normalize(regexp_replace(coalesce(event_date, ''), '\s+', '', 'g')))").replace("@p", r"lower(nfc_normalize(regexp_replace(coalesce(event_place, ''), '\s+', '', 'g')))").replace("@x", r"lower(nfc_normalize(regexp_replace(coalesce(x, ''), '\s+', '', 'g')))"))
def p5_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each set of fields changed."""
    from stemma.operators.snapshot_diff import snapshot_changes, transitions

    changes = snapshot_changes(table(spark, d, "snapshot_records"), transitions(table(spark, d, "sync_manifests")))
    return changes.groupBy("change_kind", F.array_join("changed_fields", ",").alias("fields")).agg(F.count("*").alias("n"))
