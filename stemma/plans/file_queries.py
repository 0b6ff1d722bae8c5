"""Queries over files made from individuals, and over dates and places as typed, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import dates
from stemma.functions import places as country
from stemma.operators import person, quality
from stemma.plans.engine_queries import _BLANK, _TREE, _land, _tree_lines
from stemma.plans.queries import query
from stemma.sources import gedcom, gedcom_writer, structure
from stemma.tables import settle, table

_NAME = f"trim({_BLANK.format('full_name')})"
_PLACE = f"case when b is null then '' else trim({_BLANK.format('birth_place')}) end"
_YEAR = "coalesce(lpad(cast(b as varchar), 4, '0'), '')"
_PEOPLE = f"{_TREE}, q as (select p.*, b, {_NAME} nm, {_PLACE} pl, {_YEAR} yy from p join yr using (x, source_file, individual_id))"


@query(f"""with {_PEOPLE} select source_file source, x pointer, case when nm = '' then 'unnamed' else nm end || case when yy = '' and pl = '' then '' else '; born ' || concat_ws(' in ', nullif(yy, ''), nullif(pl, '')) end summary from q""")
def person_summaries(spark: SparkSession, d: str) -> DataFrame:
    ls = _tree_lines(spark, d)
    return structure.person_summary(gedcom.persons(gedcom.blocks(ls), gedcom.records(ls)))


@query(f"""with {_PEOPLE}, r as (select c.source_file s, c.x, 'parents' kind, o.x other, o.nm from q c join q o on o.source_file = c.source_file and o.fam = c.fam where c.role = 2 and o.role < 2
 union all select c.source_file, c.x, 'partners', o.x, o.nm from q c join q o on o.source_file = c.source_file and o.fam = c.fam and o.x <> c.x where c.role < 2 and o.role < 2
 union all select c.source_file, c.x, 'children', o.x, o.nm from q c join q o on o.source_file = c.source_file and o.fam = c.fam where c.role < 2 and o.role = 2)
select x pointer, coalesce(string_agg(nm, '|' order by other) filter (kind = 'parents'), '') parents, coalesce(string_agg(nm, '|' order by other) filter (kind = 'partners'), '') partners, coalesce(string_agg(nm, '|' order by other) filter (kind = 'children'), '') children from r group by 1""")
def relatives(spark: SparkSession, d: str) -> DataFrame:
    """The names of everyone's parents, partners and children, of those who have any."""
    p = person.comparable(_tree_lines(spark, d))
    names = lambda c: F.array_join(F.transform(c, lambda r: r["name"]), "|").alias(c)
    return p.where((F.size("parents") > 0) | (F.size("partners") > 0) | (F.size("children") > 0)).select("pointer", names("parents"), names("partners"), names("children"))


@query(f"""with {_PEOPLE} select source_file source, x pointer, 'BIRT' tag, yy date, pl place from q where b is not null union all select source_file, '@F' || fam || '@', 'MARR', '1850', '' from f""")
def fact_rows(spark: SparkSession, d: str) -> DataFrame:
    ls = _tree_lines(spark, d)
    recs, bs = gedcom.records(ls), gedcom.blocks(ls)
    both = gedcom.facts(bs, recs).unionByName(gedcom.facts(bs, recs, "FAM", gedcom.FAMILY_EVENT_TAGS))
    return both.select("source", "pointer", "tag", "date", "place")


@query(f"""with {_PEOPLE} select source_file source, tag, sum(n) n from (select source_file, case role when 2 then 'FAMC' else 'FAMS' end tag, 1 n from q where individual_id % 5 <> 0 union all select source_file, 'SOUR', 1 from q where individual_id % 2 = 0
 union all select source_file, case role when 0 then 'HUSB' when 1 then 'WIFE' else 'CHIL' end, 1 from q) group by all""")
def reference_tags(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.references(_tree_lines(spark, d)).groupBy("source", "tag").agg(F.count("*").alias("n"))


@query(f"""with {_PEOPLE}, o as (select source_file, dense_rank() over (order by source_file) ord from (select distinct source_file from p)), d as (select source_file, ord, x pointer, 'P' letter, individual_id n from p join o using (source_file)
 union all select source_file, ord, '@F' || fam || '@', 'F', fam from f join o using (source_file) union all select source_file, ord, '@S1@', 'S', 1 from o),
k as (select *, row_number() over (partition by pointer order by ord) k from d)
select source_file source, pointer, case when k = 1 then pointer else '@' || letter || ord || '_' || row_number() over (partition by source_file, letter, k > 1 order by n) || '@' end "global" from k""")
def global_pointers(spark: SparkSession, d: str) -> DataFrame:
    """The names that records of all files have side by side."""
    ls = _tree_lines(spark, d).drop("ord")
    order = ls.select("source").distinct().withColumn("ord", F.rank().over(Window.orderBy("source")))
    return gedcom.global_pointers(ls.join(F.broadcast(order), "source"))


@query(f"""with {_PEOPLE}, c as (select 'MISSING_NAME' code, source_file, x from q where nm = '' union all select 'MISSING_BIRTH_DATE', source_file, x from q where b is null union all select 'MISSING_CITATION', source_file, x from q where individual_id % 2 = 1
 union all select 'MISSING_RELATIONSHIPS', source_file, x from q where individual_id % 5 = 0)
select source_file source, code, lower(replace(code, '_', '-')) || '-' || substr(sha256('["' || code || '",["' || x || '"],[],[],["' || source_file || '"]]'), 1, 12) finding_id from c""")
def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the findings of four rules."""
    found = quality.tree_findings(_tree_lines(spark, d), 2000, duplicates=False)
    return found.where(F.col("code").isin("MISSING_NAME", "MISSING_BIRTH_DATE", "MISSING_CITATION", "MISSING_RELATIONSHIPS")).select("source", "code", "finding_id")


_UP = "upper(trim(birth_date))"
_DAY = rf"regexp_extract({_UP}, '\b(\d{{1,2}} [A-Z]{{3}} \d{{3,4}})\b', 1)"
_PADDED = f"lpad(string_split({_DAY}, ' ')[1], 2, '0') || ' ' || string_split({_DAY}, ' ')[2] || ' ' || lpad(string_split({_DAY}, ' ')[3], 4, '0')"


@query(rf"""select individual_id, case when coalesce({_UP}, '') = '' then true when not regexp_matches({_UP}, '\b\d{{3,4}}\b') then false when {_DAY} = '' then true else coalesce(try_strptime({_PADDED}, '%d %b %Y') is not null, false) end valid from individuals""")
def valid_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "individuals").select("individual_id", F.coalesce(quality.valid_date(F.col("birth_date")), F.lit(False)).alias("valid"))


_MONTH = "['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC']"
_FORMS = r"(regexp_matches(birth_date, '^\d{4}-\d{2}-\d{2}$') or regexp_matches(birth_date, '^\d{4}$') or regexp_matches(birth_date, '^\d{2}\.\d{2}\.\d{4}$') or regexp_matches(birth_date, '^\d{1,2} (JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC) \d{4}$'))"
_AS_DATE = r"case when birth_date like '____-%' then try_strptime(birth_date, '%Y-%m-%d') when birth_date like '%.%' then try_strptime(birth_date, '%d.%m.%Y') else try_strptime(birth_date, '%d %b %Y') end"


@query(f"""with t as (select individual_id, birth_date, {_AS_DATE} dd from individuals where birth_date is not null and {_FORMS})
select individual_id, case when length(birth_date) = 4 then birth_date when dd is null or birth_date like '0000%' then birth_date else lpad(cast(day(dd) as varchar), 2, '0') || ' ' || {_MONTH}[month(dd)] || ' ' || lpad(cast(year(dd) as varchar), 4, '0') end standard from t""")
def plain_dates_standard(spark: SparkSession, d: str) -> DataFrame:
    """Dates in four plain forms (2020-01-31, 31.01.2020, 31 JAN 2020, 2020) in the standard form; dates that the calendar lacks stay."""
    p = dates.with_normalized_dates(table(spark, d, "individuals").select("individual_id", "birth_date"), {"birth_date": "standard"})
    plain = F.col("birth_date").rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{4}$|^\d{2}\.\d{2}\.\d{4}$|^\d{1,2} (JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC) \d{4}$")
    return p.where(plain).select("individual_id", "standard")


@query(f"select individual_id, {_land('birth_place')} country from individuals")
def place_countries(spark: SparkSession, d: str) -> DataFrame:
    """The known country that the last part of a place names."""
    return table(spark, d, "individuals").select("individual_id", country.country_of_place(F.col("birth_place")).alias("country"))


@query(f"""with {_PEOPLE} select x xref, '0 ' || x || ' INDI' line from q union all select '@F' || fam || '@', '0 @F' || fam || '@ FAM' from f union all select '@S1@', '0 @S1@ SOUR' from (select distinct source_file from p)
 union all select '', t from (values ('0 HEAD'), ('0 TRLR')) v(t) union all select '@U1@', '0 @U1@ SUBM'""")
def written_records(spark: SparkSession, d: str) -> DataFrame:
    """The first line of every record that the writer makes of all files: one head and trailer, and a submitter."""
    out = gedcom_writer.file_lines(_tree_lines(spark, d).drop("bad"))
    return out.where(F.col("line").startswith("0 ")).select(F.regexp_extract("line", r"^0 (@[^@]+@)", 1).alias("xref"), "line")


@query(f"""with {_PEOPLE} select source_file source, x pointer, sha256('0 NAME ' || lower(trim(regexp_replace(nfc_normalize(nm), '\\s+', ' ', 'g')))) key from q where nm <> ''""")
def name_block_keys(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of names as structures, whatever their case and spacing."""
    b = structure.record_blocks(_tree_lines(spark, d)).where("tag = 'NAME'")
    return b.select("source", "pointer", "key")


@query(f"""with {_PEOPLE}, e as (select p.x child, o.x parent from q p join q o on o.source_file = p.source_file and o.fam = p.fam where p.role = 2 and o.role < 2), m as (select min(child) root from e)
select root person, 0 generation, 'self' parentage from m where root is not null union all select parent, 1, 'birth/unspecified' from e, m where child = root""")
def ancestor_parentage(spark: SparkSession, d: str) -> DataFrame:
    """The ancestors of the first child there is, and how they are parents."""
    ls = _tree_lines(spark, d)
    recs, bs = gedcom.records(ls), gedcom.blocks(ls)
    parents = settle(gedcom.parent_edges(gedcom.family_edges(bs, recs)))
    root = parents.agg(F.min("child")).first()[0]
    near = quality.generations(parents, root) if root else spark.createDataFrame([], "person string, generation int")
    return quality.parentage(parents, gedcom.person_edges(bs, recs), settle(near))
