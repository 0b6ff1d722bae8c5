"""Findings about the quality of family data: each rule is a filter or join that gives rows of one shape."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.dates import year_of
from stemma.operators import blocking, identity, person
from stemma.operators.graph import cycle_members, reach
from stemma.operators.relations import missing
from stemma.sources import gedcom
from stemma.tables import settle

# Severities in order, and the bounds of plausible lives.
SEVERITIES = ("critical", "high", "medium", "low")
LIFESPAN, YOUNGEST_PARENT, OLDEST_PARENT, YOUNGEST_SPOUSE = 120, 12, 80, 12
DUPLICATE_SCORE = 90


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def valid_date(text: Column) -> Column:
    """Whether a date names a year, and a full date one of the calendar; empty is valid."""
    up = F.upper(F.trim(text))
    full = F.regexp_extract_all(up, F.lit(r"\b(\d{1,2} [A-Z]{3} \d{3,4})\b"), F.lit(1))
    day = F.get(full, F.lit(0))
    # 31 FEB has no date; the year is padded so that three digits are read as such
    parts = F.split(day, " ")
    parsed = F.try_to_timestamp(F.concat_ws(" ", F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.initcap(F.get(parts, F.lit(1))), F.lpad(F.get(parts, F.lit(2)), 4, "0")), F.lit("dd MMM yyyy"))
    return F.when(F.coalesce(up, F.lit("")) == "", True).when(~up.rlike(r"\b\d{3,4}\b"), False).when(day.isNull(), True).otherwise(parsed.isNotNull() & (F.dayofmonth(parsed) == F.get(parts, F.lit(0)).cast("int")))


@F.pandas_udf(T.StringType())
def finding_id(code: pd.Series, people: pd.Series, families: pd.Series, evidence: pd.Series, sources: pd.Series) -> pd.Series:
    """The code in lower case and twelve digits of the hash of what the finding is about."""

    def one(c, p, f, e, s) -> str:  # noqa: ANN001
        text = json.dumps([c, sorted(p), sorted(f), sorted(e), sorted(s)], ensure_ascii=True, separators=(",", ":"))
        return f"{c.lower().replace('_', '-')}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"

    return pd.Series([one(*row) for row in zip(code, people, families, evidence, sources, strict=True)])


def person_findings(people: DataFrame, key: str) -> DataFrame:
    """(code, severity, id) of flat persons with full_name, birth and death dates and places; all rules in one pass over the rows."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    born, died = year_of(F.col("birth_date")), year_of(F.col("death_date"))
    rules = [
        ("MISSING_NAME", "high", blank("full_name")), ("MISSING_BIRTH_DATE", "medium", blank("birth_date")), ("MISSING_BIRTH_PLACE", "medium", blank("birth_place")),
        ("MISSING_DEATH_PLACE", "low", ~blank("death_date") & blank("death_place")), ("BIRTH_AFTER_DEATH", "critical", born > died), ("IMPLAUSIBLE_LIFESPAN", "high", died - born > LIFESPAN),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, test in rules)))
    return people.select(F.col(key).cast("string").alias("id"), F.explode(found).alias("f")).select("f.code", "f.severity", "id")


def _row(df: DataFrame, code: str, severity: str | Column, people: Column | None = None, families: Column | None = None, evidence: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (people if people is not None else none).alias("people"),
        (families if families is not None else none).alias("families"), (evidence if evidence is not None else none).alias("evidence"), F.col("source"), *more,
    )


def tree_findings(ls: DataFrame, as_of_year: int, root: str | None = None, duplicates: bool = True) -> DataFrame:
    """(code, severity, people, families, evidence, source, finding_id): every rule over the lines of parsed files.

    as_of_year stands for the present. root is the pointer of the person whose ancestors come first in reports. Without
    duplicates the search for possible duplicates, the costliest rule, is left out.
    """
    # every rule reads these; written once, none is parsed again
    ls = settle(ls)
    recs, bs = settle(gedcom.records(ls)), settle(gedcom.blocks(ls))
    people, fam, back = settle(gedcom.persons(bs, recs)), settle(gedcom.family_edges(bs, recs)), settle(gedcom.person_edges(bs, recs))
    me = F.array("pointer")
    text = lambda c: F.col(c) == ""
    born, died = year_of(F.col("birth_date")), year_of(F.col("death_date"))
    out = [
        _row(people.where(text("full_name")), "MISSING_NAME", "high", me), _row(people.where(text("birth_date")), "MISSING_BIRTH_DATE", "medium", me),
        _row(people.where(text("birth_place")), "MISSING_BIRTH_PLACE", "medium", me), _row(people.where(text("death_date") & (as_of_year - born >= LIFESPAN)), "MISSING_DEATH_DATE", "medium", me),
        _row(people.where(~text("death_date") & text("death_place")), "MISSING_DEATH_PLACE", "low", me), _row(people.where(~F.col("cited")), "MISSING_CITATION", "medium", me),
        _row(people.where(born > died), "BIRTH_AFTER_DEATH", "critical", me, evidence=F.array("birth_date", "death_date")),
        _row(people.where(died - born > LIFESPAN), "IMPLAUSIBLE_LIFESPAN", "high", me, evidence=F.array("birth_date", "death_date")),
    ]
    linked = back.select("source", F.col("person").alias("pointer"))
    out.append(_row(missing(people, linked, ["source", "pointer"]), "MISSING_RELATIONSHIPS", "low", me))
    orphan = missing(people, linked.join(back.where("role = 'FAMC'").select("source", F.col("person").alias("pointer")), ["source", "pointer"]), ["source", "pointer"])
    out.append(_row(orphan, "MISSING_PARENT_LINK", F.when(F.col("pointer") == F.lit(root), "medium").otherwise("low"), me))
    vital = settle(gedcom.facts(bs, recs, tags=("BIRT", "DEAT", "OCCU", "RESI")))
    out.append(_row(vital.where(F.col("tag").isin("BIRT", "DEAT") & ~valid_date(F.col("date"))), "INVALID_DATE", "high", me, evidence=F.array("date")))
    summary = F.concat_ws("|", "date", "place", "value")
    several = vital.where("tag in ('BIRT', 'DEAT')").groupBy("source", "pointer", "tag").agg(F.sort_array(F.collect_set(summary)).alias("s")).where(F.size("s") > 1)
    out.append(_row(several, "ALTERNATIVE_VITAL_EVENTS", "medium", me, evidence=F.col("s")))
    out.append(_row(vital.where("tag = 'OCCU' and value = ''"), "INCOMPLETE_OCCUPATION", "low", me))
    out.append(_row(vital.where("tag = 'RESI' and (date = '' or place = '')"), "INCOMPLETE_RESIDENCE", "low", me))
    # families
    fams = recs.where("tag = 'FAM' and pointer != ''").select("source", F.col("pointer").alias("family"))
    out.append(_row(missing(fams, fam, ["source", "family"]), "EMPTY_FAMILY", "high", families=F.array("family")))
    known = people.select("source", F.col("pointer").alias("person"))
    says = back.select("source", "person", "family", F.when(F.col("role") == "FAMC", "child").otherwise("spouse").alias("side"))
    told = fam.select("source", "person", "family", F.when(F.col("role") == "CHIL", "child").otherwise("spouse").alias("side"))
    one = told.join(known, ["source", "person"], "left_semi")
    out.append(_row(missing(one, says, ["source", "person", "family", "side"]), "NONRECIPROCAL_FAMILY_REFERENCE", "medium", F.array("person"), F.array("family")))
    two = says.join(fams, ["source", "family"], "left_semi")
    out.append(_row(missing(two, told, ["source", "person", "family", "side"]), "NONRECIPROCAL_PERSON_REFERENCE", "medium", F.array("person"), F.array("family")))
    years = people.select("source", F.col("pointer").alias("person"), born.alias("born"), died.alias("died"), "surname", "gender")
    parents = gedcom.parent_edges(fam)
    age = (
        parents.join(years.select("source", F.col("person").alias("parent"), F.col("born").alias("pb")), ["source", "parent"])
        .join(years.select("source", F.col("person").alias("child"), F.col("born").alias("cb")), ["source", "child"])
        .where((F.col("cb") - F.col("pb") < YOUNGEST_PARENT) | (F.col("cb") - F.col("pb") > OLDEST_PARENT))
    )
    out.append(_row(age, "PARENT_CHILD_CHRONOLOGY", "high", F.array("parent", "child"), F.array("family")))
    marr = gedcom.facts(bs, recs, "FAM", ("MARR",)).withColumnRenamed("pointer", "family")
    out.append(_row(marr.where(~valid_date(F.col("date"))), "INVALID_MARRIAGE_DATE", "high", families=F.array("family"), evidence=F.array("date")))
    spouses = fam.where("role in ('HUSB', 'WIFE')").join(years, ["source", "person"])
    wed = marr.select("source", "family", year_of(F.col("date")).alias("wed"), "date").join(spouses, ["source", "family"])
    out.append(_row(wed.where(F.col("wed") - F.col("born") < YOUNGEST_SPOUSE), "MARRIAGE_BEFORE_MATURITY", "high", F.array("person"), F.array("family"), F.array("date")))
    out.append(_row(wed.where(F.col("wed") > F.col("died")), "MARRIAGE_AFTER_DEATH", "critical", F.array("person"), F.array("family"), F.array("date")))
    out.append(_row(_married_names(bs, recs, fam, parents, years), "POSSIBLE_MARRIED_PRIMARY_NAME", F.col("sev"), F.array("person")))
    # ancestry, keyed by file and person so that files do not meet
    up = parents.select(F.concat_ws("\x1f", "source", "child").alias("src"), F.concat_ws("\x1f", "source", "parent").alias("dst")).distinct()
    loops = cycle_members(up, up.select(F.col("src").alias("node")).distinct()).select(F.get(F.split("node", "\x1f"), F.lit(0)).alias("source"), F.get(F.split("node", "\x1f"), F.lit(1)).alias("person"))
    out.append(_row(loops, "ANCESTRY_CYCLE", "critical", F.array("person")))
    out += _document_findings(ls, recs)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    every = every.withColumn("sources", F.array("source"))
    if duplicates:
        every = every.unionByName(_duplicates(ls))
    return every.withColumn("finding_id", finding_id("code", "people", "families", "evidence", "sources")).drop("sources")


def _duplicates(ls: DataFrame) -> DataFrame:
    """Pairs of persons, of one file or of several, whose score is high; nothing is merged. Also has `sources`, one for each person.

    Candidates share a key that at most blocking.Limits.bucket persons have. Pointers may clash over the files, so they get
    global names meanwhile.
    """
    given = settle(gedcom.global_pointers(ls))
    own = settle(gedcom.renamed(ls, given))
    people = settle(person.comparable(own))
    keyed = person.blocking_keys(gedcom.persons(gedcom.blocks(own), gedcom.records(own)), people)
    scored = identity.score_pairs(blocking.owner_pairs(keyed, "pointer").select("l", "r"), people, DUPLICATE_SCORE)
    for side in ("l", "r"):
        partners = people.select(F.col("pointer").alias(side), F.filter(F.col("partners.name"), lambda n: n != "").alias(f"{side}_partners"))
        names = given.select(F.col("global").alias(side), F.col("source").alias(f"{side}_source"), F.col("pointer").alias(f"{side}_pointer"))
        scored = scored.join(partners, side).join(names, side)
    listed = lambda items: F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("none")
    evidence = F.array(
        F.concat(F.lit("score: "), F.format_string("%.2f", F.col("score"))), F.concat(F.lit("compared: "), F.array_join("fields", ", ")), F.concat(F.lit("conflicts: "), listed(F.col("conflicts"))),
        F.concat(F.lit("relatives: "), listed(F.concat("l_partners", "r_partners"))),
    )
    sources = F.array("l_source", "r_source")
    both = scored.withColumn("source", F.array_join(F.array_distinct(sources), ", ")).withColumn("sources", sources)
    return _row(both, "POSSIBLE_DUPLICATE", "high", F.array("l_pointer", "r_pointer"), evidence=evidence, more=("sources",)).distinct()


def _married_names(bs: DataFrame, recs: DataFrame, fam: DataFrame, parents: DataFrame, years: DataFrame) -> DataFrame:
    """Primary names that are said to be married, or that equal a spouse's surname and differ from all parents'."""
    typed = gedcom.names(bs, recs).where("is_primary and name_type = 'married'").select("source", F.col("pointer").alias("person"), F.lit("high").alias("sev"))
    s = fam.where("role in ('HUSB', 'WIFE')").select("source", "family", "person", "role")
    o = s.select("source", "family", F.col("person").alias("other"))
    mine = years.select("source", "person", F.lower("surname").alias("own"), "gender")
    theirs = years.select("source", F.col("person").alias("other"), F.lower("surname").alias("spouse_name"))
    pairs = s.join(o, ["source", "family"]).where("person != other").join(mine, ["source", "person"]).join(theirs, ["source", "other"]).where("own != '' and own = spouse_name")
    born_as = parents.join(years.select("source", F.col("person").alias("parent"), F.lower("surname").alias("p")), ["source", "parent"]).where("p != ''")
    of = born_as.groupBy("source", F.col("child").alias("person")).agg(F.collect_set("p").alias("ps"))
    differ = pairs.join(of, ["source", "person"]).where(~F.array_contains("ps", F.col("own")))
    sev = F.when(F.col("gender") == "F", "medium").when((F.col("gender") == "") & (F.col("role") == "WIFE"), "low")
    inferred = differ.select("source", "person", sev.alias("sev")).where("sev is not null").distinct()
    return typed.unionByName(missing(inferred, typed, ["source", "person"]))


def _document_findings(ls: DataFrame, recs: DataFrame) -> list[DataFrame]:
    """Rules about the files themselves: envelope, head fields, pointers and lines."""
    faults = gedcom.envelope_faults(recs)
    out = [_row(faults.where(F.col("fault") == c), c, "high") for c in ("DUPLICATE_HEAD", "DUPLICATE_TRLR", "MISSING_HEAD", "MISSING_TRLR")]
    w = Window.partitionBy("source").orderBy("pos")
    rec_tag = F.first("tag").over(Window.partitionBy("source", "rec").orderBy("pos"))
    under = F.last(F.when(F.col("level") == 1, F.col("tag")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    head = ls.withColumn("rec_tag", rec_tag).withColumn("under", under).groupBy("source").agg(
        F.max(F.when((F.col("rec_tag") == "HEAD") & (F.col("level") == 1) & (F.col("tag") == "CHAR"), F.upper(F.trim("value")))).alias("charset"),
        F.max(F.when((F.col("rec_tag") == "HEAD") & (F.col("level") == 2) & (F.col("under") == "GEDC") & (F.col("tag") == "VERS"), F.trim("value"))).alias("version"),
    )
    out += [
        _row(head.where("charset is null"), "MISSING_CHARSET", "medium"), _row(head.where("charset != 'UTF-8'"), "PORTABILITY_CHARSET", "medium", evidence=F.array("charset")),
        _row(head.where("version is null"), "MISSING_VERSION", "medium"), _row(head.where("version not in ('5.5.1', '5.5.5')"), "PORTABILITY_VERSION", "medium", evidence=F.array("version")),
    ]
    twice = recs.where("pointer != ''").groupBy("source", "pointer").count().where("count > 1")
    out.append(_row(twice, "DUPLICATE_XREF", "high", evidence=F.array("pointer")))
    x = ls.where("xref != ''")
    out.append(_row(x.where((F.length("xref") > 22) | ~F.col("xref").rlike(r"^@[A-Za-z_][A-Za-z0-9_:-]*@$")), "MALFORMED_XREF", "high", evidence=F.array("xref")))
    skip = ls.withColumn("before", F.coalesce(F.lag("level").over(w), F.lit(0))).where(F.col("level") > F.col("before") + 1)
    out.append(_row(skip, "LEVEL_SKIP", "high", evidence=F.array(F.col("pos").cast("string"))))
    out.append(_row(ls.where(F.octet_length("raw") > 255), "LONG_LINE", "medium", evidence=F.array(F.col("pos").cast("string"))))
    refs = gedcom.references(ls).select("source", "pointer").distinct()
    declared = recs.where("pointer != ''").select("source", "pointer")
    out.append(_row(missing(refs, declared, ["source", "pointer"]), "DANGLING_REFERENCE", "high", evidence=F.array("pointer")))
    return out


def generations(parents: DataFrame, root: str) -> DataFrame:
    """(person, generation): the root's ancestors and the fewest steps to each."""
    spark = parents.sparkSession
    edges = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    return reach(edges, spark.createDataFrame([(root,)], "node string")).select(F.col("node").alias("person"), F.col("depth").alias("generation"))


# Findings that can be mended at once, and those that a person must judge; others are for research.
AT_ONCE = (
    "ANCESTRY_CYCLE", "BIRTH_AFTER_DEATH", "DANGLING_REFERENCE", "DUPLICATE_HEAD", "DUPLICATE_TRLR", "EMPTY_FAMILY", "INVALID_DATE", "INVALID_MARRIAGE_DATE", "LEVEL_SKIP", "MARRIAGE_AFTER_DEATH",
    "MISSING_HEAD", "MISSING_TRLR", "NONRECIPROCAL_FAMILY_REFERENCE", "NONRECIPROCAL_PERSON_REFERENCE",
)
TO_JUDGE = ("ALTERNATIVE_VITAL_EVENTS", "POSSIBLE_DUPLICATE", "POSSIBLE_MARRIED_PRIMARY_NAME")


def actionability(code: Column) -> Column:
    return F.when(code.isin(*AT_ONCE), 0).when(code.isin(*TO_JUDGE), 2).otherwise(1)


def parentage(parents: DataFrame, back: DataFrame, near: DataFrame) -> DataFrame:
    """(person, generation, parentage): how each ancestor of the root is a parent: the pedigrees of the links to children one generation nearer.

    parents has family, parent and child, back person, family, role and pedigree, near person and generation. A link without a
    pedigree is `birth/unspecified`, the root is `self`.
    """
    child = near.select(F.col("person").alias("child"), F.col("generation").alias("g"))
    link = parents.join(child, "child").join(near.select(F.col("person").alias("parent"), F.col("generation").alias("pg")), "parent").where("pg = g + 1")
    said = back.where("role = 'FAMC'").groupBy(F.col("person").alias("child"), "family").agg(F.max(F.when(F.col("pedigree") != "", F.col("pedigree"))).alias("pedigree"))
    how = link.join(said, ["child", "family"], "left").select("parent", F.coalesce("pedigree", F.lit("birth/unspecified")).alias("how")).distinct().groupBy(F.col("parent").alias("person")).agg(F.array_join(F.array_sort(F.collect_list("how")), ", ").alias("how"))
    return near.join(how, "person", "left").select("person", "generation", F.when(F.col("generation") == 0, "self").otherwise(F.coalesce("how", F.lit("birth/unspecified"))).alias("parentage"))


def ranked_findings(findings: DataFrame, ancestors: DataFrame, top: int = 25) -> DataFrame:
    """The first `top` findings: by severity, ancestors of the root first, nearer generations first, what can be mended at once first, then by id."""
    near = findings.select("finding_id", F.explode("people").alias("person")).join(ancestors, "person").groupBy("finding_id").agg(F.min("generation").alias("generation"))
    joined = findings.join(near, "finding_id", "left").withColumn("generation", F.coalesce("generation", F.lit(10_000)))
    return joined.orderBy(severity_rank(F.col("severity")), F.col("generation") == 10_000, "generation", actionability(F.col("code")), "finding_id").limit(top)


SECTIONS = (("High-confidence possible duplicates", ("POSSIBLE_DUPLICATE",)), ("Possible married names as primary names", ("POSSIBLE_MARRIED_PRIMARY_NAME",)))
STRUCTURAL = (
    "DUPLICATE_HEAD", "DUPLICATE_TRLR", "MISSING_HEAD", "MISSING_TRLR", "MISSING_CHARSET", "PORTABILITY_CHARSET", "MISSING_VERSION", "PORTABILITY_VERSION", "DUPLICATE_XREF", "MALFORMED_XREF", "LEVEL_SKIP",
    "LONG_LINE", "DANGLING_REFERENCE",
)
#: Findings that a section of a report shows, and rows that a resolver is asked about.
SHOWN, ASKED = 500, 25


def _escape(text: object) -> str:
    return str(text).replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ").strip()


def _table(df: DataFrame, ancestors: DataFrame, most: int, notes: dict[str, tuple[str, list[str]]]) -> list[str]:
    rows = ranked_findings(df, ancestors, most + 1).collect()
    if not rows:
        return ["No findings in this section.", ""]
    out = ["| Severity | Finding | Code | People | Families | Evidence |", "|---|---|---|---|---|---|"]
    for r in rows[:most]:
        why, research = notes.get(r["finding_id"], ("", []))
        told = "; ".join([*r["evidence"], *([f"why: {why}"] if why else []), *([f"research: {'; '.join(research)}"] if research else [])])
        out.append("| " + " | ".join(map(_escape, (r["severity"].upper(), r["finding_id"], r["code"], ", ".join(r["people"]), ", ".join(r["families"]), told))) + " |")
    return [*out, *(["", f"Only the first {most} are shown; the table of findings has all."] if len(rows) > most else []), ""]


def report(findings: DataFrame, ancestors: DataFrame, top: int = 25, relations: DataFrame | None = None, decisions: DataFrame | None = None, notes: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """A Markdown report: counts by severity, the first actions, ancestors by generation, and sections by kind of finding, then merge decisions.

    relations is what parentage gives, decisions has l, r, score, disposition and evidence, notes what a resolver says of
    findings. A section shows its first SHOWN rows and says so if there are more.
    """
    # read by every section
    findings, ancestors, notes = settle(findings), settle(ancestors), notes or {}
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    text = ["# Quality report", "", "## Summary", "", "| Severity | Findings |", "|---|---|", *(f"| {s} | {counts.get(s, 0)} |" for s in SEVERITIES), "", f"## First {top} actions", "", *_table(findings, ancestors, top, notes)]
    text += ["## Direct ancestors by generation", "", "| Generation | Person | Parentage |", "|---:|---|---|"]
    for r in relations.orderBy("generation", "person").limit(SHOWN).collect() if relations is not None else ():
        text.append(f"| {r['generation']} | {_escape(r['person'])} | {_escape(r['parentage'])} |")
    direct = findings.join(findings.select("finding_id", F.explode("people").alias("person")).join(ancestors, "person").select("finding_id").distinct(), "finding_id", "left_semi")
    text += ["", *_table(direct, ancestors, SHOWN, notes)]
    special = [c for _, codes in SECTIONS for c in codes]
    kinds = [*((t, F.col("code").isin(*c)) for t, c in SECTIONS), ("General quality", ~F.col("code").isin(*special, *STRUCTURAL)), ("Files and their structure", F.col("code").isin(*STRUCTURAL))]
    for title, some in kinds:
        text += [f"## {title}", "", *_table(findings.where(some), ancestors, SHOWN, notes)]
    text += ["## Merge decisions", ""]
    rows = decisions.orderBy(F.desc("score"), "l", "r").limit(SHOWN).collect() if decisions is not None else []
    text += ["| Pair | Score | Disposition | Evidence |", "|---|---:|---|---|", *(f"| {_escape(r['l'])} / {_escape(r['r'])} | {r['score']:.2f} | {_escape(r['disposition'])} | {_escape(r['evidence'])} |" for r in rows)] if rows else ["None were needed."]
    return "\n".join(text).rstrip() + "\n"


def annotations(answer: object, allowed: set[str]) -> dict[str, tuple[str, list[str]]]:
    """(why, research) for each finding that an answer {"annotations": [...]} may speak of: known ids only, the first of each, texts cut at 2000 and 500, five suggestions."""
    items = answer.get("annotations") if isinstance(answer, dict) else None
    if not isinstance(items, list):
        raise ValueError("annotations must be a list")
    out: dict[str, tuple[str, list[str]]] = {}
    for item in items[:ASKED]:
        if not isinstance(item, dict) or not isinstance(item.get("research_suggestions", []), list):
            raise ValueError("an annotation must be an object with a list of suggestions")
        key = str(item.get("finding_id", ""))
        if key in allowed and key not in out:
            out[key] = (str(item.get("why_this_matters", ""))[:2000].strip(), [str(s)[:500].strip() for s in item.get("research_suggestions", [])[:5] if str(s).strip()])
    return out


def annotate(findings: DataFrame, ancestors: DataFrame, resolver) -> dict[str, tuple[str, list[str]]]:  # noqa: ANN001
    """What a resolver says of the first findings; it gets only those rows, and can neither change nor drop a finding."""
    rows = [r.asDict(True) for r in ranked_findings(findings, ancestors, ASKED).collect()]
    return annotations(resolver(rows), {r["finding_id"] for r in rows}) if rows else {}


def parse_diagnostic(source: str, error: BaseException) -> str:
    """A Markdown report on a file that could not be read: where, why, and that nothing was written."""
    text = str(error)
    line = re.search(r"(?:line|level)\s+(\d+)", text, re.I)
    rows = (f"- File: `{_escape(source)}`", f"- Line: {line[1] if line else 'unknown'}", f"- Fault: {_escape(text)}", "- What to do: mend the line, check the file and run again.")
    return "\n".join(["# Diagnostic report", "", "The file was refused before anything was written.", "", *rows]) + "\n"
