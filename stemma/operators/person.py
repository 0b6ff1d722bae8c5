"""Persons of parsed files with their facts and relatives, in the shape that scoring compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators.identity import PERSON, profile_keys
from stemma.sources import gedcom
from stemma.tables import settle

MOST_RELATIVES = 16  # fixed value: relatives of a role that take part in blocking
NAME_KEYS = r"^(sn|gn|name|name-exact|name-birth)\|"


def _ordered(items: Column, *fields: str) -> Column:
    """Collected structs in the order of their first field, without it, and once."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(items)), lambda x: F.struct(*(x[f].alias(f) for f in fields))))


def comparable(ls: DataFrame) -> DataFrame:
    """One row per person of namespaced lines, as identity.PERSON: names, vital events, facts, marriages, partners, parents and children.

    Relatives come from the families that list the person, in the order of the files; unknown pointers are dropped.
    """
    recs, bs = settle(gedcom.records(ls)), settle(gedcom.blocks(ls))
    people, fam, back = settle(gedcom.persons(bs, recs)), settle(gedcom.family_edges(bs, recs)), gedcom.person_edges(bs, recs)
    fs = settle(gedcom.facts(bs, recs))
    event = lambda tag, n: fs.where(F.col("tag") == tag).groupBy("pointer").agg(_ordered(F.struct("block", "value", "date", "place", "country"), "value", "date", "place", "country").alias(n))
    other = fs.where("tag not in ('BIRT', 'DEAT')").groupBy("pointer").agg(_ordered(F.struct("block", "tag", "value", "date", "place", "country"), "tag", "value", "date", "place", "country").alias("facts"))
    order = recs.where("tag = 'FAM'").select("source", F.col("pointer").alias("family"), F.col("rec").alias("fr"))
    edges = fam.join(order, ["source", "family"])
    who = people.select(F.col("pointer").alias("other"), F.col("full_name").alias("name"), "birth_date", "death_date", "birth_place", "death_place")
    shape = ("name", "birth_date", "death_date", "birth_place", "death_place", "relationship")

    def kin(mine: str, theirs: str, out: str, pedigree: bool = False) -> DataFrame:
        a = edges.where(f"role {mine}").select("source", "family", "fr", F.col("person").alias("pointer"))
        b = edges.where(f"role {theirs}").select("source", "family", F.col("person").alias("other"))
        j = a.join(b, ["source", "family"]).where("pointer != other").join(who, "other")
        if pedigree:
            child = back.where("role = 'FAMC'").select("source", "family", F.col("person").alias("pointer" if out == "parents" else "other"), F.col("pedigree").alias("relationship"))
            j = j.join(child, ["source", "family", "pointer" if out == "parents" else "other"], "left")
        else:
            j = j.withColumn("relationship", F.lit(""))
        item = F.struct("fr", "other", *(F.coalesce(c, F.lit("")).alias(c) for c in shape))
        return j.groupBy("pointer").agg(_ordered(item, *shape).alias(out))

    marriages = gedcom.facts(bs, recs, "FAM", gedcom.FAMILY_EVENT_TAGS).withColumnRenamed("pointer", "family")
    wed = edges.where("role in ('HUSB', 'WIFE')").join(marriages, ["source", "family"]).groupBy(F.col("person").alias("pointer")).agg(
        _ordered(F.struct("fr", "block", "tag", "value", "date", "place", "country"), "tag", "value", "date", "place", "country").alias("marriages")
    )
    spouse, child = "in ('HUSB', 'WIFE')", "= 'CHIL'"
    out = people.select("pointer", "source", F.array_distinct(F.filter(F.concat(F.array("full_name"), "alternate_names"), lambda n: n != "")).alias("names"), F.col("gender").alias("sex"))
    for extra in (event("BIRT", "birth"), event("DEAT", "death"), other, wed, kin(spouse, spouse, "partners"), kin(child, spouse, "parents", True), kin(spouse, child, "children", True)):
        out = out.join(extra, "pointer", "left")
    typed = out.sparkSession.createDataFrame([], PERSON).schema
    return out.select(*(F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if f.name not in ("pointer", "source", "sex") else F.col(f.name) for f in typed.fields))


def blocking_keys(people: DataFrame, comparable_people: DataFrame) -> DataFrame:
    """(pointer, source, key) from flat persons and their relatives: the profile, name keys of every other name, and the names of relatives by role."""
    profile = lambda surname, given, name: profile_keys(surname, given, *(F.col(c) for c in ("gender", "birth_date", "birth_place", "death_date", "death_place")), name)
    flat = people.select("pointer", "source", F.explode(profile(F.col("surname"), F.col("given"), F.col("full_name"))).alias("key"))
    # the last word of a displayed name is its surname
    others = people.withColumn("other", F.explode("alternate_names")).where("trim(other) != ''").withColumn("words", F.split(F.trim("other"), r"\s+"))
    named = profile(F.element_at("words", -1), F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.col("other"))
    flat = flat.unionAll(others.select("pointer", "source", F.explode(F.filter(named, lambda k: k.rlike(NAME_KEYS))).alias("key")))
    plain = lambda c, n: F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), 1, n)
    year = lambda d: F.coalesce(F.regexp_extract(d, r"\b(\d{4})\b", 1), F.lit(""))
    roles = None
    for role in ("partners", "parents", "children"):
        few = F.slice(F.col(role), 1, MOST_RELATIVES)
        keys = F.flatten(F.transform(few, lambda r: F.array(F.concat_ws("|", F.lit(role), plain(r["name"], 18)), F.concat_ws("|", F.lit(role), plain(r["name"], 12), year(r["birth_date"])))))  # noqa: B023
        one = comparable_people.select("pointer", "source", F.explode(F.array_distinct(keys)).alias("key"))
        roles = one if roles is None else roles.unionAll(one)
    return flat.unionAll(roles).distinct()
