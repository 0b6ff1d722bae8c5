import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemma.operators import quality
from stemma.sources import gedcom, gedcom_writer
from stemma.tables import settle

HEAD = "0 HEAD\n1 SOUR X\n1 GEDC\n2 VERS 5.5.5\n1 CHAR UTF-8\n1 SUBM @U1@\n0 @U1@ SUBM\n1 NAME Me\n"
TREE = (
    HEAD
    + """0 @I1@ INDI
1 NAME Ann /Gray/
2 TYPE birth
1 NAME Ann /Black/
2 TYPE married
1 SEX F
1 BIRT
2 DATE 31 FEB 1900
1 BIRT
2 DATE 1 JAN 1901
2 PLAC Ely, England
1 DEAT Y
2 DATE 1890
1 OCCU
1 RESI
2 ADDR 1 Road
3 CONT Left
2 CITY Ely
1 FAMC @F1@
2 PEDI adopted
1 FAMS @F9@
1 NOTE a long
2 CONC er note
2 CONT next
0 @I2@ INDI
1 NAME Bob /Gray/
1 SEX M
1 BIRT
2 DATE 1895
2 SOUR @S1@
1 FAMS @F1@
0 @I3@ INDI
0 @F1@ FAM
1 HUSB @I2@
1 CHIL @I1@
1 MARR
2 DATE 1900
0 @F2@ FAM
0 @S1@ SOUR
1 TITL Book
0 TRLR
"""
)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ged")
    (d / "a.ged").write_text("﻿" + TREE)
    (d / "b.ged").write_bytes((HEAD + "0 @I1@ INDI\n1 NAME Zed /Ö/\n1 FAMC @F1@\n0 TRLR\n").encode("utf-16"))
    return [str(d / "a.ged"), str(d / "b.ged")]


def test_records_facts_names(spark, tree):
    ls = gedcom.load(spark, tree).where("source = 'a.ged'").cache()
    recs, bs = gedcom.records(ls), gedcom.blocks(ls)
    assert recs.where("tag = 'INDI'").count() == 3
    people = {r["pointer"]: r for r in gedcom.persons(bs, recs).collect()}
    a = people["@I1@"]
    assert (a["given"], a["surname"], a["gender"], a["birth_date"], a["birth_place"], a["death_date"]) == ("Ann", "Gray", "F", "01 JAN 1901", "Ely, England", "1890")
    assert a["alternate_names"] == ["Ann Black"]
    assert people["@I2@"]["cited"] and not a["cited"]
    assert people["@I3@"]["full_name"] == ""
    f = {(r["tag"], r["date"]): r for r in gedcom.facts(bs, recs).where("pointer = '@I1@'").collect()}
    assert f["RESI", ""]["place"] == "1 Road\nLeft, Ely"
    assert f["DEAT", "1890"]["value"] == ""
    note = gedcom.continued(ls).where("tag = 'NOTE'").first()["text"]
    assert note == "a longer note\nnext"
    assert {(r["role"], r["pedigree"]) for r in gedcom.person_edges(bs, recs).where("person = '@I1@'").collect()} == {("FAMC", "adopted"), ("FAMS", "")}


def test_pointers_do_not_clash(spark, tree):
    ls = gedcom.load(spark, tree)
    b = {(r["tag"], r["xref"], r["value"]) for r in ls.where("source = 'b.ged'").collect()}
    assert ("INDI", "@I2_1@", "") in b
    # @F1@ is declared nowhere in b.ged and must not bind to the family of a.ged
    assert ("FAMC", "", "@F2_1@") in b
    declared = [r["xref"] for r in ls.where("xref != ''").collect()]
    assert len(declared) == len(set(declared))


def test_findings(spark, tree):
    ls = gedcom.strict(gedcom.lines(gedcom.read_texts(spark, tree[:1])))
    found = settle(quality.tree_findings(ls, 2024, "@I1@"))
    codes = {r["code"] for r in found.collect()}
    expected = {
        "MISSING_NAME", "INVALID_DATE", "ALTERNATIVE_VITAL_EVENTS", "MISSING_BIRTH_DATE", "MISSING_BIRTH_PLACE", "MISSING_DEATH_DATE", "MISSING_DEATH_PLACE", "MISSING_CITATION", "MISSING_RELATIONSHIPS",
        "MISSING_PARENT_LINK", "INCOMPLETE_OCCUPATION", "INCOMPLETE_RESIDENCE", "BIRTH_AFTER_DEATH", "PARENT_CHILD_CHRONOLOGY", "EMPTY_FAMILY", "MARRIAGE_BEFORE_MATURITY", "DANGLING_REFERENCE",
    }
    assert expected <= codes
    assert not {"ANCESTRY_CYCLE", "MISSING_HEAD", "DUPLICATE_XREF", "LEVEL_SKIP", "MALFORMED_XREF"} & codes
    # the same finding has the same id in every run
    ids = {r["code"]: r["finding_id"] for r in found.where("code = 'EMPTY_FAMILY'").collect()}
    digest = hashlib.sha256(b'["EMPTY_FAMILY",[],["@F2@"],[],["a.ged"]]').hexdigest()[:12]
    assert ids == {"EMPTY_FAMILY": f"empty-family-{digest}"}
    near = quality.generations(gedcom.parent_edges(gedcom.family_edges(gedcom.blocks(ls), gedcom.records(ls))), "@I1@")
    assert {(r["person"], r["generation"]) for r in near.collect()} == {("@I1@", 0), ("@I2@", 1)}
    text = quality.report(found, near)
    assert text.startswith("# Quality report") and text.count("\n| ") > 5


def test_possible_duplicates(spark):
    who = lambda n, name, born, died, place: f"0 @I{n}@ INDI\n1 NAME {name}\n1 SEX F\n1 BIRT\n2 DATE {born}\n2 PLAC {place}\n1 DEAT\n2 DATE {died}\n2 PLAC {place}\n"
    a = HEAD + who(1, "Ann /Gray/", "1 JAN 1900", "5 MAY 1980", "Ely, England") + who(2, "Anne /Gray/", "1 JAN 1900", "5 MAY 1980", "Ely, England") + who(3, "Zelda /Moor/", "2 FEB 1850", "1 APR 1911", "York, England") + "0 TRLR\n"
    b = HEAD + who(1, "Zelda /Moor/", "2 FEB 1850", "1 APR 1911", "York, England") + who(9, "Hugo /Lund/", "1700", "1750", "Oslo, Norway") + "0 TRLR\n"
    ls = gedcom.strict(gedcom.lines(spark.createDataFrame([("a.ged", 1, a), ("b.ged", 2, b)], "source string, ord int, text string")))
    got = {tuple(sorted(r["people"])): r for r in quality.tree_findings(ls, 2024).where("code = 'POSSIBLE_DUPLICATE'").collect()}
    # in one file, and over two files whose pointers clash
    assert set(got) == {("@I1@", "@I2@"), ("@I1@", "@I3@")}
    over = got["@I1@", "@I3@"]
    assert over["severity"] == "high" and over["source"] in ("a.ged, b.ged", "b.ged, a.ged") and got["@I1@", "@I2@"]["source"] == "a.ged"
    assert over["evidence"] == ["score: 100.00", "compared: name, birth date, birth place, birth country, death date, death place, death country, sex", "conflicts: none", "relatives: none"]
    text = json.dumps(["POSSIBLE_DUPLICATE", ["@I1@", "@I3@"], [], sorted(over["evidence"]), ["a.ged", "b.ged"]], separators=(",", ":"))
    assert over["finding_id"] == "possible-duplicate-" + hashlib.sha256(text.encode()).hexdigest()[:12]


def test_document_findings(spark):
    bad = "1 NAME x\n0 HEAD\n0 HEAD\n0 @bad xx\n"
    ls = gedcom.lines(spark.createDataFrame([("x.ged", 1, "0 HEAD\n2 VERS 5.5.1\n0 @1a@ NOTE\n0 @1a@ NOTE\n0 TRLR\n0 TRLR\n0 HEAD\n1 NOTE " + "y" * 300)], "source string, ord int, text string"))
    codes = {r["code"] for r in quality.tree_findings(gedcom.strict(ls), 2024).collect()}
    assert {"DUPLICATE_HEAD", "DUPLICATE_TRLR", "MISSING_TRLR", "DUPLICATE_XREF", "MALFORMED_XREF", "LEVEL_SKIP", "LONG_LINE", "MISSING_CHARSET", "MISSING_VERSION"} <= codes
    lines = gedcom.lines(spark.createDataFrame([("y.ged", 1, bad)], "source string, ord int, text string"))
    assert lines.where("bad").count() == 1
    with pytest.raises(Exception, match="Invalid GEDCOM line 4"):
        gedcom.strict(lines).collect()


def test_cycle(spark):
    from stemma.operators.graph import cycle_members

    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("b", "d"), ("d", "e")], "src string, dst string")
    assert {r[0] for r in cycle_members(e, e.selectExpr("src as node")).collect()} == {"a", "b"}


def test_round_trip(spark, tree, tmp_path):
    ls = gedcom.load(spark, tree)
    gedcom_writer.write_gedcom(ls, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    again = gedcom.lines(spark.createDataFrame([("out", 1, part.read_text())], "source string, ord int, text string"))
    assert gedcom_writer.faults(again).collect() == []
    want = {tuple(r) for r in ls.where("tag not in ('HEAD', 'TRLR') and rec > 1").select("level", "xref", "tag", "value").collect()}
    assert want <= {tuple(r) for r in again.select("level", "xref", "tag", "value").collect()}
    assert {r["fault"] for r in gedcom_writer.faults(again, "5.5.1").collect()} == {"VERSION"}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_characters="\r\n\x0b\x0c\x1c\x1d\x1e\x85  ", blacklist_categories=("Cs",)), max_size=700))
def test_wrapping_is_lossless(value):
    out = gedcom_writer.wrapped(1, "", "NOTE", value)
    assert all(len(x.encode()) <= 255 for x in out)
    assert out[0][len("1 NOTE ") :] + "".join(x[len("2 CONC ") :] for x in out[1:]) == value


def test_wrapping_limits():
    with pytest.raises(gedcom.GedcomError):
        gedcom_writer.wrapped(99, "", "NOTE", "x" * 300)
    assert gedcom_writer.wrapped(0, "@I1@", "INDI", "") == ["0 @I1@ INDI"]
    with pytest.raises(gedcom.GedcomError):
        gedcom.decode(b"\xff\xfe\x00\x00")


def test_valid_dates(spark):
    rows = [("31 FEB 1900", False), ("29 FEB 1904", True), ("29 FEB 1903", False), ("1900", True), ("", True), (None, True), ("soon", False), ("ABT 1 JAN 900", True), ("99 XXX 1900", False)]
    df = spark.createDataFrame(rows, "d string, ok boolean").withColumn("v", quality.valid_date(F.col("d")))
    assert [r["d"] for r in df.where("v != ok or v is null").collect()] == []
