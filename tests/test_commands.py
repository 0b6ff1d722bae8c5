import pytest

from stemma.operators import blocking, person
from stemma.plans import commands
from stemma.sources import gedcom, gedcom_writer

HEAD = "0 HEAD\n1 GEDC\n2 VERS 5.5.5\n1 CHAR UTF-8\n"


def indi(n, name, born, died, *more):
    return f"0 @I{n}@ INDI\n1 NAME {name}\n1 SEX F\n1 BIRT\n2 DATE {born}\n2 PLAC Ely, England\n1 DEAT\n2 DATE {died}\n2 PLAC York, England\n" + "".join(f"{m}\n" for m in more)


A = HEAD + indi(1, "Ann /Gray/", "1 JAN 1900", "5 MAY 1980", "1 FAMC @F1@", "1 SOUR @S1@") + indi(2, "Una /Gray/", "3 MAR 1870", "1 JAN 1950", "1 FAMS @F1@") + "0 @F1@ FAM\n1 WIFE @I2@\n1 CHIL @I1@\n0 @S1@ SOUR\n1 REPO @R1@\n0 @R1@ REPO\n1 NAME Shelf\n0 @S2@ SOUR\n1 TITL Unused\n0 TRLR\n"
B = HEAD + indi(1, "Ann /Gray/", "01 JAN 1900", "05 MAY 1980", "1 OCCU smith") + indi(7, "Zelda /Moor/", "1850", "1900") + "0 TRLR\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("merge")
    (d / "a.ged").write_text(A)
    (d / "b.ged").write_text(B)
    return [str(d / "a.ged"), str(d / "b.ged")]


def test_merge(spark, files, tmp_path):
    r = commands.merge(spark, files)
    assert r.merged == {"@I2_1@": "@I1@"}
    assert commands.accounting(r)["merged"] == 1
    gedcom_writer.write_gedcom(r.lines, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    lines = gedcom.lines(spark.createDataFrame([("out", 1, text)], "source string, ord int, text string"))
    assert gedcom_writer.faults(lines).collect() == []
    assert text.count("Ann /Gray/") == 1 and "1 OCCU smith" in text and "Zelda /Moor/" in text
    with pytest.raises(ValueError):
        commands.merge(spark, files[:1])


def test_subtree(spark, files):
    ls = gedcom.load(spark, files)
    got = {r["xref"] for r in commands.subtree(ls, "@I1@", "ancestors").where("xref != ''").collect()}
    assert got == {"@I1@", "@I2@", "@F1@", "@S1@", "@R1@"}
    with pytest.raises(ValueError):
        commands.subtree(ls, "nobody")


def test_every_name_has_keys(spark):
    a = HEAD + indi(1, "Ann /Gray/", "1900", "1980", "1 NAME Ann /Black/") + "0 TRLR\n"
    b = HEAD + "0 @I2@ INDI\n1 NAME Ann /Black/\n0 TRLR\n"
    ls = gedcom.strict(gedcom.lines(spark.createDataFrame([("a", 1, a), ("b", 2, b)], "source string, ord int, text string")))
    people = gedcom.persons(gedcom.blocks(ls), gedcom.records(ls))
    keyed = person.blocking_keys(people, person.comparable(ls))
    assert keyed.where("key = 'name-exact|annblack'").count() == 2
    assert {r["key"] for r in keyed.where("pointer = '@I1@' and key like 'name-birth|%'").collect()} == {"name-birth|gray|1900|F", "name-birth|black|1900|F"}
    assert {(r["l"], r["r"]) for r in blocking.owner_pairs(keyed, "pointer", "source").collect()} == {("@I1@", "@I2@")}
