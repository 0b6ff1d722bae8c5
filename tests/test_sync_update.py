"""Snapshot sync end to end: generations over invented files."""

import pytest

from stemma.plans import sync
from stemma.sources import gedcom

HEAD = "0 HEAD\n1 DATE 5 MAY 2020\n1 GEDC\n2 VERS 5.5.5\n1 CHAR UTF-8\n"
MASTER = HEAD + """0 @I1@ INDI
1 NAME Ann /Gray/
1 SEX F
1 _UID 77
1 BIRT
2 DATE 1 JAN 1900
2 PLAC Ely, England
2 SOUR @S1@
3 PAGE 4
1 FAMS @F1@
0 @I2@ INDI
1 NAME Tom /Moor/
1 SEX M
1 BIRT
2 DATE 3 MAR 1890
2 PLAC York, England
1 FAMS @F1@
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
0 @S1@ SOUR
1 TITL Register
0 TRLR
"""
ONE = HEAD + """0 @X9@ INDI
1 NAME Ann /Gray/
1 SEX F
1 _UID 77
1 BIRT
2 DATE 01 JAN 1900
2 PLAC Ely, UK
2 SOUR @Q1@
3 PAGE 4
3 QUAY 2
1 OCCU smith
1 RESI
2 DATE 1921
2 SOUR @Q1@
1 FAMS @Y1@
0 @X8@ INDI
1 NAME Zelda /Stone/
1 SEX F
1 BIRT
2 DATE MAY 1930
2 PLAC Hull, England
0 @Y1@ FAM
1 WIFE @X9@
0 @Q1@ SOUR
1 TITL  Register
1 CHAN
2 DATE 1 JAN 2020
0 TRLR
"""
TWO = ONE.replace("1 OCCU smith\n", "").replace("1 RESI\n2 DATE 1921\n2 SOUR @Q1@\n", "").replace("X9", "Z1").replace("X8", "Z2")
THREE = TWO.replace("1 _UID 77\n", "1 _UID 77\n1 OCCU smith\n")


def text(spark, path):
    return "\n".join(r["value"] for r in spark.read.text(f"{path}/master").collect())


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sync")
    for name, t in (("m", MASTER), ("one", ONE), ("two", TWO), ("three", THREE)):
        (d / f"{name}.ged").write_text(t)
    root = f"file://{d}/releases"
    spec = lambda n: sync.Spec("tree-a", "ancestry", f"file://{d}/{n}.ged")
    first = sync.initialize(spark, root, "t", f"file://{d}/m.ged")
    second = sync.update(spark, root, [spec("one")])
    return d, root, spec, first, second


def test_first_update(spark, done):
    _, _, _, first, second = done
    assert (first.manifest.generation, second.manifest.generation) == (1, 2)
    t = text(spark, second.path)
    # Ann is found by her identifier, Zelda is new, nothing of Tom's is lost
    assert t.count("Ann /Gray/") == 1 and "0 @M_I1@ INDI" in t and "Zelda /Stone/" in t and t.count("1 NAME Tom /Moor/") == 1
    # one birth, whose citation was united with the richer one; equal sources are one record
    assert t.count("1 JAN 1900") == 1 and t.count("3 PAGE 4") == 1 and t.count("3 QUAY 2") == 1 and t.count(" SOUR\n1 TITL") == 1
    assert "1 OCCU smith" in t and "2 DATE 1921" in t
    said = {(r["section"], r["entry"].split(" ")[0]) for r in second.events.collect()}
    assert ("Added people", "tree-a:@X8@") in said and ("Mapped people", "tree-a:@X9@") in said and any(s == "Source records united" for s, _ in said)
    report = "\n".join(r["value"] for r in spark.read.text(f"{second.path}/update-report").collect())
    assert report.count("## ") == 14 and report.index("## Added people") < report.index("## Data removed") and "exported 05 MAY 2020 (HEAD.DATE)" in report
    assert second.manifest.next_ids["I"] == 2


def test_later_updates(spark, done):
    d, root, spec, _, second = done
    assert sync.update(spark, root, [spec("one")]).path is None
    dry = sync.update(spark, root, [spec("two")], dry_run=True)
    assert dry.path is None and dry.manifest.generation == 3
    third = sync.update(spark, root, [spec("two")])
    t = text(spark, third.path)
    # a vanished fact goes if no one cites it, and stays if someone does; the pointer of Zelda stays
    assert "1 OCCU smith" not in t and "2 DATE 1921" in t and t.count("0 @M_I1@ INDI") == 1 and "@M_I2@" not in t
    assert {r["section"] for r in third.events.where("section in ('Data removed', 'Gone from the snapshots but kept')").collect()} == {"Data removed", "Gone from the snapshots but kept"}
    with pytest.raises(sync.SyncError, match="belongs to ancestry"):
        sync.update(spark, root, [sync.Spec("tree-a", "geni", f"file://{d}/one.ged")])
    with pytest.raises(sync.SyncError, match="more than once"):
        sync.specs(spark, [spec("one"), spec("two")])
    # an edited master: a fact added by hand is protected, a deleted one needs consent and does not come back
    edited = text(spark, third.path).replace("1 NAME Tom /Moor/", "1 NAME Tom /Moor/\n1 OCCU miller").replace("1 BIRT\n2 DATE MAY 1930\n2 PLAC Hull, England\n", "")
    (d / "edited.ged").write_text(edited + "\n")
    with pytest.raises(sync.SyncError, match="consent"):
        sync.rebase(spark, root, f"file://{d}/edited.ged")
    fourth = sync.rebase(spark, root, f"file://{d}/edited.ged", True, "checked")
    assert fourth.manifest.generation == 4
    fifth = sync.update(spark, root, [spec("three")])
    t = text(spark, fifth.path)
    assert "1 OCCU miller" in t and "1 OCCU smith" in t and "MAY 1930" not in t
    assert fifth.events.where("section = 'Conflicts kept'").count() == 1


def test_allocation_skips_used(spark):
    items = spark.createDataFrame([(c, "I", c) for c in "cab"] + [("z", "F", "z")], "item string, prefix string, key string")
    used = spark.createDataFrame([("@M_I2@",), ("@M_I4@",), ("@M_I1@",), ("@I3@",), ("@M_F9@",)], "pointer string")
    got, counters = sync.allocate(items, used, {"I": 2, "F": 1, "X": 1})
    assert {r["item"]: r["pointer"] for r in got.collect()} == {"a": "@M_I3@", "b": "@M_I5@", "c": "@M_I6@", "z": "@M_F1@"}
    assert counters == {"I": 7, "F": 2, "X": 1}
    assert sync.allocate(items.limit(0), used, {"I": 2})[0].count() == 0


def test_files_of_one_name_and_budgets(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).mkdir()
        (tmp_path / n / "t.ged").write_text(HEAD + f"0 @I1@ INDI\n1 NAME {n} /X/\n0 TRLR\n")
    paths = [str(tmp_path / n / "t.ged") for n in "ab"]
    got = {(r["source"], r["ord"], f"NAME {n} " in r["text"]) for r in gedcom.read_texts(spark, paths).collect() for n in ("ab"[r["ord"] - 1],)}
    assert got == {("1/t.ged", 1, True), ("2/t.ged", 2, True)}
    assert gedcom.load(spark, paths).where("tag = 'INDI'").select("xref").distinct().count() == 2
    with pytest.raises(gedcom.GedcomError, match="bytes"):
        gedcom.read_texts(spark, paths, gedcom.Budget(file_bytes=10))
    with pytest.raises(gedcom.GedcomError, match="twice"):
        gedcom.read_texts(spark, [paths[0], paths[0]])
    ls = gedcom.lines(gedcom.read_texts(spark, paths))
    assert {(r["what"], r["value"]) for r in gedcom.over_budget(ls, gedcom.Budget(records=2, line_bytes=16)).collect()} == {("records", 3), ("line bytes", 17)}
