import sqlite3

import pytest

from stemma.sources import gedcom_writer, sqlite_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    p = tmp_path_factory.mktemp("trees") / "t.rmtree"
    c = sqlite3.connect(p)
    c.executescript("""
    create table People (ID INTEGER PRIMARY KEY, Gender INTEGER, IsLiving INTEGER, "Favorite Thing" TEXT, Portrait BLOB);
    create table Names (NameID INTEGER PRIMARY KEY, OwnerID INTEGER, LastName TEXT, GivenName TEXT, PrimaryName INTEGER);
    create table Families (FamilyID INTEGER PRIMARY KEY, HusbandID INTEGER, WifeID INTEGER);
    create table ChildTable (FamilyID INTEGER, ChildID INTEGER);
    create table EventTable (EventID INTEGER PRIMARY KEY, OwnerID INTEGER, FamilyID INTEGER, EventType INTEGER, Date TEXT, PlaceID INTEGER, Details TEXT);
    create table FactTypeTable (FactTypeID INTEGER, Name TEXT, GedcomTag TEXT);
    create table PlaceTable (PlaceID INTEGER, Name TEXT);
    create table SourceTable (SourceID INTEGER PRIMARY KEY, Text TEXT);
    create table CitationTable (CitationID INTEGER, SourceID INTEGER, OwnerID INTEGER);
    insert into People values (1, 0, 0, 'a', x'00ff'), (2, 1, 0, null, null), (3, 0, 1, null, null), (4, 2, 0, null, null);
    insert into Names values (1, 1, 'Gray', 'Bob', 0), (2, 1, 'Grey', 'Robert', 1), (3, 2, 'Hill', 'Ann', 1), (4, 3, 'Gray', 'Kid', 1);
    insert into Families values (1, 1, 2), (2, 0, 4);
    insert into ChildTable values (1, 3);
    insert into EventTable values (1, 1, 0, 1, '1900', 5, ''), (2, 0, 1, 9, '1920', 0, 'wed'), (3, 3, 0, 1, '1930', 5, '');
    insert into FactTypeTable values (1, 'Birth', 'BIRT'), (9, 'Marriage', null);
    insert into PlaceTable values (5, 'Ely');
    insert into SourceTable values (1, 'ok'), (2, 'of the living'), (3, 'unused');
    insert into CitationTable values (1, 1, 1), (2, 2, 1), (3, 2, 3);
    """)
    c.commit()
    c.close()
    return str(p)


def test_source(spark, tree):
    df = sqlite_tree.read_table(spark, sqlite_tree.snapshot(tree), "people")
    rows = {r["ID"]: r for r in df.collect()}
    assert rows[1]["Portrait"] == b"\x00\xff" and rows[1]["Favorite Thing"] == "a" and rows[2]["Portrait"] is None
    assert sqlite_tree.read_table(spark, tree, "nothing") is None
    assert sqlite_tree.list_trees([tree.rsplit("/", 1)[0]]) == [tree]
    with pytest.raises(FileNotFoundError):
        sqlite_tree.resolve_tree("/etc/passwd", [tree.rsplit("/", 1)[0]])
    with pytest.raises(sqlite3.DatabaseError):
        sqlite_tree.open_read_only(tree).execute("delete from People")


def test_people_and_living(spark, tree):
    assert {(r["id"], r["given"], r["gender"]) for r in sqlite_tree.people(spark, tree).collect()} == {("1", "Robert", "M"), ("2", "Ann", "F"), ("4", None, "U")}
    assert {r["given"] for r in sqlite_tree.people(spark, tree, "redact").where("living").collect()} == {"Living"}
    assert sqlite_tree.people(spark, tree, "include").count() == 4


def test_scopes_events_sources(spark, tree):
    got = lambda k, g=None: {(r["node"], r["depth"]) for r in sqlite_tree.scope(spark, tree, "3", k, g).collect()}
    assert got("ancestors") == {("3", 0), ("1", 1), ("2", 1)}
    assert got("connected", 1) == {("3", 0), ("1", 1), ("2", 1)}
    ev = {r["id"]: r for r in sqlite_tree.events(spark, tree).collect()}
    assert (ev["1"]["tag"], ev["1"]["place"], ev["2"]["tag"], ev["2"]["owner_kind"]) == ("BIRT", "Ely", "MARR", "family")
    safe = sqlite_tree.people(spark, tree).select("id")
    assert [r["id"] for r in sqlite_tree.publishable_sources(spark, tree, safe).collect()] == ["1"]


def test_export(spark, tree):
    lines = sqlite_tree.export_lines(spark, tree)
    text = [r["line"] for r in gedcom_writer.file_lines(lines).orderBy("section", "ord", "rec", "pos", "i").collect()]
    assert text[0] == "0 HEAD" and text[-1] == "0 TRLR"
    assert "1 NAME Robert /Grey/" in text and "2 DATE 1900" in text and "2 PLAC Ely" in text
    assert "1 HUSB @I1@" in text and not any("Kid" in x or "CHIL" in x for x in text)
