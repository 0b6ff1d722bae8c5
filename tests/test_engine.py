"""Operators of the engine on small cases: values, structures, graphs, reports, stores, writing."""

import random
import threading
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from stemma.functions import dates, normal
from stemma.operators import graph, identity, quality, relations, sync
from stemma.plans import commands, jsons, sqlgate, stores
from stemma.sources import gedcom, gedcom_writer, sqlite_tree, structure
from stemma.streaming import joblog

HEAD = "0 HEAD\n1 GEDC\n2 VERS 5.5.5\n1 CHAR UTF-8\n"


def lines(spark, *texts):
    return gedcom.strict(gedcom.lines(spark.createDataFrame([(chr(97 + i), i + 1, t) for i, t in enumerate(texts)], "source string, ord int, text string")))


def test_values_by_tag(spark):
    rows = [("DATE", "1 Jan 1900", "01 JAN 1900"), ("PLAC", "Ely. ,  Cambs; , USA", "ely,cambs,united states"), ("NAME", "Ann  /GRAY/", "ann /gray/"), ("SEX", " F ", "f"), ("NOTE", "As  Is", "As Is"), ("CTRY", "England", "united kingdom"), ("NAME", None, ""), ("NAME", "Éva", "éva")]
    got = normal.with_normal_values(spark.createDataFrame(rows, "t string, v string, want string"), "t", "v", "n").collect()
    assert [r["n"] for r in got] == [r["want"] for r in got]


def test_confidences_and_prefixes(spark):
    texts = ["0.5", " 1 ", "1.01", "-0.1", "true", "nan", "Infinity", "x", None, "1e-1", "0"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normal.confidence(F.col("t"))).collect()]
    assert got == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.0]
    r = random.Random(3)
    words = ["".join(r.choice("aé√𐍈") for _ in range(r.randint(0, 30))) for _ in range(200)]
    cut = spark.createDataFrame([(w,) for w in words], "w string").select("w", normal.byte_prefix(F.col("w"), 20).alias("p")).collect()
    for x in cut:
        n = max(i for i in range(len(x["w"]) + 1) if len(x["w"][:i].encode()) <= 20)
        assert x["p"] == x["w"][:n]


def test_cells(spark):
    df = spark.sql("select unhex('00FF') b, double('nan') d, 2 i, array(1) a, cast(null as binary) n")
    assert tuple(normal.cells(df).first()) == ('{"data":"AP8=","encoding":"base64"}', '{"data":"nan","encoding":"float"}', "2", "[1]", None)
    with pytest.raises(ValueError):
        normal.cells(spark.sql("select 1 a, 2 a"))


def test_gate_leaves_texts_alone(spark, tmp_path):
    for n in ("nation", "region"):
        spark.range(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    d = f"file://{tmp_path}"
    assert sqlgate.run(spark, d, "select count(*) n from nation, region").first()["n"] == 9
    assert sqlgate.run(spark, d, "select 'goods from nation x' t from region r join nation on r.id = nation.id").first()["t"] == "goods from nation x"
    assert sqlgate.run(spark, d, "with recursive r(i) as (select 1 union all select i + 1 from r where i < 4) select count(*) n from r").first()["n"] == 4


def test_questions(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "t.parquet"))
    d, seen = f"file://{tmp_path}", []
    sql, r = sqlgate.question(spark, d, "how many?", lambda q, s: seen.append((q, s)) or {"sql": "select count(*) n from t"})
    assert (sql, r.rows.first()["n"], seen) == ("select count(*) n from t", 7, [("how many?", {"t": ["id bigint"]})])
    for bad in ("drop table t", "", None, {"sql": 3}):
        with pytest.raises(sqlgate.SqlRejected):
            sqlgate.question(spark, d, "?", lambda q, s, bad=bad: bad)


def test_stream_state_carries_on(spark, tmp_path):
    for n in range(3):
        blocks = [("p", f"h{n}", n), *([("p", "twice", n)] if n < 2 else [])]
        spark.createDataFrame(blocks, "person string, hash string, generation int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("person string, hash string, generation int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    dead = spark.createDataFrame([("h2",)], "hash string")
    joblog.apply_snapshots(stream, str(tmp_path / "state"), str(tmp_path / "cp"), dead).awaitTermination()
    got = {r["hash"]: (r["first_generation"], r["last_generation"], r["observations"]) for r in spark.read.parquet(str(tmp_path / "state/generation=2")).collect()}
    assert got == {"h0": (0, 0, 1), "h1": (1, 1, 1), "twice": (0, 1, 2)}


def test_separators_in_snapshots(spark):
    from stemma.operators.snapshot_diff import snapshot_changes

    rows = [("s1", "u", "k", "a\x01b", "c", None, None), ("s2", "u", "k", "a", "b\x01c", None, None), ("s1", "v", "k", "x", None, None, ["p\x02q"]), ("s2", "v", "k", "x", None, None, ["q", "p"])]
    df = spark.createDataFrame(rows, "snapshot_id string, uid string, kind string, label string, event_date string, event_place string, attributes array<string>")
    got = {r["uid"]: r["changed_fields"] for r in snapshot_changes(df, spark.createDataFrame([("s1", "s2")], "prev_snapshot_id string, snapshot_id string")).collect()}
    assert got == {"u": ["event_date", "label"], "v": ["attributes"]}


def closure(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    for a in list(reach):
        seen, stack = set(), list(reach[a])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(reach.get(x, ()))
        reach[a] = seen | reach[a]
    full = {}
    for a in list(reach):
        seen, stack = set(), [a]
        while stack:
            for y in [b for x, b in edges if x == stack[-1] and b not in seen] or [None]:
                if y is None:
                    stack.pop()
                else:
                    seen.add(y)
                    stack.append(y)
                    break
        full[a] = seen
    return full


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.randint(0, 24), r.randint(0, 24)) for _ in range(32)})
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
    full = closure(edges)
    want = {a: max({b for b in full[a] if a in full.get(b, ())} | {a}) for a in full if a in full[a]}
    assert {x["node"]: x["component"] for x in graph.strong_components(df).collect()} == want
    root = {}
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    nodes = {n for e in edges for n in e}
    assert {x["node"]: x["component"] for x in graph.components(df).collect()} == {n: top(n) for n in nodes}
    chain = spark.createDataFrame([(str(i).zfill(3), str(i + 1).zfill(3)) for i in range(100)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("z", "z")], "pointer string, target string")
    got = {x["pointer"]: x["canonical"] for x in graph.canonical_pointers(chain).collect()}
    assert got == {**{str(i).zfill(3): "100" for i in range(100)}, "x2": "x1", "x3": "x1", "y": "x1"}


def test_running_and_ranked(spark):
    df = spark.range(0, 3000, 1, 6).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(5)))
    got = relations.running(df, ["id"], F.col("v"), "s").orderBy("id").collect()
    total = 0
    for x in got:
        total += x["v"]
        assert x["s"] == total


def test_qualified_dates(spark):
    rows = [("ABT 1900", "1902", 90), ("AFT 1900", "1900", 80), ("BEF 1900", "1899", 90), ("1900", " 1900 ", 100), ("x", "1900", 0), (None, "1900", None), ("1900", "1906", 0)]
    got = spark.createDataFrame(rows, "a string, b string, s int").select("s", dates.text_date_similarity(F.col("a"), F.col("b")).alias("t")).collect()
    assert [x["t"] for x in got] == [x["s"] for x in got]
    for a, b, _ in rows[:5]:
        assert identity.date_score(a, b) == dict(((x, y), s) for x, y, s in rows)[a, b]


A = HEAD + "0 @I1@ INDI\n1 NAME Ann /Gray/\n1 _UID  7  7\n1 BIRT\n2 DATE 1 jan 1900\n2 PLAC Ely, UK\n2 SOUR @S1@\n3 PAGE 4\n2 NOTE long\n3 CONC er\n1 FAMC @F1@\n2 PEDI adopted\n0 @I2@ INDI\n1 NAME Bo /Gray/\n0 @F1@ FAM\n1 HUSB @I2@\n1 CHIL @I1@\n0 @S1@ SOUR\n0 TRLR\n"
B = A.replace("1 jan 1900", "01 JAN 1900").replace("Ely, UK", "ely, England").replace("2 NOTE long\n3 CONC er\n", "").replace("PAGE 4", "PAGE 5")


def test_structures(spark):
    ls = lines(spark, A, B)
    b = {(r["source"], r["pointer"], r["tag"]): r for r in structure.record_blocks(ls).collect()}
    x, y = b["a", "@I1@", "BIRT"], b["b", "@I1@", "BIRT"]
    assert x["key"] == y["key"] and x["logical"] == y["logical"] and x["whole"] != y["whole"] and x["cited"]
    assert [r["text"] for r in x["lines"]] == ["", "1 jan 1900", "Ely, UK", "@S1@", "4", "longer"]
    assert {(r["pointer"], r["id"]) for r in structure.identifiers(structure.record_blocks(ls)).collect()} == {("@I1@", "_UID:7 7")}
    assert {r["identity"] for r in structure.citations(structure.record_blocks(ls)).collect()} == {"@S1@\n4\n\n", "@S1@\n5\n\n"}
    dated = [(r["tag"], r["value"]) for r in structure.with_original_dates(ls).where("source = 'a' and tag in ('DATE', '_ORIGDATE')").orderBy("pos", "i").collect()]
    assert dated == [("DATE", "01 JAN 1900"), ("_ORIGDATE", "1 jan 1900")]
    assert structure.header_dates(ls).count() == 0
    kids = structure.children(gedcom.continued(ls), 1).where("source = 'a' and level = 2")
    assert kids.where("child_tag = 'SOUR'").count() == 1
    people = gedcom.persons(gedcom.blocks(ls), gedcom.records(ls))
    assert structure.person_summary(people).where("source = 'a' and pointer = '@I1@'").first()["summary"] == "Ann Gray; born 01 JAN 1900 in Ely, UK"


def test_parentage_and_report(spark):
    ls = lines(spark, A)
    recs, bs = gedcom.records(ls), gedcom.blocks(ls)
    parents = gedcom.parent_edges(gedcom.family_edges(bs, recs))
    near = quality.generations(parents, "@I1@")
    told = quality.parentage(parents, gedcom.person_edges(bs, recs), near)
    assert {(r["person"], r["generation"], r["parentage"]) for r in told.collect()} == {("@I1@", 0, "self"), ("@I2@", 1, "adopted")}
    found = quality.tree_findings(ls, 2020, "@I1@")
    asked = []
    notes = quality.annotate(found, near, lambda rows: asked.append(len(rows)) or {"annotations": [{"finding_id": rows[0]["finding_id"], "why_this_matters": "w|" * 2000, "research_suggestions": ["a", " ", "b", "c", "d", "e"]}, {"finding_id": "unknown"}]})
    assert asked[0] <= 25 and len(notes) == 1 and len(next(iter(notes.values()))[0]) == 2000 and next(iter(notes.values()))[1] == ["a", "b", "c", "d"]
    text = quality.report(found, near, relations=told, notes=notes)
    heads = [x[3:] for x in text.splitlines() if x.startswith("## ")]
    assert heads == ["Summary", "First 25 actions", "Direct ancestors by generation", "High-confidence possible duplicates", "Possible married names as primary names", "General quality", "Files and their structure", "Merge decisions"]
    assert "| 1 | @I2@ | adopted |" in text and "DANGLING" not in text and "NONRECIPROCAL_FAMILY_REFERENCE" in text
    with pytest.raises(ValueError):
        quality.annotations({"annotations": 3}, set())


def test_quality_of_a_file_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.ged").write_text("0 HEAD\nnonsense\n0 TRLR\n")
    assert "- Line: 2" in commands.quality_report(spark, str(tmp_path / "bad.ged"), 2020)
    (tmp_path / "a.ged").write_text(A)
    assert "| 1 | @I2@ | adopted |" in commands.quality_report(spark, str(tmp_path / "a.ged"), 2020, "Ann Gray")


def test_head_values_and_submitters(spark):
    one = "0 HEAD\n1 SOUR First\n2 VERS 1\n1 LANG English\n1 NOTE x\n1 CHAR ANSI\n1 SUBM @U1@\n0 @U1@ INDI\n0 @U1_4@ INDI\n0 TRLR\n"
    two = "0 HEAD\n1 SOUR Second\n1 NOTE x\n1 NOTE y\n0 TRLR\n"
    got = [r["line"] for r in gedcom_writer.file_lines(lines(spark, one, two)).orderBy("section", "ord", "rec", "pos", "i").collect()]
    assert got == ["0 HEAD", "1 SOUR First", "2 VERS 1", "1 LANG English", "1 NOTE x", "1 SUBM @U1_5@", "1 NOTE y", "1 GEDC", "2 VERS 5.5.5", "1 CHAR UTF-8", "0 @U1_5@ SUBM", "1 NAME Unknown", "0 @U1@ INDI", "0 @U1_4@ INDI", "0 TRLR"]
    own = [r["line"] for r in gedcom_writer.file_lines(lines(spark, "0 HEAD\n0 @X@ SUBM\n1 NAME Me\n0 TRLR\n")).orderBy("section", "ord", "rec", "pos", "i").collect()]
    assert "1 SUBM @X@" in own and own.count("1 NAME Me") == 1


def test_persons_known_by_fields(spark):
    cols = "pointer string, full_name string, given string, surname string, gender string, alternate_names array<string>, birth_date string, birth_place string, death_date string, death_place string, facts array<struct<tag: string, value: string, date: string, place: string, country: string>>, families array<struct<tag: string, pointer: string>>"
    rows = [("@I1@", "Ann Gray", "Ann", "Gray", "F", ["Nan", "Ann Gray"], "1900", "Ely", None, "", [("OCCU", "smith", "", "", "Peru"), ("RESI", "", "1920", "Ely", "UK")], [("FAMS", "@F1@"), ("NOTE", "@N@")]), ("@I2@", None, None, None, None, None, None, None, None, None, None, None), ("", "x", None, None, None, None, None, None, None, None, None, None)]
    ls = gedcom_writer.person_lines(spark.createDataFrame(rows, cols)).orderBy("rec", "pos").collect()
    got = [" ".join(x for x in (str(r["level"]), r["xref"], r["tag"], r["value"]) if x) for r in ls]
    assert got == ["0 @I1@ INDI", "1 NAME Ann /Gray/", "2 GIVN Ann", "2 SURN Gray", "1 NAME Nan", "1 SEX F", "1 BIRT", "2 DATE 1900", "2 PLAC Ely", "1 OCCU smith", "2 PLAC Peru", "1 RESI", "2 DATE 1920", "2 PLAC Ely", "3 CTRY UK", "1 FAMS @F1@", "0 @I2@ INDI"]


def test_merging_by_groups_is_the_loop(spark):
    full = {"sex": "F", "birth": [{"value": "", "date": "1 JAN 1900", "place": "Ely, England", "country": ""}], "death": [{"value": "", "date": "1980", "place": "York, England", "country": ""}]}
    base = dict.fromkeys(("names", "birth", "death", "facts", "marriages", "partners", "parents", "children"), [])
    who = {str(i): base | {"pointer": str(i), "source": "a", "names": ["Ann Gray"], "sex": ""} | (full if i < 5 else {}) for i in range(1, 10)}
    who["3"] = who["3"] | {"sex": "M"}
    df = spark.createDataFrame([tuple(p.get(c) for c in ("pointer", "source", "names", "sex", "birth", "death", "facts", "marriages", "partners", "parents", "children")) for p in who.values()], identity.PERSON)
    pairs = [("1", "2", 100.0), ("1", "3", 84.0), ("2", "4", 100.0), ("5", "6", 88.0), ("7", "8", 88.0)]
    merged, decisions = identity.merge_groups(spark.createDataFrame(pairs, "l string, r string, score double"), df)
    loop, said = identity.merge_people(pairs, {k: dict(v) for k, v in who.items()})
    assert {r["pointer"]: r["canonical"] for r in merged.collect()} == loop == {"2": "1", "4": "1"}
    assert sorted((r["l"], r["r"], r["disposition"]) for r in decisions.collect()) == sorted((d["left"], d["right"], d["disposition"]) for d in said)


def test_merge_all(spark, tmp_path):
    person = "0 @I{0}@ INDI\n1 NAME Ann /Gray/\n1 SEX F\n1 BIRT\n2 DATE 1 JAN 1900\n2 PLAC Ely, England\n1 DEAT\n2 DATE 5 MAY 1980\n2 PLAC York, England\n"
    for n in "ab":
        (tmp_path / f"{n}.ged").write_text(HEAD + person.format(1) + "0 TRLR\n")
    r = commands.merge_all(spark, [str(tmp_path / f"{n}.ged") for n in "ab"])
    assert [(x["pointer"], x["canonical"]) for x in r.merged.collect()] == [("@I2_1@", "@I1@")]
    assert r.lines.where("tag = 'INDI'").count() == 1 and r.decisions.first()["disposition"] == "merged"


def test_chosen_fields(spark):
    rows = [("1900", "1 JAN 1900", "Ely", "Ely, Cambs", "a", "b", None, "1 JAN 1900", "Ely, Cambs", "a"), ("1900", "1901", "Ely X", "Ely Y", "", "b", None, "1900", "Ely X", "b"), (None, "", "Ely", None, "a", "b", "b", "", "Ely", "b"), ("1900", None, None, None, "a", "b", "c", "1900", "", "a")]
    df = spark.createDataFrame(rows, "d1 string, d2 string, p1 string, p2 string, s1 string, s2 string, pref string, wd string, wp string, ws string")
    c = identity.choose_fields({"birth_date": F.col("d1"), "birth_place": F.col("p1"), "surname": F.col("s1")}, {"birth_date": F.col("d2"), "birth_place": F.col("p2"), "surname": F.col("s2")}, {"surname": F.col("pref")})
    for r in df.select("wd", "wp", "ws", *(v.alias(k) for k, v in c.items())).collect():
        assert (r["birth_date"], r["birth_place"], r["surname"]) == (r["wd"], r["wp"], r["ws"])


def test_resolvers_are_believed_with_care():
    assert sync.agreed({"same": True, "confidence": 0.9}) and not any(sync.agreed(v) for v in (None, {}, {"same": True}, {"same": 1, "confidence": 1}, {"same": True, "confidence": True}, {"same": True, "confidence": 1.1}, {"same": True, "confidence": float("nan")}, {"same": True, "confidence": 0.89}))


@dataclass(frozen=True)
class Pair:
    b: int
    a: str


def test_json():
    assert jsons.read('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for bad in ("[NaN]", '{"a": 1, "a": 2}', "{", "[" * 70 + "]" * 70):
        with pytest.raises(jsons.JsonError):
            jsons.read(bad)
    assert jsons.read('"[[[' + "[" * 70 + '"')
    with pytest.raises(jsons.JsonError):
        jsons.read("[1,2,3]", jsons.Bounds(items=3))
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 0}, "t": {"type": "array", "maxItems": 2, "items": {"type": "string", "enum": ["x", "y"]}}}}
    assert jsons.validated('{"n": 1, "t": ["x"]}', schema) == {"n": 1, "t": ["x"]} and jsons.validated("x", None) is None
    for bad in ("{}", '{"n": -1}', '{"n": true}', '{"n": 1, "z": 0}', '{"n": 1, "t": ["z"]}', '{"n": 1, "t": ["x", "x", "x"]}'):
        with pytest.raises(jsons.JsonError):
            jsons.validated(bad, schema)
    assert jsons.canonical(Pair(1, "é")) == '{"a":"é","b":1}' and jsons.decoded('{"a":"é","b":1}', Pair) == Pair(1, "é")
    with pytest.raises(jsons.JsonError):
        jsons.decoded('{"a":"é"}', Pair)


def test_stores(spark, tmp_path):
    s = stores.Store(spark, f"file://{tmp_path}/prompts", stores.PROMPTS)
    assert [stores.save_prompt(s, "p", "why", "Hi $name, ${x} $$", ["x", "name"]), stores.save_prompt(s, "p", "why", "Bye $name", ["name"]), stores.save_prompt(s, "a", "", "-", [])] == [1, 2, 1]
    assert [(r["name"], r["version"]) for r in stores.list_prompts(s).collect()] == [("a", 1), ("p", 2)]
    assert stores.render_prompt(s, "p", {"name": "A", "x": "B"}, 1) == "Hi A, B $" and stores.render_prompt(s, "p", {"name": "A"}) == "Bye A"
    for bad in (lambda: stores.save_prompt(s, "q", "", "$a", ["b"]), lambda: stores.save_prompt(s, "q", "", "$", []), lambda: stores.render_prompt(s, "p", {}), lambda: stores.save_prompt(s, "q", "", "-", ["1"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        stores.get_prompt(s, "none")
    p = stores.Store(spark, f"file://{tmp_path}/people", stores.PEOPLE)
    stores.add_person(p, "bo")
    stores.add_person(p, " Ann ")
    assert [r["name"] for r in stores.list_people(p).collect()] == ["Ann", "bo"]
    with pytest.raises(ValueError):
        stores.add_person(p, "ANN")


def test_answers_are_asked_for_once(spark):
    now, asked = [0.0], []
    c = stores.AnswerCache(10, 2, lambda: now[0])
    ask = lambda k: c.get({"k": k}, lambda: asked.append(k) or k)
    assert [ask(1), ask(1), ask(2), ask(3), ask(1)] == [1, 1, 2, 3, 1] and asked == [1, 2, 3, 1]
    now[0] = 11.0
    assert ask(3) == 3 and asked[-1] == 3
    gate, n = threading.Event(), []
    threads = [threading.Thread(target=c.get, args=("same", lambda: n.append(1) or gate.wait(5))) for _ in range(4)]
    [t.start() for t in threads]
    gate.set()
    [t.join() for t in threads]
    assert len(n) == 1
    with pytest.raises(ZeroDivisionError):
        c.get("e", lambda: 1 / 0)
    assert c.get("e", lambda: 5) == 5
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None)], "i int, q string")
    assert {r["i"]: r["answer"] for r in stores.distinct_answers(df, "q", lambda t: str(len(t))).collect()} == {1: "1", 2: "1", 3: "2", 4: None}
    assert stores.extract("á  b\n\n a b", lambda t, _: f'"{t}"', {"type": "string"}) == "a b"


def test_readers_that_fall_behind():
    hub = stores.Hub(2)
    a, b = hub.subscribe(2), hub.subscribe(9)
    with pytest.raises(ValueError):
        hub.subscribe()
    for i in range(3):
        hub.publish(i)
    with pytest.raises(ValueError):
        a.take()
    assert [b.take(), b.take(), b.take(), b.take()] == [0, 1, 2, None]
    assert hub.subscribe() in hub.readers


def test_sqlite_edges(spark, tmp_path):
    import sqlite3

    p = str(tmp_path / "t.rmtree")
    c = sqlite3.connect(p)
    c.executescript("""create table PersonTable (PersonID INTEGER PRIMARY KEY, Sex INTEGER, Living INTEGER, Favorite TEXT, Portrait BLOB); create table K (A TEXT PRIMARY KEY, B TEXT) without rowid;
    create table NameTable (NameID INTEGER PRIMARY KEY, OwnerID INTEGER, Surname TEXT, Given TEXT, IsPrimary INTEGER); create table FamilyTable (FamilyID INTEGER PRIMARY KEY, FatherID INTEGER, MotherID INTEGER);
    create table ChildTable (FamilyID INTEGER, ChildID INTEGER); create table NoteTable (NoteID INTEGER PRIMARY KEY, OwnerID INTEGER, Text TEXT); create table MediaTable (MediaID INTEGER PRIMARY KEY, OwnerID INTEGER, File TEXT);
    insert into PersonTable values (1, 0, 0, 'tea', null), (9000000000000, 1, 0, null, null), (3, 1, 1, 'x', null); insert into K values ('a', 'b'), ('c', 'd'); insert into NameTable values (1, 1, 'Gray', 'Ann', 1), (2, 3, 'Gray', 'Kid', 1);
    insert into FamilyTable values (1, 1, 0); insert into ChildTable values (1, 9000000000000), (1, 3); insert into NoteTable values (1, 1, 'said'), (2, 3, 'secret'); insert into MediaTable values (1, 1, 'a.jpg');""")
    c.commit()
    c.close()
    df = sqlite_tree.read_table(spark, p, "PersonTable", 2)
    assert df.rdd.getNumPartitions() == 2 and {r["PersonID"] for r in df.collect()} == {1, 3, 9000000000000}
    assert sqlite_tree.read_table(spark, p, "K").count() == 2
    assert sqlite_tree.check_rows(p) == 13
    with pytest.raises(ValueError, match="rows"):
        sqlite_tree.check_rows(p, 3)
    lost = commands.export_tree(spark, p, str(tmp_path / "out"), root="9000000000000", scope="ancestors")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert "1 NAME Ann /Gray/" in text and "1 _RM_FAVORITE tea" in text and "1 NOTE said" in text and "2 FILE a.jpg" in text and "secret" not in text and "Kid" not in text
    assert {(r["table_name"], r["n_rows"], r["lost"]) for r in lost.collect()} == {("PersonTable", 3, 1), ("NameTable", 2, 1), ("ChildTable", 2, 1), ("NoteTable", 2, 1)}


def test_only_the_missing_subpackage_is_forgiven():
    import __spark_entry__ as e

    assert "p5_found" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
