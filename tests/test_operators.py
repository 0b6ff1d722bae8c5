import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import blocking, graph, identity, relations, sync
from stemma.plans import sqlgate


def test_capped_pairs_is_the_greedy_loop(spark):
    r = random.Random(1)
    rows = [(x, y, f"k{r.randint(0, 9)}", r.randint(1, 9)) for x in range(30) for y in range(x + 1, 30) if r.random() < 0.4]
    limits = blocking.Limits(pairs_per_person=5, scored=40)
    got = {(x["l"], x["r"]) for x in blocking.capped_pairs(spark.createDataFrame(rows, "l long, r long, key string, n long"), limits).collect()}
    seen, want = {}, set()
    for x, y, _, _ in sorted(rows, key=lambda t: (t[3], t[2], t[0], t[1])):
        if len(want) < 40 and seen.get(x, 0) < 5 and seen.get(y, 0) < 5:
            seen[x], seen[y] = seen.get(x, 0) + 1, seen.get(y, 0) + 1
            want.add((x, y))
    assert got == want


def test_ranked_is_a_total_order(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = relations.ranked(df, ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_semantic_order(spark):
    df = spark.createDataFrame([("b",), ("10",), (None,), ("9",), ("A",), ("-3",), ("",)], "v string")
    assert [r["v"] for r in df.orderBy(relations.semantic_key(F.col("v"))).collect()] == [None, "-3", "9", "10", "", "A", "b"]


def test_reach_and_pointers(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    got = {(r["node"], r["depth"]) for r in graph.reach(e, spark.createDataFrame([(1,), (1,), (None,)], "node long")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "pointer string, target string")
    assert {(r["pointer"], r["canonical"]) for r in graph.canonical_pointers(m).collect()} == {("a", "c"), ("b", "c")}


def test_gate(spark, tmp_path):
    spark.range(500).withColumn("v", F.col("id") % 7).write.parquet(str(tmp_path / "t.parquet"))
    d = f"file://{tmp_path}"
    assert sqlgate.run(spark, d, "with x as (select id from t where v = 3) select count(*) n from x").first()["n"] == 71
    r = sqlgate.capped(spark, d, "select id from t order by id limit 3")
    assert (len(sqlgate.collect_in_time(r.rows, 60)), r.truncated) == (3, False)
    r = sqlgate.capped(spark, d, "select t.id from t order by id")
    assert (r.rows.count(), r.truncated) == (100, True)
    for bad in ("drop table t", "insert into t values (1, 2)", "select * from nowhere", "select * from parquet.`/etc`", "select 1; select 2", "create view x as select 1", "select id from t where exists (select 1 from secret)", "selec"):
        with pytest.raises(sqlgate.SqlRejected):
            sqlgate.run(spark, d, bad)


def person(pointer, **more):
    base = dict.fromkeys(("names", "birth", "death", "facts", "marriages", "partners", "parents", "children"), [])
    return base | {"pointer": pointer, "source": "a", "sex": "", "names": ["Ann Gray"]} | more


def event(date="", place=""):
    return {"value": "", "date": date, "place": place, "country": ""}


def test_assess():
    a = person("1", sex="F", birth=[event("1 JAN 1900", "Ely, England")], death=[event("1980", "York, England")])
    same = identity.assess(a, a | {"pointer": "2"})
    assert (same.score, same.conflicts, same.safe) == (100.0, (), True)
    assert identity.assess(a, a | {"sex": "M"}).conflicts == ("sex",)
    assert "birth year" in identity.assess(a, a | {"birth": [event("1950")]}).conflicts
    assert "birth country" in identity.assess(a, a | {"birth": [event("1900", "Paris, France")]}).conflicts
    assert identity.assess(person("1"), person("2")).score == 88.0
    assert identity.text_score("Gray Ann", "ann  GRAY") == 100.0
    assert identity.date_score("ABT 1900", "1902") == 90.0
    assert identity.date_score("1900", "1902") == 60.0
    assert identity.date_score("AFT 1900", "1900") == 80.0
    assert identity.lcs("abcbdab", "bdcaba") == 4


def test_merge_is_conservative(spark):
    full = {"sex": "F", "birth": [event("1 JAN 1900", "Ely, England")], "death": [event("1980", "York, England")]}
    people = {"1": person("1", **full), "2": person("2", **full), "3": person("3", **full | {"sex": "M"}), "4": person("4"), "5": person("5")}
    merged, why = identity.merge_people([("1", "2", 100.0), ("1", "3", 84.0), ("4", "5", 88.0)], dict(people))
    assert merged == {"2": "1"}
    assert [w["disposition"] for w in why] == ["merged", "retained", "retained-cluster-conflict"]
    asked = []
    merged, why = identity.merge_people([("4", "5", 88.0)], dict(people), lambda a, b: asked.append(1) or {"same": True, "confidence": 0.9})
    assert merged == {"5": "4"} and asked == [1]
    merged, why = identity.merge_people([("4", "5", 88.0)], dict(people), lambda a, b: {"same": True, "confidence": 0.9}, blocking.Limits(adjudications=0))
    assert merged == {} and why[0]["disposition"] == "retained-adjudication-budget"
    df = spark.createDataFrame([tuple(p.get(c) for c in ("pointer", "source", "names", "sex", "birth", "death", "facts", "marriages", "partners", "parents", "children")) for p in people.values()], identity.PERSON)
    got = identity.score_pairs(spark.createDataFrame([("1", "2"), ("1", "3")], "l string, r string"), df).collect()
    assert {(r["l"], r["r"], r["score"]) for r in got} == {("1", "2", 100.0), ("1", "3", 83.0)}


def test_profile_keys(spark):
    df = spark.createDataFrame([("Gray", "Ann", "F", "1 JAN 1900", "Ely, England", None, None, "Ann Gray")], "s string, g string, x string, bd string, bp string, dd string, dp string, n string")
    keys = df.select(identity.profile_keys(*(F.col(c) for c in df.columns)).alias("k")).first()["k"]
    assert {"sn|g|gn|a|y|380", "name|g|a", "name-exact|anngray", "birth|year|1900", "birth|place|elyengland", "name-birth|gray|1900|F"} <= set(keys)
    assert not any(k.startswith("death") for k in keys)


def test_sync(spark):
    cols = "person string, hash string, tag string, protected boolean, cited boolean, sources array<string>, first_generation int, last_generation int"
    state = spark.createDataFrame([
        ("p", "stays", "BIRT", False, False, ["s"], 1, 1), ("p", "gone", "OCCU", False, False, ["s"], 1, 1), ("p", "cited", "OCCU", False, True, ["s"], 1, 1), ("p", "manual", "OCCU", True, False, ["manual"], 1, 1), ("p", "note", "NOTE", False, False, ["s"], 1, 1),
    ], cols)
    seen = spark.createDataFrame([("p", "stays", "BIRT", False, "s"), ("p", "new", "RESI", True, "s"), ("p", "dead", "RESI", True, "s"), ("p", "new", "RESI", False, "t")], "person string, hash string, tag string, cited boolean, source string")
    dead = spark.createDataFrame([("p", "dead")], "person string, hash string")
    after = sync.reconcile(state, seen, dead, 2)
    rows = {r["hash"]: r for r in after.collect()}
    assert set(rows) == {"stays", "cited", "manual", "note", "new"}
    assert rows["new"]["sources"] == ["s", "t"] and rows["new"]["first_generation"] == 2
    assert tuple(sync.accounting(state, after).first()) == (1, 1, 4, 1)
    edited = after.where("hash != 'note'").select("person", "hash", "tag", "cited").unionAll(spark.createDataFrame([("p", "hand", "OCCU", False)], "person string, hash string, tag string, cited boolean"))
    with pytest.raises(ValueError):
        sync.rebase(after, edited, False, 3)
    s, t = sync.rebase(after, edited, True, 3)
    assert {r["hash"] for r in s.where("protected").collect()} == {"manual", "hand"}
    assert [tuple(r) for r in t.collect()] == [("p", "note")]


def test_block_hash(spark):
    kids = "array<struct<tag: string, value: string>>"
    rows = [("a", "BIRT", " x ", [("DATE", "1 Jan"), ("PLAC", "É")]), ("b", "BIRT", "X", [("PLAC", "é"), ("DATE", "1  JAN"), ("SOUR", "@S1@")]), ("c", "BIRT", "X", [("DATE", "2 JAN")])]
    h = {r["k"]: r["h"] for r in spark.createDataFrame(rows, f"k string, t string, v string, c {kids}").select("k", sync.block_hash(F.col("t"), F.col("v"), F.col("c")).alias("h")).collect()}
    assert h["a"] == h["b"] != h["c"]


def test_bindings(spark):
    p = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = sync.bind_people(p([("x",), ("y",), ("z",)], "person string"), p([("x", "m1")], "person string, master string"), p([("x", "i2"), ("y", "i2"), ("y", "i3")], "person string, id string"), p([("m2", "i2"), ("m3", "i3")], "master string, id string"), p([("z", "f")], "person string, print string"), p([("m4", "f")], "master string, print string"))
    assert {(r["person"], r["master"], r["how"], r["n"]) for r in got.collect()} == {("x", "m1", "binding", 1), ("y", "m2", "identifier", 2), ("z", "m4", "fingerprint", 1)}


def test_bindings_need_evidence(spark):
    p = lambda rows, cols: spark.createDataFrame(rows, cols)
    people = [(x,) for x in ("held", "drifted", "clashing", "changed", "twice", "unsafe")]
    bound = [("held", "m1"), ("drifted", "m2"), ("clashing", "m3"), ("unsafe", "m9")]
    scores = [
        ("held", "m1", 80.0, [], False), ("drifted", "m2", 77.0, [], False), ("clashing", "m3", 84.0, ["sex"], False), ("changed", "m4", 96.0, [], True), ("twice", "m5", 97.0, [], True), ("twice", "m6", 60.0, [], False),
        ("unsafe", "m7", 90.0, [], False),
    ]
    got = sync.match_people(
        p(people, "person string"), p(bound, "person string, master string"), p([("twice", "i")], "person string, id string"), p([("m6", "i")], "master string, id string"), p([], "person string, print string"), p([], "master string, print string"),
        p(scores, "l string, r string, score double, conflicts array<string>, safe boolean"),
    )
    assert {(r["person"], r["master"], r["how"], r["n"]) for r in got.collect()} == {("held", "m1", "binding", 1), ("changed", "m4", "score", 1), ("twice", "m6", "identifier", 2)}
