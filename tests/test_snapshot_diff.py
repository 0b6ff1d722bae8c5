import random
import unicodedata

from stemma.operators.snapshot_diff import snapshot_changes, transitions

COLUMNS = "snapshot_id string, kind string, uid string, xref string, label string, event_date string, event_place string, attributes array<string>, step long"
FIELDS = ("kind", "label", "event_date", "event_place")


def canonical(s):
    s = "".join((s or "").split())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).casefold())


def brute(rows, pairs):
    at = {}
    for r in rows:
        if r[2] is not None:
            parts = (canonical(r[1]), canonical(r[4]), canonical(r[5]), canonical(r[6]), tuple(sorted(canonical(a) for a in r[7] or [] if canonical(a))))
            at.setdefault(r[0], {})[r[2]] = parts
    out = set()
    for p, n in set(pairs):
        old, new = at.get(p, {}), at.get(n, {})
        out |= {(p, n, u, "created") for u in new.keys() - old.keys()} | {(p, n, u, "removed") for u in old.keys() - new.keys()}
        out |= {(p, n, u, "updated") for u in old.keys() & new.keys() if old[u] != new[u]}
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for s in "abcd":
        for u in range(40):
            if r.random() < 0.8:
                label = r.choice(["José", "JOSÉ", "Jose", " Jos é ", None, ""])
                rows.append((s, r.choice(["person-block", "family-block"]) if u % 9 == 0 else "person-block", f"U{u}", f"@I{r.random()}@", label, r.choice(["1 JAN 1800", "1  jan 1800", None, ""]), r.choice(["Straße", "STRASSE", None]), r.choice([["A b", "c"], ["C", "a B"], [], None, ["", None]]), 1))
    for s in "abcd":  # repeated rows differ in typography only
        rows += [(x[0], x[1], x[2], "@other@", (x[4] or "").upper() or None, *x[5:]) for x in rows if x[0] == s][:5]
    rows.append(("a", "person-block", None, "", "no uid", None, None, None, 1))
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "nowhere")]
    got = snapshot_changes(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(*p, 1) for p in pairs + pairs[:2]], "prev_snapshot_id string, snapshot_id string, step long"))
    found = [tuple(x) for x in got.select("prev_snapshot_id", "snapshot_id", "uid", "change_kind").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, pairs)


def test_changed_fields_are_named(spark):
    base = ("person-block", "u", "x", "L", "1800", "P", ["a"], 0)
    rows = [("a", *base), ("b", "person-block", "u", "y", "M", "1800", "P", ["a", "b"], 0)]
    got = snapshot_changes(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([("a", "b")], "prev_snapshot_id string, snapshot_id string")).collect()
    assert [(r["change_kind"], r["changed_fields"]) for r in got] == [("updated", ["attributes", "label"])]


def test_transitions(spark):
    m = [("t", 1, {"s": "a"}), ("t", 1, {"s": "a"}), ("t", 2, {"s": "a", "z": "q"}), ("t", 3, {"s": "b"}), ("t", 4, {"s": "a"}), ("u", 9, {"s": "c"}), ("t", 5, None), ("t", None, {"s": "x"})]
    got = transitions(spark.createDataFrame(m, "tree_id string, generation int, active_snapshots map<string,string>"))
    assert {(r["prev_snapshot_id"], r["snapshot_id"]) for r in got.collect()} == {("a", "b"), ("b", "a")}


def test_empty(spark):
    got = snapshot_changes(spark.createDataFrame([], COLUMNS), spark.createDataFrame([], "prev_snapshot_id string, snapshot_id string"))
    assert got.count() == 0
