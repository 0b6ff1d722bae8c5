import random
import string

import pytest

from stemma.llm import names, placetext, variants
from stemma.llm.places import bigram_set, map_places, similarity_join


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def noisy(r, n, size=12):
    base = ["".join(r.choice("abcde") for _ in range(r.randint(1, size))) for _ in range(n // 3)]
    out = set(base)
    for s in base:
        for _ in range(2):
            t = list(s)
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(t) + 1)
                r.choice([lambda: t.insert(i, r.choice("abcde")), lambda: t.pop(min(i, len(t) - 1)) if len(t) > 1 else None])()
            out.add("".join(t))
    return sorted(out)


def test_within_is_edit_distance_in_a_band():
    r = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(2))
        k = r.randint(0, 3)
        assert placetext.within(a, b, k) == min(osa(a, b), k + 1)


def test_nearest_word_skips_none():
    r = random.Random(5)
    words = noisy(r, 120)
    near = placetext.Near(words)
    for w in noisy(r, 60):
        best = min(osa(w, x) for x in words)
        found = near.best(w, 2)
        assert (osa(w, found) == best) if best <= 2 else found == ""


def test_segment_join_against_brute_force(spark):
    r = random.Random(4)
    rows = [(g, s) for g in ("x", "y") for s in noisy(r, 240)] + [("x", None), ("x", "a"), ("x", "abcde")] * 2
    got = {tuple(t) for t in variants.segment_join(spark.createDataFrame(rows, "g string, name string"), ["g"]).select("g", "a", "b").collect()}
    allowed = lambda n: 2 if n >= variants.LONG else 1 if n >= variants.SHORT else 0
    want = set()
    for g in ("x", "y"):
        ns = sorted({s for h, s in rows if h == g and s})
        want |= {(g, a, b) for i, a in enumerate(ns) for b in ns[i + 1 :] if levenshtein(a, b) <= allowed(min(len(a), len(b)))}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("threshold", [0.4, 0.75])
def test_similarity_join_against_brute_force(spark, threshold):
    r = random.Random(6)
    left, right = noisy(r, 200), noisy(r, 150)
    df = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string").withColumn("grams", bigram_set("name"))
    got = {(t["left_name"], t["right_name"]): t["jaccard"] for t in similarity_join(df(left), df(right), threshold).collect()}
    want = {}
    for a in left:
        for b in right:
            x, y = set(placetext.bigrams(a)), set(placetext.bigrams(b))
            j = len(x & y) / len(x | y)
            if j >= threshold - 1e-9:
                want[a, b] = j
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


PLACES = [(1, "Vüxnaugh, Saint Ler County, Ireland", "Ireland", ["Cloargholm"]), (2, "Upper Damtemore, Saint Ler County, Ireland", "Ireland", []), (3, "Treindbury, Flielter Vale, England", "England", []), (4, "Treindbury, Büdrier Vale, England", "England", None), (5, "Krasbuburgh, Preinnzoer Moor, Scotland", "Scotland", [])]
TYPED = {
    "Vüxnaugh, Saint Ler County, Ireland": 1, "near VUEXNAUGH": 1, "Cloargholm, Saint Ler Co.": 1, "Ireland, Saint Ler County, Vuxnaugh [sic]": 1, "Upr. Damtemore, Co. Saint Ler": 2, "upper damtemroe": 2,
    "Treindbury; Büdrier Vale; Eng.": 4, "Treindbury par. reg., Flielter Vale, Angleterre": 3, "Krasbubrugh / chapel, N. Britain": 5, "Kr0asbuburgh, Preinnzoer Moor": 5, "at sea": 0, "???": 0, "same as father": 0, "Funghaham, Flielter Vale, England": 0,
    "Krasbuburgh, Preinnzoer Moor, Canada": 0, "Gemeinde Vüxnaugh Hof": 1, "Krasbuburgh Preinnzoer Moor Scotland": 5,
}


def test_places(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TYPED)] + [(90, None, "x", 1), (91, "   ", "x", 1), (92, "", "x", 1), (93, "at sea", "x", 1)]
    people = spark.createDataFrame(rows, "individual_id long, birth_place string, name string, n long")
    got = {r["individual_id"]: r["placeid"] for r in map_places(people, spark.createDataFrame(PLACES, "placeid int, name string, country string, alternate_names array<string>")).collect()}
    assert got == {i: p for i, p in enumerate(TYPED.values())} | {93: 0}


def test_places_of_nothing(spark):
    places = spark.createDataFrame([], "placeid int, name string, country string, alternate_names array<string>")
    assert map_places(spark.createDataFrame([(1, "Ely")], "individual_id long, birth_place string"), places).first()["placeid"] == 0
    assert map_places(spark.createDataFrame([], "individual_id long, birth_place string"), places).count() == 0


def test_names_as_typed():
    want = {
        "FLURNTISTAD Anna": "anna", "Sgt. Jim Kaustkiez": "jim", "Michl. Hugo X": "michl.", "Gray, Thos.": "thos.", "Wwe. Zelda Ruerkoson": "zelda", "K. Cäsdeer": "k", "Trixie /Gray/": "trixie", "": "", None: "",
    }
    assert {n: names.read_name(n)[1] for n in want} == want
    assert names.read_name("Leopold Kaustkiez the younger")[3] == "younger"
    assert names.read_name("Futtlikvist, Josef")[0] == names.read_name("Joseph Futtliquist")[0]
    assert names.read_name("Mrs.")[0] and names.read_words("The Widget Co.") == ["widget"] and names.read_words("The") == ["the"] and names.read_words(None) == []


COLUMNS = "nameid long, tree_file string, full_name string, alternate_names array<string>, name_type string"


def test_names_never_seen(spark):
    rows = [
        (1, "t", "Priya Raghunathan", None, "person"), (2, "t", "Priyah Raghunathan", [], "person"), (3, "t", "Acme Widget Works", [], "organisation"), (4, "t", "Acme Widgit Works", None, "organisation"),
        (5, "t", "First National Bank", [], "organisation"), (6, "t", "First Natl. Bank", [], "organisation"), (7, "t", "John Smith Jr", [], "person"), (8, "t", "John Smith", [], "person"), (9, "t", "Mrs.", [], "person"), (10, "t", "MRS", [], None),
        (11, "t", "Second Savings Bank", [], "organisation"), (12, "t", "Dmitri Smith", [], "person"), (13, None, "Priya Raghunathan", [], "person"), (14, None, "Priya Raghunathan", ["", None], None),
    ]
    extra = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as form", "1 as d", "'y' as kind")
    got = {(r["nameid_a"], r["nameid_b"]) for r in variants.class_pairs(variants.name_classes(extra)).collect()}
    assert got == {(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (13, 14)}


def test_nearest_fuller_names_decide(spark):
    rows = [(1, "t", "John Smithson", [], "person"), (2, "t", "J. Smithson", [], "person"), (3, "t", "James Smithsen", [], "person"), (4, "t", "R. Adams", [], "person"), (5, "t", "Ralph Adams", [], "person"), (6, "t", "Roger Adams", [], "person")]
    got = {(r["nameid_a"], r["nameid_b"]) for r in variants.class_pairs(variants.name_classes(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert got == {(1, 2)}


def invented(r, n, syllables):
    out = set()
    while len(out) < n:
        out.add("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(syllables)) + r.choice("lnrst"))
    return sorted(out)


def test_variants_are_learned(spark):
    """Given names, nicknames and words of organisations that no list holds, told apart by planted truth."""
    r = random.Random(17)
    given = invented(r, 40, 3)
    nick = {g: w for g, w in zip(given, zip(invented(r, 40, 2), (f"x{s}" for s in invented(r, 40, 2)), strict=True), strict=True)}
    frames = [("{} hutekol sami", "kolemsamit {}", "sami hutekol {}"), ("{} obrigan fetulo", "virtusam {}", "fetulo obrigan {}"), ("{} dagoneru", "harimeksum {}", "{} dagon.")]
    rows, truth = [], []
    for who, sur in enumerate(invented(r, 400, 4)):
        tree = f"t{who % 3}"
        if who % 4 == 0:
            shapes = [f.format(sur) for f in r.choice(frames)]
        else:
            g = r.choice(given)
            shapes = [f"{g} {sur}", f"{nick[g][0]} {sur}", f"{sur}, {nick[g][1]}"]
        for _ in range(4):
            name = r.choice(shapes)
            other = [r.choice(shapes)] if r.random() < 0.3 else []
            rows.append((len(rows), tree, name.title(), [o.title() for o in other], "organisation" if who % 4 == 0 else "person" if r.random() < 0.9 else None))
            truth.append(who)
    got = {(x["nameid_a"], x["nameid_b"]) for x in variants.class_pairs(variants.name_classes(spark.createDataFrame(rows, COLUMNS))).collect()}
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if truth[i] == truth[j]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)


def test_name_classes(spark):
    rows = [
        (1, "t", "Joseph Futtliquist", [], "person"), (2, "t", "Futtlikvist, Josef", None, "person"), (3, "t", "J. Futtliquist", [], None), (4, "t", "Ann Futtliquist", [], "person"), (5, "u", "Joseph Futtliquist", [], "person"),
        (6, "t", "Theodore Dirbaski Jr.", [], "person"), (7, "t", "Theodore Dirbaski Sr.", [], "person"), (8, "t", "Theo Dirbasky jun.", [], "person"), (9, "t", "Philippa Clierklahofer", ["Philippa Lémwobach"], "person"),
        (10, "t", "Filippa Lemwobach", [], "person"), (11, "t", "Gumsibrook Family Association", [], None), (12, "t", "Fam. Association Gumsiibrook", [], "organisation"), (13, "t", None, None, None), (14, "t", "  ", [], "person"),
        (15, "t", "Thomas Hugo Borkmabrook", [], "person"), (16, "t", "Thos. H. Borkmabrook", [], "person"), (17, "t", "Thomas Peter Borkmabrook", [], "person"), (18, "t", "Joseph Futtliquist", [], "person"),
    ]
    cols = "nameid long, tree_file string, full_name string, alternate_names array<string>, name_type string"
    got = {(r["nameid_a"], r["nameid_b"]) for r in variants.class_pairs(variants.name_classes(spark.createDataFrame(rows, cols))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 18), (2, 18), (3, 18), (6, 8), (9, 10), (11, 12), (15, 16)}
    assert variants.name_classes(spark.createDataFrame([], cols)).count() == 0


def test_alphabet_of_sounds():
    assert all(names.sound(x).isalnum() for x in string.ascii_lowercase)


def test_slips_in_a_stated_county(spark):
    places = spark.createDataFrame([(7, "Wixtuna, Derseer Vale, England", "England", []), (8, "Ely, Derseer Vale, England", "England", [])], "placeid int, name string, country string, alternate_names array<string>")
    texts = ["Wlxtnna, Derseer Vale, England", "Wlxtnna", "Ulm, Derseer Vale, England", "Wixtuna"]
    got = {r["individual_id"]: r["placeid"] for r in map_places(spark.createDataFrame(list(enumerate(texts)), "individual_id long, birth_place string"), places).collect()}
    assert got == {0: 7, 1: 0, 2: 0, 3: 7}
