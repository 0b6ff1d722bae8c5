"""Who is the same person: blocking profiles, evidence scores, and conservative merging of candidate pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.places import COUNTRY_ALIASES, KNOWN_COUNTRIES, country_of_place
from stemma.functions.text import key_text
from stemma.functions.dates import year_of
from stemma.operators.blocking import Limits

# What each kind of evidence weighs, and the bounds of a score.
WEIGHTS = {
    "name": 30, "birth date": 12, "birth place": 8, "birth country": 7, "death date": 8, "death place": 6, "death country": 5, "sex": 4, "occupation": 5, "residence": 7,
    "family events": 8, "partners": 12, "parents": 10, "children": 8, "other standard facts": 6,
}
FACT_WEIGHTS = {"value": 0.30, "date": 0.35, "place": 0.25, "country": 0.10}
RELATIVE_WEIGHTS = {"name": 0.50, "birth_date": 0.20, "death_date": 0.10, "birth_place": 0.10, "death_place": 0.05, "birth_country": 0.05, "relationship": 0.10}
ONE_COMPONENT, LITTLE_EVIDENCE, ENOUGH_WEIGHT, CONFLICT, CONFLICTS, CONFLICT_CAP = 88.0, 94.0, 45.0, 12.0, 36.0, 84.0
SAFE_SCORE, SAFE_WEIGHT, SAFE_FIELDS, MERGE_THRESHOLD, RESOLVER_CONFIDENCE = 95.0, 50.0, 3, 78, 0.85
HARD = frozenset(("sex", "birth country", "death country"))
ANCHORS = frozenset(("birth date", "birth place", "death date", "death place", "occupation", "residence", "other standard facts"))
RELATIVES = ("partners", "parents", "children")
LOW = {"name": 55.0, "partners": 50.0, "parents": 45.0, "children": 45.0}
YEARS_APART = 5

PERSON = """pointer string, source string, names array<string>, sex string, birth array<struct<value: string, date: string, place: string, country: string>>,
death array<struct<value: string, date: string, place: string, country: string>>, facts array<struct<tag: string, value: string, date: string, place: string, country: string>>,
marriages array<struct<tag: string, value: string, date: string, place: string, country: string>>,
partners array<struct<name: string, birth_date: string, death_date: string, birth_place: string, death_place: string, relationship: string>>,
parents array<struct<name: string, birth_date: string, death_date: string, birth_place: string, death_place: string, relationship: string>>,
children array<struct<name: string, birth_date: string, death_date: string, birth_place: string, death_place: string, relationship: string>>"""


def profile_keys(surname: Column, given: Column, sex: Column, birth_date: Column, birth_place: Column, death_date: Column, death_place: Column, full_name: Column) -> Column:
    """Array of blocking keys of a person; parts are joined by |, what is missing is ?."""
    q = lambda c: F.coalesce(F.when(c.cast("string") != "", c.cast("string")), F.lit("?"))
    key = lambda *p: F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else q(x) for x in p))
    sn, gn, name = key_text(surname), key_text(given), key_text(full_name)
    s1, g1, s8 = F.substring(sn, 1, 1), F.substring(gn, 1, 1), F.substring(sn, 1, 8)
    by, dy = year_of(birth_date), year_of(death_date)
    bucket = F.floor(by / 5)
    out = [
        key("sn", s1, "gn", g1, "y", bucket), key("sn", s1, "y", bucket), key("gn", g1, "y", bucket), key("name", s1, g1), F.when(name != "", key("name-exact", name)),
        F.when(by.isNotNull(), key("name-birth", s8, by, sex)),
    ]
    for label, y, place in (("birth", by, birth_place), ("death", dy, death_place)):
        c, p18 = country_of_place(place), key_text(place, 18)
        out += [
            F.when(y.isNotNull(), key(label, "year", y)), F.when(y.isNotNull() & c.isNotNull(), key(label, "year-country", y, c)), F.when(p18 != "", key(label, "place", p18)),
            F.when(y.isNotNull() & c.isNotNull(), key(f"{label}-refined", y, c, sex)), F.when((p18 != "") & (s8 != ""), key(f"{label}-place-name", p18, s8)),
        ]
    out.append(F.when(by.isNotNull() & dy.isNotNull(), key("life", by, dy, sex)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def text_score(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence of the sorted, case-folded words over both lengths."""
    x, y = (" ".join(sorted(re.findall(r"\w+", s.casefold()))) for s in (a, b))
    return 100.0 if x == y else 200.0 * lcs(x, y) / (len(x) + len(y)) if x or y else 0.0


def year_bounds(date: str) -> tuple[int, int] | None:
    """Bounds of the years of a date with its qualifier."""
    years = [int(y) for y in re.findall(r"\b\d{4}\b", date)]
    if not years:
        return None
    lo, hi, word = min(years), max(years), date.strip()[:4].upper()
    shift = {"ABT ": (-2, 2), "CAL ": (-2, 2), "EST ": (-2, 2), "BEF ": (-5, -1), "AFT ": (1, 5)}.get(word, (0, 0))
    return lo + shift[0], hi + shift[1]


def date_score(a: str, b: str) -> float:
    """100 for equal dates, 90 where the years can agree, 20 less for each year between them, 0 beyond five."""
    if a.strip().casefold() == b.strip().casefold():
        return 100.0
    x, y = year_bounds(a), year_bounds(b)
    if not x or not y:
        return 0.0
    gap = max(x[0] - y[1], y[0] - x[1])
    return 90.0 if gap <= 0 else max(0.0, 100.0 - 20.0 * gap)


def country_name(text: str) -> str:
    plain = " ".join(re.findall(r"\w+", text.casefold()))
    return COUNTRY_ALIASES.get(plain, plain)


def country_in(place: str) -> str:
    c = country_name(place.rsplit(",", 1)[-1]) if place else ""
    return c if c in KNOWN_COUNTRIES else ""


def weighted(parts: list[tuple[float, float]]) -> float:
    total = sum(w for _, w in parts)
    return sum(s * w for s, w in parts) / total if total else 0.0


def one_to_one(a: list, b: list, score: Callable) -> float:
    """Mean over the shorter list, each item with the best one of the longer list that is still free; the first of equals."""
    few, many = (a, list(b)) if len(a) <= len(b) else (b, list(a))
    got = []
    for x in few:
        scores = [score(x, y) for y in many]
        best = max(range(len(many)), key=scores.__getitem__)
        got.append(scores[best])
        del many[best]
    return sum(got) / len(got)


def fact_score(a: dict, b: dict) -> float:
    if a.get("tag") != b.get("tag"):
        return 0.0
    lands = [f.get("country") and country_name(f["country"]) or country_in(f.get("place") or "") for f in (a, b)]
    found = [(s(a[k], b[k]), FACT_WEIGHTS[k]) for k, s in (("value", text_score), ("date", date_score), ("place", text_score)) if a.get(k) and b.get(k)]
    if all(lands):
        found.append((100.0 * (lands[0] == lands[1]), FACT_WEIGHTS["country"]))
    return weighted(found)


def relative_score(a: dict, b: dict) -> float:
    kinds = (("name", text_score), ("birth_date", date_score), ("death_date", date_score), ("birth_place", text_score), ("death_place", text_score))
    found = [(s(a[k], b[k]), RELATIVE_WEIGHTS[k]) for k, s in kinds if a.get(k) and b.get(k)]
    lands = [country_in(r.get("birth_place") or "") for r in (a, b)]
    if all(lands):
        found.append((100.0 * (lands[0] == lands[1]), RELATIVE_WEIGHTS["birth_country"]))
    if a.get("relationship") and b.get("relationship"):
        found.append((100.0 if a["relationship"].casefold() == b["relationship"].casefold() else 20.0, RELATIVE_WEIGHTS["relationship"]))
    return weighted(found)


@dataclass(frozen=True)
class Assessment:
    score: float
    weight: float
    fields: tuple[str, ...]
    conflicts: tuple[str, ...]

    @property
    def safe(self) -> bool:
        """Enough agreement on enough fields without conflict, and something that anchors the identity besides the name."""
        anchored = bool(ANCHORS & set(self.fields)) or ("family events" in self.fields and len(set(RELATIVES) & set(self.fields)) >= 2)
        return self.score >= SAFE_SCORE and self.weight >= SAFE_WEIGHT and len(self.fields) >= SAFE_FIELDS and not self.conflicts and anchored


def evidence(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of scores from 0 to 100 over those that are not null; null if none is."""
    total = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(s, F.lit(0.0)) * float(w) for s, w in parts), F.lit(0.0)) / total)


def _filled(events: list[dict], key: str) -> list[str]:
    return list(dict.fromkeys(e[key] for e in events or () if e.get(key)))


def _lands(events: list[dict]) -> list[str]:
    named = (e.get("country") and country_name(e["country"]) or country_in(e.get("place") or "") for e in events or ())
    return list(dict.fromkeys(n for n in named if n))


def _years(events: list[dict]) -> set[int]:
    return {int(y) for e in events or () for y in re.findall(r"\b\d{4}\b", e.get("date") or "")}


def assess(a: dict, b: dict) -> Assessment:
    """Scores two persons (dicts of the PERSON shape) over what both state; contradictions lower and cap the score."""
    views: list[tuple[str, list, list, Callable]] = [("name", list(a["names"]), list(b["names"]), text_score)]
    for event in ("birth", "death"):
        x, y = a[event], b[event]
        views += [(f"{event} date", _filled(x, "date"), _filled(y, "date"), date_score), (f"{event} place", _filled(x, "place"), _filled(y, "place"), text_score), (f"{event} country", _lands(x), _lands(y), text_score)]
    views.append(("sex", [a["sex"]] if a["sex"] else [], [b["sex"]] if b["sex"] else [], lambda p, q: 100.0 * (p.casefold() == q.casefold())))
    tagged = lambda p, t: [f for f in p["facts"] or () if f["tag"] == t]
    views += [("occupation", tagged(a, "OCCU"), tagged(b, "OCCU"), fact_score), ("residence", tagged(a, "RESI"), tagged(b, "RESI"), fact_score), ("family events", list(a["marriages"] or ()), list(b["marriages"] or ()), fact_score)]
    views += [(k, list(a[k] or ()), list(b[k] or ()), relative_score) for k in RELATIVES]
    scores = {label: one_to_one(x, y, s) for label, x, y, s in views if x and y}
    shared = sorted(({f["tag"] for f in a["facts"] or ()} & {f["tag"] for f in b["facts"] or ()}) - {"OCCU", "RESI", "BIRT", "DEAT"})
    if shared:
        scores["other standard facts"] = sum(one_to_one(tagged(a, t), tagged(b, t), fact_score) for t in shared) / len(shared)
    conflicts = [k for k in ("name", "partners", "parents") if scores.get(k, 100.0) < LOW[k]]
    if len(a["children"] or ()) > 1 and len(b["children"] or ()) > 1 and scores.get("children", 100.0) < LOW["children"]:
        conflicts.append("children")
    if scores.get("sex", 100.0) < 100.0:
        conflicts.append("sex")
    for event in ("birth", "death"):
        x, y = _years(a[event]), _years(b[event])
        if x and y and all(abs(p - q) > YEARS_APART for p, q in product(x, y)):
            conflicts.append(f"{event} year")
        if any(s and max(s) - min(s) > YEARS_APART for s in (x, y)):
            conflicts.append(f"{event} date alternatives")
        m, n = set(_lands(a[event])), set(_lands(b[event]))
        if m and n and not m & n:
            conflicts.append(f"{event} country")
        if len(m) > 1 or len(n) > 1:
            conflicts.append(f"{event} country alternatives")
    weight = float(sum(WEIGHTS[k] for k in scores))
    score = weighted([(s, WEIGHTS[k]) for k, s in scores.items()])
    if len(scores) == 1:
        score = min(score, ONE_COMPONENT)
    elif weight < ENOUGH_WEIGHT:
        score = min(score, LITTLE_EVIDENCE)
    if conflicts:
        score = min(score - min(CONFLICTS, CONFLICT * len(conflicts)), CONFLICT_CAP)
    return Assessment(round(max(0.0, min(100.0, score)), 2), weight, tuple(scores), tuple(conflicts))


def score_pairs(pairs: DataFrame, people: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(l, r, score, weight, fields, conflicts, safe) for pairs (l, r) of pointers; both persons travel with their pair."""
    names = [c.split()[0] for c in ("pointer", "source", "names", "sex", "birth", "death", "facts", "marriages", *RELATIVES)]
    whole = F.struct(*names)
    joined = pairs.join(people.select(F.col("pointer").alias("l"), whole.alias("a")), "l").join(people.select(F.col("pointer").alias("r"), whole.alias("b")), "r").select("l", "r", "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for left, right, a, b in zip(t["l"], t["r"], _plain(t["a"]), _plain(t["b"]), strict=True):
                s = assess(a, b)
                if s.score >= threshold:
                    rows.append((left, right, s.score, s.weight, list(s.fields), list(s.conflicts), s.safe))
            yield pd.DataFrame(rows, columns=["l", "r", "score", "weight", "fields", "conflicts", "safe"])

    return joined.mapInPandas(run, "l string, r string, score double, weight double, fields array<string>, conflicts array<string>, safe boolean")


def _plain(column) -> Iterator[dict]:  # noqa: ANN001
    """Rows of a struct column, which comes as a frame or as a series of dicts, with lists for arrays."""
    rows = column.to_dict("records") if isinstance(column, pd.DataFrame) else list(column)
    for r in rows:
        r = r if isinstance(r, dict) else r.asDict(True)
        yield {k: ([x.asDict() if hasattr(x, "asDict") else x for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v) for k, v in r.items()}


def merge_people(pair_scores: list[tuple[str, str, float]], people: dict[str, dict], resolver: Callable[[dict, dict], dict] | None = None, limits: Limits = Limits()) -> tuple[dict[str, str], list[dict]]:
    """(canonical pointer of each merged person, decisions): takes candidate pairs from the best on, conservatively.

    Two clusters unite only if no members conflict and the evidence is safe, or a resolver says so with enough confidence.
    Pairs are few: the candidate limit bounds them. Decisions say why a pair was merged or kept apart.
    """
    root = {p: p for p in people}
    members = {p: [p] for p in people}
    calls, per_root, decisions = 0, {}, []

    def top(p: str) -> str:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for left, right, score in sorted(pair_scores, key=lambda t: (-t[2], t[0], t[1]))[: limits.candidates]:
        x, y = top(left), top(right)
        if x == y:
            continue
        said = lambda disposition, **more: decisions.append({"left": x, "right": y, "score": score, "disposition": disposition, **more})  # noqa: B023, E731
        if len(members[x]) > 1 or len(members[y]) > 1:
            clash = sorted({c for p in members[x] for q in members[y] for c in assess(people[p], people[q]).conflicts})
            if clash:
                said("retained-cluster-conflict", conflicts=clash)
                continue
        now = assess(people[x], people[y])
        if HARD & set(now.conflicts):
            said("retained-hard-conflict", conflicts=list(now.conflicts))
            continue
        agreed = now.safe
        if not agreed and resolver:
            if calls >= limits.adjudications or max(per_root.get(x, 0), per_root.get(y, 0)) >= limits.adjudications_per_person:
                said("retained-adjudication-budget")
                continue
            calls += 1
            per_root[x], per_root[y] = per_root.get(x, 0) + 1, per_root.get(y, 0) + 1
            verdict = resolver(people[x], people[y]) or {}
            c = verdict.get("confidence")
            sure = isinstance(c, (int, float)) and not isinstance(c, bool) and RESOLVER_CONFIDENCE <= c <= 1
            agreed = verdict.get("same") is True and sure
        if not agreed:
            said("retained", conflicts=list(now.conflicts))
            continue
        root[y] = x
        members[x] += members.pop(y)
        people[x] = merged_person(people[x], people[y])
        said("merged", fields=list(now.fields))
    return {p: top(p) for p in root if top(p) != p}, decisions


def merged_person(a: dict, b: dict) -> dict:
    """All names, facts and relatives of both, in order and once; the first one's sex unless it has none."""
    unite = lambda k: list({repr(v): v for v in [*(a[k] or ()), *(b[k] or ())]}.values())
    return a | {k: unite(k) for k in ("names", "birth", "death", "facts", "marriages", *RELATIVES)} | {"sex": a["sex"] or b["sex"]}


# Single fields of a person by how they are chosen when two become one.
DATES, PLACES, PLAIN = ("birth_date", "death_date"), ("birth_place", "death_place"), ("given", "surname", "gender")


def choose_fields(first: dict[str, Column], second: dict[str, Column], preferred: dict[str, Column] | None = None) -> dict[str, Column]:
    """The value of each single field of two persons who become one.

    A preferred value counts if it is one of the two. Else a filled one wins over none; the longer date, the first of equals;
    the second place only if it has all words of the first and more; otherwise the first.
    """
    out = {}
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    for name, x in first.items():
        a, b = F.coalesce(x, F.lit("")), F.coalesce(second[name], F.lit(""))
        if name in DATES:
            pick = F.when(F.length(a) >= F.length(b), a).otherwise(b)
        elif name in PLACES:
            pick = F.when((F.size(F.array_except(words(a), words(b))) == 0) & (F.size(F.array_except(words(b), words(a))) > 0), b).otherwise(a)
        else:
            pick = a
        value = F.when(a == "", b).when(b == "", a).otherwise(pick)
        if preferred and name in preferred:
            p = F.trim(F.coalesce(preferred[name], F.lit("")))
            value = F.when((p != "") & ((p == a) | (p == b)), p).otherwise(value)
        out[name] = value
    return out


def merge_groups(scored: DataFrame, people: DataFrame, resolver: Callable[[dict, dict], dict] | None = None, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """((pointer, canonical), decisions) for scored pairs (l, r, score): as merge_people, without bounds, by groups of linked candidates.

    Persons whom no chain of candidates joins can't affect each other, so the groups are the components of the pairs, and in each
    the pairs are taken from the best on. The pairs of a group meet in one task with its persons. A resolver is asked within each
    group, with the bounds of limits for each.
    """
    from stemma.operators.graph import components
    from stemma.tables import settle

    pairs = settle(scored.select("l", "r", F.col("score").cast("double").alias("score")))
    of = components(pairs.select(F.col("l").alias("src"), F.col("r").alias("dst")))
    rows = pairs.join(of, F.col("l") == F.col("node")).select("component", "l", "r", "score", F.lit(None).cast("string").alias("person"))
    who = people.join(of, F.col("pointer") == F.col("node")).select("component", F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("double").alias("score"), F.to_json(F.struct(*people.columns)).alias("person"))
    keys = [c.split()[0] for c in ("pointer", "source", "names", "sex", "birth", "death", "facts", "marriages", *RELATIVES)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import json

        known = {}
        for text in part["person"].dropna():
            p = json.loads(text)
            known[p["pointer"]] = {k: p.get(k) if p.get(k) is not None else ("" if k in ("pointer", "source", "sex") else []) for k in keys}
        known = {k: p | {c: [{f: x.get(f, "") or "" for f in _FACT} | ({"tag": x["tag"]} if "tag" in x else {}) for x in p[c]] for c in ("birth", "death", "facts", "marriages")} for k, p in known.items()}
        found = part[part["l"].notna()]
        merged, decisions = merge_people([(r.l, r.r, r.score) for r in found.itertuples() if r.l in known and r.r in known], known, resolver, limits)
        rows = [(p, c, None, None, None, None, None) for p, c in merged.items()]
        rows += [(None, None, d["left"], d["right"], d["score"], d["disposition"], ", ".join(d.get("conflicts") or d.get("fields") or ())) for d in decisions]
        return pd.DataFrame(rows, columns=["pointer", "canonical", "l", "r", "score", "disposition", "evidence"])

    out = settle(rows.unionByName(who).groupBy("component").applyInPandas(run, "pointer string, canonical string, l string, r string, score double, disposition string, evidence string"))
    return out.where("pointer is not null").select("pointer", "canonical"), out.where("pointer is null").select("l", "r", "score", "disposition", "evidence")


_FACT = ("value", "date", "place", "country")
