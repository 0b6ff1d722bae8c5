"""Keeping a master tree in step with periodic snapshots: block hashes, bindings, removal, tombstones and generations."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import fold, squash
from stemma.sources import gedcom
from stemma.sources.structure import ATTACHMENT_TAGS, CITATION_TAGS

# Level-1 structures that a snapshot may take away again; parts of a citation that it has once.
REMOVABLE = (*gedcom.EVENT_TAGS, *gedcom.FAMILY_EVENT_TAGS)
SINGLE = ("DATE", "PAGE", "EVEN", "ROLE", "QUAY")
MATCH_SCORE, RESOLVER_CONFIDENCE = 78, 0.90


def block_hash(tag: Column, value: Column, children: Column) -> Column:
    """The hash of what a structure says: tag, squashed folded value, and its children's tags and values in order of text.

    children is an array of struct(tag, value); notes, media and citations do not belong to it.
    """
    semantic = F.filter(children, lambda c: ~c["tag"].isin("NOTE", "OBJE", "SOUR"))
    rows = F.array_sort(F.transform(semantic, lambda c: F.concat_ws(" ", c["tag"], fold(squash(F.coalesce(c["value"], F.lit("")))))))
    return F.sha2(F.concat_ws("\n", tag, fold(squash(F.coalesce(value, F.lit("")))), F.array_join(rows, "\n")), 256)


def bind_people(incoming: DataFrame, bindings: DataFrame, ids: DataFrame, master_ids: DataFrame, prints: DataFrame, master_prints: DataFrame) -> DataFrame:
    """(person, master, how, n): the master person of each incoming one: by an earlier binding, else by a stable id, else by fingerprint.

    n tells how many masters the best way leads to; only n = 1 is a match, others stay unresolved. People without any are
    left out, and become new.
    """
    by = bindings.select("person", "master", F.lit(1).alias("rank"), F.lit("binding").alias("how"))
    same_id = ids.join(master_ids.select("id", "master"), "id").select("person", "master", F.lit(2).alias("rank"), F.lit("identifier").alias("how"))
    same_print = prints.join(master_prints.select("print", "master"), "print").select("person", "master", F.lit(3).alias("rank"), F.lit("fingerprint").alias("how"))
    every = by.unionAll(same_id).unionAll(same_print).join(incoming.select("person").distinct(), "person", "left_semi").distinct()
    best = every.groupBy("person").agg(F.min("rank").alias("rank"))
    return every.join(best, ["person", "rank"]).groupBy("person", "how").agg(F.min("master").alias("master"), F.countDistinct("master").alias("n")).select("person", "master", "how", "n")


def match_people(incoming: DataFrame, bindings: DataFrame, ids: DataFrame, master_ids: DataFrame, prints: DataFrame, master_prints: DataFrame, scores: DataFrame) -> DataFrame:
    """As bind_people, over evidence: an earlier binding holds only with MATCH_SCORE, and a safe score is a way of its own.

    scores is what identity.score_pairs says of (person, master) as (l, r); it must have the pairs of every way, and a pair
    in conflict or without a score leads nowhere. All ways count together: n tells the masters that are left, how the best way.
    """
    s = scores.where(F.size("conflicts") == 0).select(F.col("l").alias("person"), F.col("r").alias("master"), "score", "safe")
    way = lambda df, rank, how: df.select("person", "master", F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("how")).alias("way"))
    keys = ["person", "master"]
    every = (
        way(bindings.join(s.where(F.col("score") >= MATCH_SCORE), keys, "left_semi"), 1, "binding")
        .unionAll(way(ids.join(master_ids.select("id", "master"), "id").join(s, keys, "left_semi"), 2, "identifier"))
        .unionAll(way(prints.join(master_prints.select("print", "master"), "print").join(s, keys, "left_semi"), 3, "fingerprint"))
        .unionAll(way(s.where("safe"), 4, "score"))
    )
    found = every.join(incoming.select("person").distinct(), "person", "left_semi").groupBy("person").agg(F.min(F.struct("way", "master")).alias("best"), F.countDistinct("master").alias("n"))
    return found.select("person", F.col("best.master").alias("master"), F.col("best.way.how").alias("how"), "n")


def fingerprint(full_name: Column, birth_date: Column, birth_place: Column, death_date: Column, death_place: Column, sex: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *(F.lower(squash(F.coalesce(c, F.lit("")))) for c in (full_name, birth_date, birth_place, death_date, death_place)), F.upper(F.coalesce(sex, F.lit("")))), 256)


def reconcile(state: DataFrame, observed: DataFrame, tombstones: DataFrame, generation: int) -> DataFrame:
    """The next state of blocks (person, hash, tag, protected, cited, sources, first_generation, last_generation).

    state has these columns. observed has person, hash, tag, cited and source, the blocks of all snapshots now in force.
    Observed blocks come in unless a tombstone names their hash. A block that no snapshot has any more goes only if it is
    not protected, not cited, of a removable kind, and came from a snapshot. Everything else stays as it is.
    """
    alive = observed.join(tombstones.select("person", "hash").distinct(), ["person", "hash"], "left_anti")
    now = alive.groupBy("person", "hash").agg(F.first("tag").alias("tag2"), F.max("cited").alias("cited2"), F.sort_array(F.collect_set("source")).alias("now"))
    both = state.join(now, ["person", "hash"], "full")
    none = F.array().cast("array<string>")
    out = both.select(
        "person", "hash", F.coalesce("tag", "tag2").alias("tag"), F.coalesce("protected", F.lit(False)).alias("protected"),
        (F.coalesce("cited", F.lit(False)) | F.coalesce("cited2", F.lit(False))).alias("cited"), F.coalesce("now", none).alias("now"), F.coalesce("sources", none).alias("before"),
        F.coalesce("first_generation", F.lit(generation)).alias("first_generation"), F.when(F.col("now").isNotNull(), generation).otherwise(F.col("last_generation")).alias("last_generation"),
    )
    gone = (F.size("now") == 0) & (F.size("before") > 0) & ~F.col("protected") & ~F.col("cited") & F.col("tag").isin(*REMOVABLE)
    kept = out.where(~gone)
    return kept.withColumn("sources", F.when(F.size("now") > 0, F.col("now")).otherwise(F.col("before"))).drop("now", "before").select("person", "hash", "tag", "protected", "cited", "sources", "first_generation", "last_generation")


def register(registry: DataFrame, seen: DataFrame, tombstones: DataFrame, active: DataFrame, generation: int, initialize: bool = False) -> DataFrame:
    """(person, hash, tag, logical, protected, observations, first_seen, last_seen, fate): the registry after a generation.

    registry has all of these but fate. seen has person, hash, tag, logical, cited and snapshot, null for the master's own blocks.
    A block from a snapshot that a tombstone names, by its hash or by its place in a life, has the fate `tombstone` and is
    not taken up; the master's own stays. A block of the master that no snapshot in force holds any more, and that is not
    protected, is `removed` if it is of a removable kind and not cited, else `kept`. `added` is new from some snapshot, `same` the rest. The
    first generation protects all blocks as the baseline. active (snapshot) are the snapshots in force.
    """
    none = F.array().cast("array<string>")
    keys = ["person", "hash"]
    dead = seen.join(tombstones.select(*keys).distinct(), keys, "left_semi").select(*keys).unionAll(seen.join(tombstones.where("logical is not null").select("person", "logical").distinct(), ["person", "logical"], "left_semi").select(*keys)).distinct()
    now = seen.groupBy(*keys).agg(
        F.min("tag").alias("now_tag"), F.min("logical").alias("now_logical"), F.max(F.col("snapshot").isNull()).alias("own"), F.array_sort(F.collect_set("snapshot")).alias("snaps"), F.max("cited").alias("cited")
    ).join(dead.withColumn("dead", F.lit(True)), keys, "left")
    now = now.withColumn("snaps", F.when(F.col("dead"), none).otherwise(F.col("snaps")))
    both = registry.join(now, keys, "full")
    guard = F.when(F.lit(initialize) & F.coalesce("own", F.lit(False)), F.array(F.lit("baseline"))).otherwise(none)
    out = both.select(
        *keys, F.coalesce("tag", "now_tag").alias("tag"), F.coalesce("logical", "now_logical").alias("logical"), F.array_union(F.coalesce("protected", none), guard).alias("protected"),
        F.array_sort(F.array_union(F.coalesce("observations", none), F.coalesce("snaps", none))).alias("observations"), F.coalesce("first_seen", F.lit(generation)).alias("first_seen"),
        F.when(F.col("own").isNotNull(), generation).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("dead", F.lit(False)).alias("dead"),
        F.coalesce("cited", F.lit(False)).alias("cited"), (F.size(F.array_except(F.coalesce("snaps", none), F.coalesce("observations", none))) > 0).alias("new"),
    )
    held = out.select(*keys, F.explode("observations").alias("snapshot")).join(active.select("snapshot").distinct(), "snapshot", "left_semi").select(*keys).distinct().withColumn("held", F.lit(True))
    out = out.join(held, keys, "left")
    in_force = F.coalesce("held", F.lit(False))
    absent = F.col("own") & ~in_force & (F.size("protected") == 0)
    fate = F.when(F.col("dead") & ~F.col("own"), "tombstone").when(absent & F.col("tag").isin(*REMOVABLE) & ~F.col("cited"), "removed").when(absent, "kept").when(F.col("new"), "added").otherwise("same")
    return out.select(*keys, "tag", "logical", "protected", "observations", "first_seen", "last_seen", fate.alias("fate"))


def agreed(verdict: dict | None) -> bool:
    """Whether a resolver says that two people are one, with a finite confidence of at least RESOLVER_CONFIDENCE; whatever else it says is no."""
    v = verdict or {}
    c = v.get("confidence")
    return v.get("same") is True and isinstance(c, (int, float)) and not isinstance(c, bool) and math.isfinite(c) and RESOLVER_CONFIDENCE <= c <= 1


def _plain(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def _parts(lines: list[dict]) -> tuple[list[dict], list[list[dict]]]:
    """The lines of a block without its notes, media and citations, and these, each with its lines."""
    core, attached, into = [lines[0]], [], None
    for line in lines[1:]:
        if line["level"] == 2:
            into = [] if line["tag"] in ATTACHMENT_TAGS else None
            if into is not None:
                attached.append(into)
        (core if into is None else into).append(line)
    return core, attached


def _content(lines: list[dict]) -> tuple:
    return tuple((x["level"], x["tag"], _plain(x["text"])) for x in lines)


def _identity(lines: list[dict]) -> tuple:
    """Source, page, event and role of a citation: what it cites."""
    first = {t: next((_plain(x["text"]) for x in lines[1:] if x["tag"] == t), "") for t in CITATION_TAGS}
    return (_plain(lines[0]["text"]), *first.values())


def _below(lines: list[dict]) -> list[list[dict]]:
    """The structures directly below a citation."""
    at = [i for i, x in enumerate(lines) if x["level"] == 3]
    return [lines[i:j] for i, j in zip(at, [*at[1:], len(lines)], strict=True)]


def _united(a: list[dict], b: list[dict]) -> list[dict] | None:
    """Two citations of one identity as one with the parts of both, None where a single part contradicts."""
    said = lambda c, t: {_plain(x["text"]) for x in c[1:] if x["tag"] == t}
    if any(said(a, t) and said(b, t) and said(a, t) != said(b, t) for t in SINGLE):
        return None
    out = list(a)
    have = {_content(p) for p in _below(a)}
    single = {p[0]["tag"] for p in _below(a)} & {*SINGLE, "DATA"}
    for p in _below(b):
        if _content(p) in have:
            continue
        if p[0]["tag"] not in single:
            out += p
        elif p[0]["tag"] == "DATA":
            at = next(i for i, x in enumerate(out) if x["level"] == 3 and x["tag"] == "DATA") + 1
            mine = {_content([x]) for x in out[at:]}
            out[at:at] = [x for x in p[1:] if _content([x]) not in mine]
        have.add(_content(p))
    return out


def unite_block(part: pd.DataFrame) -> pd.DataFrame:
    """One row of the blocks of one person and key: the first file's fact with the notes, media and citations of all.

    The n-th citation that a file has of one identity is united with the n-th there is, unless they contradict; so no citation
    is repeated because several files have it, and none is lost that one file has twice.
    """
    rows = part.sort_values(["ord", "rec", "block"]).to_dict("records")
    core, slots, attached, repeated = None, [], 0, 0
    for row in rows:
        mine, more = _parts(json.loads(row["lines"]))
        core, met = core or mine, {}
        first = row is rows[0]
        for a in more:
            cites = a[0]["tag"] == "SOUR"
            what = _identity(a) if cites else _content(a)
            n = met[what] = met.get(what, 0) + 1
            at = [i for i, (w, _) in enumerate(slots) if w == what]
            if first or len(at) < n:
                slots.append((what, a))
                attached += not first and cites
                continue
            have = slots[at[n - 1]][1]
            if _content(have) == _content(a):
                repeated += cites
            elif (both := _united(have, a)) is not None:
                slots[at[n - 1]] = (what, both)
                attached += 1
            elif all(_content(slots[i][1]) != _content(a) for i in at):
                slots.append((what, a))
                attached += 1
    head = rows[0]
    lines = [*core, *(x for _, a in slots for x in a)]
    lines = [x | {"pos": i} for i, x in enumerate(lines)]
    cited = any(x["tag"] == "SOUR" for x in lines[1:])
    out = {k: [head[k]] for k in ("target", "record", "key", "tag", "logical")} | {"cited": [cited], "ord": [head["ord"]], "rec": [head["rec"]], "block": [head["block"]]}
    return pd.DataFrame(out | {"lines": [json.dumps(lines, ensure_ascii=False)], "attached": [int(attached)], "repeated": [int(repeated)]})


def rebase(state: DataFrame, edited: DataFrame, accept_deletions: bool, generation: int) -> tuple[DataFrame, DataFrame]:
    """(state, tombstones) after a master was edited by hand: added blocks are protected, deleted ones become tombstones.

    edited has person, hash, tag and cited of the whole edited master. Deletions need consent.
    """
    keys = ["person", "hash"]
    added, removed = edited.join(state.select(*keys), keys, "left_anti"), state.join(edited.select(*keys), keys, "left_anti")
    if not accept_deletions and not removed.isEmpty():
        raise ValueError("the edited master lacks blocks; deletions need consent")
    manual = added.select("person", "hash", "tag", F.lit(True).alias("protected"), "cited", F.array(F.lit("manual")).alias("sources"), F.lit(generation).alias("first_generation"), F.lit(generation).alias("last_generation"))
    return state.join(edited.select(*keys), keys, "left_semi").unionByName(manual), removed.select("person", "hash")


def citation_union(citations: DataFrame) -> DataFrame:
    """(block, key, copies): citations of a block, as many copies of each as the one origin has that has most."""
    return citations.groupBy("block", "origin", "key").agg(F.count("*").alias("n")).groupBy("block", "key").agg(F.max("n").alias("copies"))


def consolidate(records: DataFrame) -> DataFrame:
    """(pointer, representative): records of equal tag and content go by their smallest pointer."""
    least = records.groupBy("tag", "content").agg(F.min("pointer").alias("representative"))
    return records.join(least, ["tag", "content"]).select("pointer", "representative")


def accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: blocks added, removed, kept and newly seen again."""
    keys = ["person", "hash"]
    b, a = before.select(*keys, F.lit(1).alias("b"), "last_generation"), after.select(*keys, F.lit(1).alias("a"), F.col("last_generation").alias("now"))
    j = b.join(a, keys, "full")
    return j.agg(
        F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"),
        F.count_if(F.col("now") > F.col("last_generation")).alias("seen_again"),
    )


def report(counts: DataFrame) -> str:
    r = counts.first().asDict()
    return "# Update report\n\n" + "".join(f"- {k.replace('_', ' ')}: {v}\n" for k, v in r.items())
