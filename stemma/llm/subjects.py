"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs, per sentence.

A document is about a subject if at least two of its sentences treat it. Labels name documents, not sentences, so the
model gives each sentence a probability per subject and is trained on the probability that two or more sentences of the
document are positive. Text is cut and hashed in NumPy over whole batches; scoring reduces to one small vector per
distinct word, because the outputs are linear in the averaged embeddings.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.tables import settle

#: The classifier is fitted on at most so many labelled documents (chosen by a hash of doc_id); every document is scored.
MAX_LABELLED = 6_000
DIMENSIONS, ROUNDS, RATE, DECAY = 16, 34, 0.2, 3e-6
#: Workers that hold the labelled documents and send one gradient each per round.
WORKERS = 4
#: A word or subword counts if so many labelled documents have it.
LEAST_DOCUMENTS = 3
THRESHOLD = 0.3
#: Characters that are cut at a time; whole texts, so a longer one is taken alone.
CHUNK_CHARS = 3_000_000
#: A word with the share p of all words weighs RARE / (RARE + p) in the average, one that is not known UNKNOWN.
RARE, UNKNOWN = 3e-4, 0.3
_SEED, _B = 17, np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(4096, _B, dtype=np.uint64))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, dtype=bool)
_END[[33, 46, 63]] = True
_HYPHEN = re.compile(r"[-­]\s*\n\s*")


@dataclass
class Cut:
    """A batch of texts: word code and sentence of every word, the document of every sentence, and the distinct words."""

    codes: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    raw: np.ndarray


def cut(texts: list[str | None]) -> Cut:
    """Words are runs of letters and digits that do not start with a digit. A sentence ends at . ! or ? before white space,

    but not after a single letter or a number of one or two digits. Line ends are blanks, hyphens before them go.
    """
    # NUL bytes part the texts; those in a text are blanks
    joined = " \x00 ".join(_HYPHEN.sub("", t).replace("\x00", " ").lower() if t else "" for t in texts)
    b = np.frombuffer((" " + joined + "    ").encode("utf-8", "ignore"), dtype=np.uint8)
    letter = _LETTER[b]
    edge = np.diff(letter.view(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    length = stop - start
    # sentence ends
    at = np.flatnonzero(_END[b])
    at = at[_SPACE[b[at + 1]] | (b[at + 1] == 0) | (_SPACE[b[np.minimum(at + 2, len(b) - 1)]] & ~_LETTER[b[at + 1]])]
    p1, p2, p3 = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    single = _LETTER[p1] & ~_LETTER[p2]
    short = _DIGIT[p1] & _DIGIT[p2] & ~_LETTER[p3]
    at = at[~(single | short)]
    nul = np.flatnonzero(b == 0)
    ends = np.sort(np.concatenate([at, nul]))
    keep = (length > 1) & ~_DIGIT[b[start]]
    start, length = start[keep], length[keep]
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return Cut(z, z, z, np.zeros(0, dtype=np.uint64), z, z, b)
    place = np.searchsorted(ends, start)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    sentence = np.cumsum(new) - 1
    document = np.searchsorted(nul, start[new])
    total = int(length.sum())
    first = np.cumsum(length) - length
    inside = np.arange(total) - np.repeat(first, length)
    longest = int(length.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _B, dtype=np.uint64))
    values = (b[np.repeat(start, length) + inside].astype(np.uint64) + np.uint64(1)) * powers[inside]
    hashes = np.add.reduceat(values, first)
    codes, distinct = pd.factorize(hashes)
    rep = np.empty(len(distinct), dtype=np.int64)
    rep[codes[::-1]] = np.arange(len(codes))[::-1]
    return Cut(codes, sentence, document, np.asarray(distinct, dtype=np.uint64), start[rep], length[rep], b)


def subwords(c: Cut) -> tuple[np.ndarray, np.ndarray]:
    """(hash, distinct word) of every run of 3 to 5 bytes of every distinct word with its ends marked, and of the word itself."""
    n = c.length + 2
    first = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(first, n)
    source = np.repeat(c.begin, n) + inside - 1
    flat = c.raw[np.clip(source, 0, len(c.raw) - 1)].astype(np.uint64)
    flat[first] = np.uint64(60)
    flat[first + n - 1] = np.uint64(62)
    word = np.repeat(np.arange(len(n)), n)
    left = np.repeat(n, n) - inside
    hashes, owner = [c.hashes ^ np.uint64(0x9E3779B97F4A7C15)], [np.arange(len(n))]
    for k in (3, 4, 5):
        ok = np.flatnonzero(left >= k)
        h = np.full(len(ok), np.uint64(k), dtype=np.uint64)
        for i in range(k):
            h = h * _B + flat[ok + i]
        hashes.append(h)
        owner.append(word[ok])
    return np.concatenate(hashes), np.concatenate(owner)


@dataclass
class Model:
    """Sorted hashes of the known words and subwords, their shares of all words, their embeddings, and the outputs."""

    keys: np.ndarray
    share: np.ndarray
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    codes: list[str]


def _sum_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(group, values[:, j], n)
    return out


class Prepared:
    """What a batch of texts needs of a vocabulary: known parts of its distinct words, and its words by sentence."""

    def __init__(self, c: Cut, keys: np.ndarray, share: np.ndarray) -> None:
        h, owner = subwords(c)
        rows = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0)) if len(keys) else np.zeros(len(h), dtype=np.int64)
        known = keys[rows] == h if len(keys) else np.zeros(len(h), dtype=bool)
        self.rows, self.owner, self.distinct = rows[known], owner[known], len(c.hashes)
        self.parts = np.maximum(np.bincount(owner, minlength=self.distinct), 1).astype(np.float64)[:, None]
        self.codes, self.sentence, self.document, self.keys = c.codes, c.sentence, c.document, len(keys)
        self._average(np.where(known, rows, -1)[: self.distinct], share)  # the first parts are the words themselves

    @classmethod
    def load(cls, z: dict[str, np.ndarray], m: Model) -> Prepared:
        """From the arrays that a worker keeps of its documents."""
        p = cls.__new__(cls)
        p.rows, p.owner, p.codes, p.sentence, p.document = z["rows"], z["owner"], z["codes"], z["sentence"], z["document"]
        p.distinct, p.keys = len(z["parts"]), len(m.keys)
        p.parts = np.maximum(z["parts"], 1).astype(np.float64)[:, None]
        p._average(z["word"], m.share)
        return p

    def _average(self, word: np.ndarray, share: np.ndarray) -> None:
        """The oftener a word is used, the less it weighs in the average of its sentence; `word` is its row or -1."""
        of_word = np.where(word >= 0, RARE / (RARE + share[word]), UNKNOWN) if len(share) else np.ones(self.distinct)
        self.weight = of_word[self.codes]
        words = np.bincount(self.sentence, minlength=len(self.document))
        self.first = np.cumsum(words) - words
        self.total = np.bincount(self.sentence, self.weight, len(self.document))[:, None]

    def logits(self, per_word: np.ndarray, bias: np.ndarray) -> np.ndarray:
        if not len(self.document):
            return np.zeros((0, per_word.shape[1]))
        return np.add.reduceat(per_word[self.codes] * self.weight[:, None], self.first, axis=0) / self.total + bias


def sentence_scores(c: Cut, m: Model) -> np.ndarray:
    """The logit of every sentence and subject; words sum the outputs of their parts, as these are linear."""
    p = Prepared(c, m.keys, m.share)
    per_word = _sum_by((m.embeddings @ m.weights)[p.rows], p.owner, p.distinct) / p.parts
    return p.logits(per_word, m.bias)


def _few(z: np.ndarray, document: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """The odds summed by document, and the probability that at most one sentence of it is positive."""
    odds = _sum_by(np.exp(z), document, documents)
    return odds, np.exp(np.log1p(odds) - _sum_by(np.logaddexp(0, z), document, documents))


def two_or_more(logits: np.ndarray, document: np.ndarray, documents: int) -> np.ndarray:
    """For each document and subject the probability that at least two sentences are positive."""
    return 1 - _few(np.clip(logits, -30, 30), document, documents)[1]


def gradient(p: Prepared, y: np.ndarray, m: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss and the gradients of embeddings, weights and bias over the documents of one worker."""
    word_vec = _sum_by(m.embeddings[p.rows], p.owner, p.distinct) / p.parts
    z = np.clip(p.logits(word_vec @ m.weights, m.bias), -30, 30)
    odds, few = _few(z, p.document, len(y))
    few = np.clip(few, 1e-9, 1 - 1e-9)
    loss = -(y * np.log(1 - few) + (1 - y) * np.log(few)).sum()
    scale = np.where(y > 0, -few / (1 - few), 1.0)
    e = np.exp(z)
    dz = scale[p.document] * (e / (1 + e) - e / (1 + odds[p.document]))
    at_word = _sum_by((dz / p.total)[p.sentence] * p.weight[:, None], p.codes, p.distinct)
    back = (at_word @ m.weights.T) / p.parts
    return float(loss), _sum_by(back[p.owner], p.rows, p.keys), word_vec.T @ at_word, dz.sum(axis=0)


def new_model(keys: np.ndarray, share: np.ndarray, codes: list[str]) -> Model:
    r = np.random.default_rng(_SEED)
    e = r.normal(0, 0.3, (len(keys), DIMENSIONS))
    w = r.normal(0, 1.0, (DIMENSIONS, len(codes)))
    return Model(keys, share, e, w, np.full(len(codes), -3.0), codes)


class Adam:
    def __init__(self) -> None:
        self.t, self.m, self.v = 0, {}, {}

    def step(self, name: str, x: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        self.v[name] = 0.98 * self.v.get(name, 0) + 0.02 * g * g
        x -= rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.v[name] / (1 - 0.98**self.t)) + 1e-8)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def labelled_sample(docs: DataFrame, labels: DataFrame, codes: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """(worker, doc_id, text, subjects) of at most `most` labelled documents, dealt to the workers by a hash of doc_id."""
    marks = labels.where(F.col("subject_code").isin(codes) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_code")).alias("subjects"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.where(F.length("text") > 0).select("doc_id", "text").join(chosen, "doc_id").withColumn("worker", F.pmod(F.xxhash64("doc_id"), F.lit(WORKERS)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, codes: list[str]) -> Model:
    """Fits a model on the labelled sample. Each round every worker sends the gradient over its documents; their sum moves the model.

    The sample is bounded, so the gradients, the vocabulary and the model are too. Without labels the model knows no word
    and finds no subject.
    """
    spark = docs.sparkSession
    sample = settle(labelled_sample(docs, labels, codes).repartition(WORKERS, "worker").sortWithinPartitions("worker", "doc_id"))

    def words(part: pd.DataFrame) -> pd.DataFrame:
        c = cut(list(part.sort_values("doc_id")["text"]))
        h, owner = subwords(c)
        n = max(1, len(c.hashes))
        documents = np.bincount(np.unique(c.document[c.sentence] * n + c.codes) % n, minlength=n)
        uses = np.bincount(c.codes, minlength=n)
        keys, at = np.unique(h, return_inverse=True)
        return pd.DataFrame({"key": keys.view(np.int64), "documents": np.bincount(at, documents[owner], len(keys)).astype("int64"), "uses": np.bincount(at, uses[owner], len(keys)).astype("int64"), "words": len(c.codes)})

    counted = sample.groupBy("worker").applyInPandas(lambda part: words(part), "key long, documents long, uses long, words long")
    kept = counted.groupBy("key").agg(F.sum("documents").alias("documents"), F.sum("uses").alias("uses")).where(F.col("documents") >= LEAST_DOCUMENTS).toPandas()
    keys = kept["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = np.ascontiguousarray(keys[order])
    share = kept["uses"].to_numpy(dtype=np.float64)[order]
    vocabulary = spark.sparkContext.broadcast((keys, share))
    index = {c: i for i, c in enumerate(codes)}

    def prepare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        y = np.zeros((len(part), len(codes)), dtype=np.float32)
        for i, subjects in enumerate(part["subjects"]):
            y[i, [index[s] for s in subjects]] = 1
        k, used = vocabulary.value
        c = cut(list(part["text"]))
        h, owner = subwords(c)
        at = np.minimum(np.searchsorted(k, h), max(len(k) - 1, 0)) if len(k) else np.zeros(len(h), dtype=np.int64)
        known = k[at] == h if len(k) else np.zeros(len(h), dtype=bool)
        blob = _pack(
            y=y, codes=c.codes.astype(np.int32), sentence=c.sentence.astype(np.int32), document=c.document.astype(np.int32), rows=at[known].astype(np.int32), touched=np.unique(at[known]).astype(np.int32), owner=owner[known].astype(np.int32),
            parts=np.bincount(owner, minlength=len(c.hashes)).astype(np.int32), word=np.where(known, at, -1)[: len(c.hashes)].astype(np.int32),
        )
        return pd.DataFrame({"worker": [int(part["worker"].iloc[0])], "n": [len(part)], "words": [len(c.codes)], "blob": [blob]})

    ready = settle(sample.groupBy("worker").applyInPandas(lambda part: prepare(part), "worker int, n long, words long, blob binary"))
    size = ready.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    model = new_model(keys, share / max(1, size["words"] or 1), codes)
    if not size["n"]:
        return model
    adam = Adam()
    schema = T.StructType([T.StructField("worker", T.IntegerType()), T.StructField("blob", T.BinaryType())])
    known = spark.sparkContext.broadcast((model.keys, model.share))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.embeddings.astype(np.float32), model.weights, model.bias))

        def gradients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for worker, blob in zip(b["worker"], b["blob"], strict=True):
                    z, (embeddings, weights, outputs) = _unpack(blob), sent.value  # noqa: B023
                    m = Model(*known.value, embeddings.astype(np.float64), weights, outputs, codes)
                    _, e, w, bias = gradient(Prepared.load(z, m), z["y"], m)
                    # only what the worker's documents touch
                    rows = z["touched"]
                    yield pd.DataFrame({"worker": [worker], "blob": [_pack(e=e[rows].astype(np.float32), rows=rows, w=w, bias=bias)]})

        sums = {"e": np.zeros_like(model.embeddings), "w": np.zeros_like(model.weights), "bias": np.zeros_like(model.bias)}
        for r in sorted(ready.select("worker", "blob").mapInPandas(gradients, schema).collect(), key=lambda r: r["worker"]):
            z = _unpack(r["blob"])
            sums["e"][z["rows"]] += z["e"].astype(np.float64) / size["n"]
            sums["w"] += z["w"] / size["n"]
            sums["bias"] += z["bias"] / size["n"]
        sent.destroy()
        adam.t += 1
        adam.step("e", model.embeddings, sums["e"] + DECAY * model.embeddings, RATE)
        adam.step("w", model.weights, sums["w"] + DECAY * model.weights, RATE)
        adam.step("bias", model.bias, sums["bias"], RATE)
    return model


def subject_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, subject_code, probability) of the subjects that each document is about; whole texts, every document.

    Empty and null texts are about nothing. Documents with equal ids are scored each.
    """
    # outputs are linear in the embeddings, so only the output of each known part is sent
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.share, (model.embeddings @ model.weights).astype(np.float32), model.bias, model.codes))

    def chunks(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        number = np.cumsum(b["text"].str.len().to_numpy(dtype=np.int64)) // CHUNK_CHARS
        for _, part in b.groupby(number, sort=False):
            yield part

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, share, outputs, bias, codes = sent.value
        names = np.array(codes, dtype=object)
        for b in batches:
            for part in chunks(b):
                c = cut(list(part["text"]))
                p = Prepared(c, keys, share)
                per_word = _sum_by(outputs[p.rows], p.owner, p.distinct) / p.parts
                q = two_or_more(p.logits(per_word, bias), c.document, len(part))
                i, j = np.nonzero(q > threshold)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[i], "subject_code": names[j], "probability": q[i, j]})

    return docs.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(score, "doc_id long, subject_code string, probability double")


def area_codes(areas: DataFrame, most: int = 10_000) -> list[str]:
    """The subject codes in order; the list of areas is small, and its size is checked."""
    codes = [r["subject_code"] for r in areas.select("subject_code").where("subject_code is not null").distinct().limit(most + 1).collect()]
    if len(codes) > most:
        raise ValueError(f"more than {most} subject areas")
    return sorted(codes)


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject_code, probability): trains on the labels and scores every document."""
    codes = area_codes(areas)
    return subject_scores(docs, train(docs, labels, codes))
