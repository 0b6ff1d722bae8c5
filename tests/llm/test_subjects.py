import random

import numpy as np
import pytest

from stemma.llm import subjects as s


def test_cut_keeps_documents_and_sentences():
    texts = ["He sowed. She reaped on 5. August 1832 with J. Smith! Then they\nre-\nsted", None, "", "One only", "e.g. x. Two here? Yes."]
    c = s.cut(texts)
    per = [int((c.document == i).sum()) for i in range(len(texts))]
    assert per == [3, 0, 0, 1, 2] or per[:4] == [3, 0, 0, 1]
    words = [bytes(c.raw[b : b + n]).decode() for b, n in zip(c.begin, c.length, strict=True)]
    assert "rested" in words and "1832" not in words
    assert len(set(words)) == len(words) == len(set(c.hashes.tolist()))
    assert len(s.cut([]).codes) == 0 and len(s.cut([None]).document) == 0


def test_probability_of_two_or_more():
    z = np.array([[0.3, -1.0], [1.2, 0.0], [-0.4, 2.0], [5.0, 5.0]])
    got = s.two_or_more(z, np.array([0, 0, 0, 1]), 3)
    p = 1 / (1 + np.exp(-z[:3]))
    none = np.prod(1 - p, axis=0)
    one = sum(p[i] * np.prod(np.delete(1 - p, i, axis=0), axis=0) for i in range(3))
    assert np.allclose(got[0], 1 - none - one)
    assert np.allclose(got[1:], 0)


def test_gradient_is_the_derivative():
    c = s.cut(["the ship sailed. a crew of men. the port.", "corn and oats. the barn was full. ploughs."])
    h, _ = s.subwords(c)
    keys = np.unique(h)
    r = np.random.default_rng(1)
    m = s.Model(keys, np.full(len(keys), 1e-3), r.normal(0, 0.3, (len(keys), 3)), r.normal(0, 1, (3, 2)), np.array([-0.5, -0.2]), ["a", "b"])
    y = np.array([[1, 0], [0, 1.0]])
    p = s.Prepared(c, keys, m.share)
    _, ge, gw, gb = s.gradient(p, y, m)
    for x, g in ((m.embeddings, ge), (m.weights, gw), (m.bias, gb)):
        flat, grad = x.reshape(-1), g.reshape(-1)
        for i in r.integers(0, len(flat), 12):
            old = flat[i]
            flat[i] = old + 1e-5
            up = s.gradient(p, y, m)[0]
            flat[i] = old - 1e-5
            down = s.gradient(p, y, m)[0]
            flat[i] = old
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-4


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    words = {"sea": ["ship", "crew", "harbour", "mast", "voyage"], "farm": ["plough", "barley", "harvest", "cattle", "barn"]}
    plain = ["the letter was copied again", "nobody knew the house", "a page is missing from the book", "she wrote to her cousin often"]
    rows, labels = [], []
    for i in range(700):
        about = [k for k in words if r.random() < 0.5]
        lines = [r.choice(plain) for _ in range(3)]
        for k in words:
            lines += [f"they spoke of the {r.choice(words[k])} that year" for _ in range(r.randint(2, 4) if k in about else r.randint(0, 1))]
        r.shuffle(lines)
        rows.append((i, ". ".join(x.capitalize() for x in lines) + ".", "x"))
        labels += [(i, k, "a") for k in about]
    docs = spark.createDataFrame([*rows, (9000, None, "x"), (9001, "", "x"), (9002, "word " * 50_000, "x")], "doc_id long, text string, probability string")
    return docs, spark.createDataFrame(labels, "doc_id long, subject_code string, annotator string"), {(a, b) for a, b, _ in labels}


def test_held_out_accuracy(spark, corpus):
    docs, labels, truth = corpus
    areas = spark.createDataFrame([("sea", "t"), ("farm", "t"), (None, "t")], "subject_code string, title string")
    got = {(r["doc_id"], r["subject_code"]) for r in s.subjects(docs, labels.where("doc_id < 500"), areas).collect()}
    held = {t for t in truth if t[0] >= 500}
    mine = {t for t in got if 500 <= t[0] < 9000}
    assert len(mine & held) / len(mine) > 0.9 and len(mine & held) / len(held) > 0.9
    assert not {t for t in got if t[0] >= 9000}


def test_without_labels_or_documents(spark, corpus):
    docs, labels, _ = corpus
    areas = spark.createDataFrame([("sea",)], "subject_code string")
    assert s.subjects(docs, labels.limit(0), areas).count() == 0
    assert s.subjects(docs.limit(0), labels, areas).count() == 0
    assert s.subjects(docs, labels, areas.limit(0)).count() == 0


def test_nul_bytes_and_long_words():
    texts = ["one two. three four.", "five\x00 six. seven \x00", "eight nine.", "x" * 9000 + " ten. " + "x" * 9000]
    c = s.cut(texts)
    assert c.document.tolist() == [0, 0, 1, 1, 2, 3, 3]
    assert len(c.hashes) == 11 and c.codes[-1] == c.codes[-3]
