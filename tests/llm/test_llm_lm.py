import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm_data import SF, frame, rows, sample
from vitrine.llm import ngram_lm as L


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w] + ["</s> "]


def discounts(values):
    n = [0, *(sum(v == k for v in values) for k in (1, 2, 3, 4))]
    if not n[1] or not n[2]:
        return [0, 0.5, 0.75, 0.75]
    y = n[1] / (n[1] + 2 * n[2])
    d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return [0, *(min(max(x, 0.1), k + 1) for k, x in enumerate(d))]


class Plain:
    """The model out of dictionaries: contexts are tuples of the words before."""

    def __init__(self, texts, order=2):
        self.order, self.words = order, Counter()
        counts = Counter()
        for text in texts:
            t = tokens(text)
            self.words.update(t)
            padded = ["<s> "] * (order - 1) + t
            counts.update(tuple(padded[i:i + order]) for i in range(len(t)))
        self.counts = {order: counts}
        for n in range(order - 1, 0, -1):      # how many distinct words precede
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d = {n: discounts(c.values()) for n, c in self.counts.items()}
        self.follow = {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for g, k in c.items():
                self.follow[n][g[:-1]].append(k)
        self.pairs = {g[-2:] for g in counts}
        self.shares = {n: {g: (sum(ks), sum(self.d[n][min(x, 3)] for x in ks) / sum(ks)) for g, ks in f.items()}
                       for n, f in self.follow.items()}

    def p(self, context, w):
        n = len(context) + 1
        lower = self.p(context[1:], w) if context else 1 / (len(self.words) + 1)
        if context not in self.shares[n]:
            return lower
        (total, gamma), c = self.shares[n][context], self.counts[n][(*context, w)]
        return max(c - self.d[n][min(c, 3)], 0) / total + gamma * lower

    def row(self, text):
        t = tokens(text)
        n, v = sum(self.words.values()), len(self.words)
        padded = ["<s> "] * (self.order - 1) + t
        return (len(t), sum(self.words[w] > 0 for w in t), n,
                sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in t),
                sum(math.log10(self.p(tuple(padded[i:i + self.order - 1]), w)) for i, w in enumerate(t)))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def compare(got, data, model):
    want = sorted(((d, held(d), *model.row(t)) for d, t in data), key=str)
    got = sorted((tuple(r)[:7] for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_documents_equal_brute_force(spark):
    data = [(d["doc_id"], d["text"]) for d in sample()]
    compare(L.query(spark, SF).collect(), data, Plain([t for i, t in data if not held(i)], L.ORDER))


@pytest.mark.parametrize("order, wide", [(2, False), (2, True), (3, False), (3, True), (4, False)])
def test_many_small_ranges_give_the_same(spark, monkeypatch, order, wide):
    data = [(d["doc_id"], d["text"]) for d in sample()[:60] if len(d["text"] or "") < 2000] + [(1000 + i, "the " * 500) for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(4)
    if wide:      # as with more n-grams than a 64-bit key can tell
        monkeypatch.setattr(L, "NARROW", 1)
    # "the the" alone fills ranges: its context is split
    model = L.train(docs, order, range_tokens=400, range_bytes=10_000)
    assert all(len(level.bounds) > 8 and level.wide == wide for level in model.levels.values()) and model.n_ranges > 2
    plain = Plain([t for _, t in data], order)
    assert model.words == len(plain.words) and model.types == len(plain.pairs)
    probes = [*data, (2000, None), (2001, "the unseen words the the of"), (2002, "the")]
    got = {r.doc_id: r.score for r in L.score(spark.createDataFrame(probes, "doc_id long, text string"), model).collect()}
    for i, text in probes:
        assert got[i] == pytest.approx(plain.row(text)[4], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_missing_or_cut_model_files_are_an_error(spark, order):
    """A worker that doesn't see a file of the model must not take it for an empty one."""
    import os
    from pyspark.errors import PythonException
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a b"), (3, "a b")], "doc_id long, text string")
    names = ["hash-0", "count-0", "before-0", f"key{order}-0", f"count{order}-0", f"context{order}-0", f"totals{order}-0"]
    names += ["key2-0", "before2-0"] if order == 3 else []
    model = L.train(docs, order)
    before = [r.score for r in L.score(docs, model).collect()]
    assert all(x > -12 for x in before)
    for name in names:
        path = f"{model.folder}/{name}"
        os.rename(f"{path}.npy", f"{path}.gone")
        with pytest.raises(PythonException, match="can't be read"):
            L.score(docs.coalesce(1), model).collect()
        os.rename(f"{path}.gone", f"{path}.npy")
    assert [r.score for r in L.score(docs, model).collect()] == before
    L.np.save(f"{model.folder}/{name}.npy", L.np.zeros(1, L.np.uint64))
    with pytest.raises(PythonException, match="instead of"):
        L.score(docs, model).collect()


def test_the_order_is_two_or_more(spark):
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a b"), (3, "a b")], "doc_id long, text string")
    for order in (2, 3):
        scorer = L.Scorer(L.train(docs, order))
        plain = Plain(["a b a c", "b a b", "a b"], order)
        for context in (("a",), ("b",), ("zzz",), ("a", "b"), ("<s> ", "a"), ("zzz", "a"))[:6 if order == 3 else 3]:
            assert sum(plain.p(context, w) for w in [*plain.words, "unknown"]) == pytest.approx(1)
        assert scorer.score([b"a b zzz a"])[0][3] == pytest.approx(plain.row("a b zzz a")[4])


def test_edges(spark):
    data = [r[:2] for r in rows()]
    model = L.train(frame(spark), 3)
    plain = Plain([t for _, t in data], 3)
    got = sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in L.score(frame(spark), model).collect()), key=str)
    assert got == sorted(((d, plain.row(t)[0], round(plain.row(t)[4], 6)) for d, t in data), key=str)
    assert L.score(frame(spark, []), model).count() == 0
    empty = L.train(frame(spark, []))
    assert {r.score for r in L.score(frame(spark), empty).collect()} == {0.0}
