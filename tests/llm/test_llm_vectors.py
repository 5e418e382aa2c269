import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import SF, sample
from vitrine.llm import vector_dedup as V
from vitrine.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def table(spark, data):
    """Vectors with columns named like those that the operators use inside."""
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("extra") for c in ("v", "d", "node", "body", "component", "copies", "n", "root", "block")})


def odd(d=4):
    """Unusable vectors, repeated rows, null and repeated ids, another length."""
    return [(900, None, 1), (901, [1.0] * (d - 1) + [None], 1), (902, [NAN] * d, None), (903, [INF] + [0.0] * (d - 1), 1),
            (904, [0.0] * d, 1), (905, [], 1), (906, [1.0] * (d + 1), 1), (None, None, None)]


# -- whitening --------------------------------------------------------------------------------------

def plain_whitening(vectors, k=16):
    """n, deviations, projections, shares of all usable vectors by numpy's own eigensolver."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviations, (x - s / n) @ axes / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(v), values


def check(got, data, k):
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) against numpy, up to signs."""
    n, deviations, w, shares, values = plain_whitening([v for _, v in data], k)
    assert len(got) == len(data) * len(shares)
    seen = {}
    for r in got:      # equal rows stand one after another
        seen.setdefault((str(r.vec_id), r.deviation, r.component), []).append(r)
    by = [r for _, _, _, r in sorted((*k[:2], (i, k[2]), r) for k, rs in seen.items() for i, r in enumerate(rs))]
    order = sorted(range(len(data)), key=lambda i: (str(data[i][0]), deviations[i]))
    mine = np.array([r.whitened for r in by], float).reshape(len(data), -1)
    want = w[order]
    signs = np.sign((mine * want).sum(axis=0))
    assert mine == pytest.approx(want * signs, abs=1e-7)
    assert [r.deviation for r in by][::len(shares)] == [deviations[i] for i in order]
    assert {r.n for r in by} == {n}
    assert [r.explained for r in by][:len(shares)] == pytest.approx(list(shares), rel=1e-9)
    assert max(r.identity_error for r in by) < 1e-9


def test_whitening_equals_numpy(spark):
    data = [(e["vec_id"], e["embedding"]) for e in sample("embeddings")]
    check(W.query(spark, SF).collect(), data, 16)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1 + j) for j in range(4)], 0) for i in range(60)]
    good += [(3, good[3][1], 0), (None, good[4][1], 0), (77, good[5][1], 0)]
    got = W.whiten(table(spark, good + odd())).collect()
    zero = [(904, [0.0] * 4, 1)]      # usable here
    check(got, [(i, [np.float32(c).item() for c in v]) for i, v, _ in good + zero], 4)


def test_whitening_without_a_vector_and_without_variance(spark):
    assert W.whiten(table(spark, [])).collect() == [] and W.whiten(table(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    one = W.whiten(table(spark, [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (c, 1, 0, None, None, None) for c in (1, 2)] * 2
    two = W.whiten(table(spark, [(1, [0.0, 1.0, 5.0], 1), (2, [0.0, 3.0, 5.0], 1)])).collect()      # rank 1
    assert [(r.vec_id, r.whitened, r.explained) for r in two if r.component == 1] == [(1, -1.0, 1.0), (2, 1.0, 1.0)]
    assert {(r.whitened, r.explained) for r in two if r.component > 1} == {(None, 0.0)} and two[0].identity_error < 1e-12


def test_entries_of_any_size_stay_exact(spark):
    df = spark.createDataFrame([(1, [2.0 ** 50, 0.1]), (2, [-2.0 ** 50, 0.2]), (3, [1e300, 0.0]), (4, [1.0, 2.0])],
                               "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in W.whiten(df).collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in ((1, [2.0 ** 50, 0.1]), (2, [-2.0 ** 50, 0.2]), (4, [1.0, 2.0]))}
    s = [sum(v[j] for v in x.values()) for j in (0, 1)]
    exact = {i: sum((3 * v[j] - s[j]) ** 2 for j in (0, 1)) for i, v in x.items()}
    assert {i for i, _ in got} == {1, 2, 4}      # 1e300 is beyond the long range
    for i, want in exact.items():
        r = got[i, 1]
        assert (r.deviation, r.deviation_text) == ((want, None) if want < 1 << 63 else (None, str(want)))


@pytest.mark.parametrize("d", [1, 2, 3, 8, 16, 64])
@pytest.mark.parametrize("kind", ["random", "pairs", "equal", "rank two"])
def test_eigenpairs_and_counts(d, kind):
    rng = np.random.default_rng(d)
    if kind == "random":
        x = rng.standard_normal((3 * d, d))
        a = x.T @ x / len(x)
    elif kind == "pairs":      # every eigenvalue twice
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = q * np.repeat(rng.random(-(-d // 2)) * 5 + 1, 2)[:d] @ q.T
    elif kind == "equal":
        a = np.eye(d) * 3.0
    else:
        x = rng.standard_normal((2, d))
        a = x.T @ x
    a = (a + a.T) / 2
    every = np.sort(np.linalg.eigvalsh(a))[::-1]
    values, vectors = W.leading_eigenpairs(a, 16)
    assert len(values) == min(d, 2 if kind == "rank two" else 16)
    assert values == pytest.approx(every[:len(values)], rel=1e-11)
    assert vectors.T @ vectors == pytest.approx(np.eye(len(values)), abs=1e-9)
    assert a @ vectors == pytest.approx(vectors * values, abs=1e-10 * every[0])
    for shift in (every[0] / 2, every[0] * 1.1, values[-1] * 0.99, 0.17 * every[0]):
        assert W.count_above(a, shift) == (every > shift).sum()


# -- near duplicates ----------------------------------------------------------------------------------

def plain_links(data, threshold=0.95):
    """Per row (vec_id, n_links, component_id) from all pairs."""
    def usable(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(v) if usable(v) else None for _, v in data]
    n, links, root = len(data), [0] * len(data), list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(n), 2):
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (vec_id, _) in enumerate(data):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return sorted(((data[i][0], links[i], least.get(find(i))) for i in range(n)), key=str)


def near(rng, v, by):
    return [np.float32(c + rng.gauss(0, by)).item() for c in v]


def test_embeddings_equal_all_pairs(spark):
    data = [(e["vec_id"], e["embedding"]) for e in sample("embeddings")]
    rng = random.Random(1)
    data += [(10_000 + i, near(rng, data[i % 5][1], 0.03)) for i in range(120)] + [(20_000 + i, data[7][1]) for i in range(30)]
    got = V.near_duplicates(table(spark, [(i, v, 1) for i, v in data])).collect()
    want = plain_links(data)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert sum(n > 0 for _, n, _ in want) > 100 and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors_link_with_nothing(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    data = [(i, near(rng, base[i % 6], 0.1)) for i in range(40)] + [(i, v) for i, v, _ in odd()]
    data += [(1, data[1][1]), (None, data[2][1]), (None, near(rng, [9.0, -9.0, 0.0, 0.0], 0.1)), (950, [1e-20, 1e-20, 0.0, 0.0]),
             (951, [1e18, 1e18, 0.0, 0.0]), (952, [-1.0] * 5), (953, [2.0] * 5)]
    got = V.near_duplicates(table(spark, [(i, v, None) for i, v in data])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain_links(data)
    assert V.near_duplicates(table(spark, [])).count() == 0
    assert {r.kept for r in got if r.vec_id in (900, 904, 905)} == {True}


def test_a_link_through_a_vector_without_id(spark):
    angle = [(5, 0.0), (None, 0.3), (9, 0.6)]      # 0.3 apart: cosine 0.955; 0.6: 0.825
    got = V.near_duplicates(table(spark, [(i, [math.cos(a), math.sin(a)], 1) for i, a in angle])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == [(5, 1, 5), (9, 1, 5), (None, 2, 5)]


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("d", [1, 3, 64, 1100])
def test_tile_links_are_those_of_full_precision(same, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((150, d)) * rng.random((150, 1)) * 100
    x[75:] = x[:75] + rng.standard_normal((75, d)) * np.abs(x[:75]).mean(axis=1, keepdims=True) * rng.random((75, 1)) * 0.8
    y = x if same else np.concatenate([x[20:60] * 3, rng.standard_normal((40, d))])
    bits = V._bits(V.tile_links(x, y, 0.95, same), len(y))
    cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    want = cos >= 0.95
    sure = np.abs(cos - 0.95) > 1e-12
    if same:
        want &= np.triu(np.ones(want.shape, bool), 1)
    assert (bits == want)[sure].all() and want.any()


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)) ** 3
    q, s, size, lost = V.quantised(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(q).max() == 127 and (q == np.rint(q)).all()
    bound = (q @ q.T) * s[:, None] * s + size[:, None] * lost + lost[:, None] * size + lost[:, None] * lost
    assert (u @ u.T <= bound + 1e-12).all()
