"""Embedding whitening by spectrum slicing of the covariance.

Entries are held as integers, x = floor(64 c) + 1,000,000, so counts, sums and
the products of the covariance are exact whatever the order and the partitions.

1. The fit list (each distinct x vector once) is packed, made distinct in a
   shuffle and written.
2. n and the sums S come from one pass over it, the products of the entries from
   a second: entries are first centred at the integer nearest to S / n, and the
   remainder is taken out exactly, so V is correctly rounded.
3. The driver holds the d x d covariance alone. For a shift s, the signs of the
   pivots of L D L' = V - s I count the eigenvalues above s; bisection on these
   counts isolates each leading eigenvalue. Rayleigh quotient iteration then
   converges cubically, and two counts just beside the result certify that it is
   the k-th. Eigenvalues closer than rounding allows share an interval; their
   vectors are made orthogonal to those already found.
4. Rows are projected in one narrow pass; the whitened covariance of the fit list
   is measured, not derived.

Scale: only the distinct step shuffles vectors (copies are combined before it);
partial sums are d (d + 1) / 2 rows for each task and are added up in Spark.

Defined results: vectors that are null or hold null or non-finite entries, or
entries beyond the long range (2**55), are left out; so are vectors of another
length than most distinct vectors have (ties: the shorter length); without a
vector there is no row. Repeated rows repeat, null ids pass through, other
columns are not read. Components beyond the rank of V have ``explained`` 0 and a
null ``whitened``; if V is zero, ``explained`` is null. Signs make a
component's largest entry positive. ``deviation`` is null where it exceeds a
long; ``deviation_text`` then holds it.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import prepare, read
from vitrine.session import materialize

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000      # fixed values of the contract
_EXACT = 1 << 53                   # integers up to here are exact doubles
_MASK = (1 << 64) - 1
EPS = float(np.finfo(np.float64).eps)


# -- exact integers ---------------------------------------------------------------------------------

def fixed_point(vectors: pa.ListArray):
    """(row numbers, entries floor(64 c) as int64) of the usable vectors, a group for each length."""
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False),
                       vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)      # null entries: NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        c = flat[starts[rows, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(c * SCALE)
        good = (np.abs(x) < 1 << 61).all(axis=1)      # false for NaN and infinities
        if good.any():
            yield rows[good], x[good].astype(np.int64)


def _most(a: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _products(z: np.ndarray) -> np.ndarray:
    """z' z, exact, as Python integers."""
    most, total = _most(z), np.zeros((z.shape[1],) * 2, object)
    if most * most < _EXACT:      # sums of so many rows are exact in doubles
        step = max(1, _EXACT // max(most * most, 1) - 1)
        for at in range(0, len(z), step):
            part = z[at:at + step].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
        return total
    wide = z.astype(object)
    return wide.T @ wide


def _limbs(i, j, values) -> pa.RecordBatch:
    """Rows (i, j, hi, lo) of integers hi * 2**64 + lo of any size."""
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v >> 64) for v in values], kind),
         pa.array([Decimal(v & _MASK) for v in values], kind)], ["i", "j", "hi", "lo"])


LIMBS = "i int, j int, hi decimal(38,0), lo decimal(38,0)"


def _added(partials: DataFrame) -> dict[tuple[int, int], int]:
    rows = partials.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()      # by dimension
    return {(r.i, r.j): (int(r.hi) << 64) + int(r.lo) for r in rows}


def _packed(batches):
    """(d, body): entries in the smallest integer type that holds the whole vector, so equal vectors are equal bytes."""
    for batch in batches:
        for _, y in fixed_point(batch.column(0)):
            most = np.abs(y).max(axis=1)
            width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
            for w in np.unique(width).tolist():
                data = y[width == w].astype(f"<i{w}").tobytes()
                size = w * y.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(data) // size, y.shape[1], np.int32)),
                     pa.array([data[at:at + size] for at in range(0, len(data), size)], pa.binary())], ["d", "body"])


def _unpacked(batch: pa.RecordBatch, d: int):
    """The entries of packed vectors of one length, some MB at a time."""
    by_width: dict[int, list[bytes]] = {}
    for body in batch.column(0).to_pylist():
        by_width.setdefault(len(body) // d, []).append(body)
    for w, bodies in by_width.items():
        step = max(1, (1 << 20) // d)
        for at in range(0, len(bodies), step):
            yield np.frombuffer(b"".join(bodies[at:at + step]), f"<i{w}").reshape(-1, d).astype(np.int64)


def _sums(d: int):
    def run(batches):
        n, s = 0, np.zeros(d, object)
        for batch in batches:
            for y in _unpacked(batch, d):
                n += len(y)
                s = s + (y.sum(axis=0) if _most(y) < 1 << 40 else y.astype(object).sum(axis=0)).astype(object)
        if n:
            yield _limbs([-1, *range(d)], [0] * (d + 1), [n, *map(int, s)])
    return run


def _covariance(d: int, centre: np.ndarray):
    def run(batches):
        total, any_rows = np.zeros((d, d), object), False
        for batch in batches:
            for y in _unpacked(batch, d):
                total, any_rows = total + _products(y - centre), True
        if any_rows:
            i, j = np.triu_indices(d)
            yield _limbs(i.astype(np.int32), j.astype(np.int32), [int(v) for v in total[i, j]])
    return run


# -- spectrum slicing ---------------------------------------------------------------------------------

def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` exceed ``shift``: the positive pivots of
    L D L' = a - shift I, with 1x1 and 2x2 pivots chosen from the whole remainder (Sylvester's law)."""
    m, positive = a - shift * np.eye(len(a)), 0
    while len(m):
        size = np.abs(m)
        p = int(size.diagonal().argmax())
        top = float(size[p, p])
        r, c = divmod(int(size.argmax()), len(m))
        if top >= 0.64 * float(size[r, c]):
            if top == 0.0:
                return positive
            positive += m[p, p] > 0
            col = np.delete(m[p], p)
            rest = np.delete(np.delete(m, p, 0), p, 1)
            m = rest - np.outer(col, col / m[p, p])
        else:      # an indefinite 2x2 pivot: one eigenvalue on either side
            positive += 1
            two = [r, c]
            cols = np.delete(m[two], two, 1)
            rest = np.delete(np.delete(m, two, 0), two, 1)
            m = rest - cols.T @ np.linalg.solve(m[np.ix_(two, two)], cols)
            m = (m + m.T) / 2
    return int(positive)


def _solve(a: np.ndarray, shift: float, v: np.ndarray, least: float) -> np.ndarray:
    for move in (0.0, least, 3 * least, 9 * least):      # a shift that hits an eigenvalue exactly is moved a little
        try:
            z = np.linalg.solve(a - (shift + move) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(z).all() and z.any():
            return z / np.abs(z).max()
    return v


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric, positive semidefinite matrix,
    at most ``k`` and only those above rounding (``len(a) * eps`` of the largest)."""
    d = len(a)
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if not norm:
        return np.zeros(0), np.zeros((d, 0))
    close = 4 * d * EPS * norm
    counts = {-close: d, norm + close: 0}      # shift: eigenvalues above it

    def bracket(j: int, accept) -> tuple[float, float]:
        """Shifts (low, high) with the j-th eigenvalue between them, halved until accepted."""
        low = max(s for s, n in counts.items() if n >= j)
        high = min(s for s, n in counts.items() if n < j and s > low)
        while not accept(low, high) and high - low > close:
            mid = (low + high) / 2
            counts[mid] = count_above(a, mid)
            low, high = (mid, high) if counts[mid] >= j else (low, mid)
        return low, high

    values, vectors = [], np.zeros((d, 0))
    for j in range(1, min(k, d) + 1):
        rounds = 0
        while True:
            width = norm / 4 ** rounds
            low, high = bracket(j, lambda lo, hi: counts[lo] - counts[hi] == 1 and hi - lo <= width)
            v, value = np.random.default_rng(j).standard_normal(d), (low + high) / 2
            for step in range(12):
                v = _solve(a, value, v, close / 64)
                v = v - vectors @ (vectors.T @ v)
                v = v - vectors @ (vectors.T @ v)
                v /= np.linalg.norm(v)
                off = float(np.linalg.norm(a @ v - value * v))
                if step:      # the first steps keep the interval's middle
                    value = float(v @ (a @ v))
                    off = float(np.linalg.norm(a @ v - value * v))
                    if off <= close / 16:
                        break
            inside = low - close <= value <= high + close
            if inside and off <= close and count_above(a, value - close) >= j > count_above(a, value + close):
                break
            if high - low <= close:
                raise ArithmeticError("Rayleigh quotient iteration doesn't converge")
            rounds += 1
        values.append(value)
        vectors = np.column_stack([vectors, v])
    kept = [j for j, v in enumerate(values) if v > d * EPS * values[0]]
    vectors = vectors[:, kept]
    largest = np.abs(vectors).argmax(axis=0)
    return np.array(values)[kept], vectors * np.where(vectors[largest, np.arange(len(kept))] < 0, -1.0, 1.0)


# -- the operator ---------------------------------------------------------------------------------------

@dataclass
class Whitening:
    """All that a row needs; its size is that of k vectors."""
    d: int
    n: int
    centre: np.ndarray       # integers nearest to S / n, less the offset
    rest: list[int]          # S - n * centre, exact
    axes: np.ndarray         # d x rank, divided by the root of the eigenvalue
    explained: list[float | None]
    identity_error: float | None = None

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 if it fits, else Python integers."""
        z = y - self.centre
        if self.n * _most(z) + max(map(abs, self.rest)) < 1 << 62:
            return z * np.int64(self.n) - np.array(self.rest, np.int64)
        return z.astype(object) * self.n - np.array(self.rest, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        if deviations.dtype == object:
            return np.array([[v / self.n for v in row] for row in deviations], np.float64) @ self.axes
        return (deviations / self.n) @ self.axes


def _identity(model: Whitening):
    """Partial sums of the whitened fit list: (i, j, v); j = -1: the sum itself."""
    def run(batches):
        r = model.axes.shape[1]
        first, second = np.zeros(r), np.zeros((r, r))
        for batch in batches:
            for y in _unpacked(batch, model.d):
                w = model.whitened(model.deviations(y))      # centred already
                first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = (x.ravel() for x in np.indices((r, r)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(r), i).astype(np.int32)), pa.array(np.append(np.full(r, -1), j).astype(np.int32)),
             pa.array(np.append(first, second.ravel()))], ["i", "j", "v"])
    return run


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of a table; None if it has no usable vector."""
    spark = vectors.sparkSession
    prepare(spark)
    column = F.col(vec_col).cast("array<double>").alias("v")
    distinct = materialize(vectors.select(column).mapInArrow(_packed, "d int, body binary").distinct(), "whitening-fit")
    most = distinct.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return None
    d = most.d
    bodies = distinct.filter(F.col("d") == d).select("body")
    sums = _added(bodies.mapInArrow(_sums(d), LIMBS))
    n, s = sums[-1, 0], [sums[i, 0] for i in range(d)]
    centre = [(2 * x + n) // (2 * n) for x in s]
    rest = [x - n * c for x, c in zip(s, centre)]
    raw = _added(bodies.mapInArrow(_covariance(d, np.array(centre, np.int64)), LIMBS))
    v = np.zeros((d, d))
    for (i, j), g in raw.items():
        v[i, j] = v[j, i] = (n * g - rest[i] * rest[j]) / (n * n)      # of integers: correctly rounded
    values, axes = leading_eigenpairs(v, components)
    trace = float(np.trace(v))
    k = min(components, d)
    explained = [None] * k if not trace else [*(values / trace).tolist(), *[0.0] * (k - len(values))]
    model = Whitening(d, n, np.array(centre, np.int64), rest, axes / np.sqrt(values), explained)
    if len(values):
        found = {(r.i, r.j): r.v for r in bodies.mapInArrow(_identity(model), "i int, j int, v double")
                 .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}      # by components
        of = range(len(values))
        model.identity_error = max(abs(found[i, j] / n - found[i, -1] / n * (found[j, -1] / n) - (i == j)) for i in of for j in of)
    return model


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
                  ("deviation_text", pa.string())])
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double, deviation_text string")


def _project(model: Whitening):
    k, rank = len(model.explained), model.axes.shape[1]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(
                batch.column(0).to_pylist(), object)
            for rows, y in fixed_point(batch.column(1)):
                if y.shape[1] != model.d:
                    continue
                off = model.deviations(y)
                if off.dtype != object and model.d * _most(off) ** 2 < 1 << 63:
                    squares, texts = (off * off).sum(axis=1).tolist(), [None] * len(off)
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in off]
                    squares = [x if x < 1 << 63 else None for x in exact]
                    texts = [None if x < 1 << 63 else str(x) for x in exact]
                w = np.full((len(y), k), np.nan)
                w[:, :rank] = model.whitened(off)
                repeat = lambda values: [v for v in values for _ in range(k)]      # noqa: E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[rows], k), pa.int64()), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()),
                     pa.array(np.full(len(y) * k, model.n)), pa.array(repeat(squares), pa.int64()),
                     pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(model.explained * len(y), pa.float64()),
                     pa.array([model.identity_error] * (len(y) * k), pa.float64()), pa.array(repeat(texts), pa.string())],
                    schema=_OUT)
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and leading component: vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_text."""
    model = fit(vectors, vec_col, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .mapInArrow(_project(model), OUT))


def query(spark, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of all embeddings."""
    return whiten(read(spark, sf_dir, "embeddings"))
