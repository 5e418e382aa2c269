"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

Counting runs in Spark over all training documents, in one pass for each order.

1. Words. Tasks count 64-bit word hashes and hand on one sorted block per hash
   range; each range is merged and stored as a sorted hash array with its
   counts. A word's id is its rank over all ranges, so ids follow the hashes.
2. n-grams of order 2, 3, ... The key of an n-gram is (rank of its first n - 1
   words among all (n-1)-grams, id of its last word): one 64-bit number as long
   as their product fits, else a pair of doubles, which hold ranks up to 2**53
   and sort alike. Tasks hand on sorted counts cut at boundaries of equal mass,
   which come from the counts of the order below: a frequent context's n-grams
   are spread over several ranges, so no key is hot. Each range is stored as a
   sorted key array with counts. How many distinct words precede an n-gram (its
   continuation count) is summed per range and merged in a second shuffle.

Ranges are as many as the data asks for (by bytes of text and by tokens).
Workers map the arrays into memory from the shared folder, sort the keys of a
chunk of text and look them up range by range.

Model: with c the counts of the highest order, continuation counts below it, n
types, D1, D2, D3+ from the counts of counts of each order,
  p(w|uv) = (c(uvw) - D(c(uvw))) / c(uv) + gamma(uv) p(w|v), and so on down to
  p(w)    = (n(.w) - D(n(.w))) / n(..) + gamma / (V + 1)
for a vocabulary of V training words and one unknown word. Texts have begin
contexts of the whole order and an end token. Orders from 2 up are possible; the
registered query takes ``ORDER`` (the README has the figures of both 2 and 3).

Recovery: array files get their final name by a rename after they are whole,
and a repeated task writes the same bytes. Only per-range totals reach the
driver; they tell the length of every file, and a file that a worker can't see
or that has another length is an error. The arrays are plain files, so the
shared folder has to be a mounted file system (``common.model_folder`` refuses
others).

Defined results: null and empty text: the end token alone; unknown words get
the uniform share; without any training token every probability is 1/(V+1) = 1;
repeated rows repeat (and count as often in training).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import (WordHashes, bounded_chunks, id_and_bytes, map_array, model_folder, prepare, read,
                                save_array)

ORDER = 2
END = b" end"           # no word holds a space
CACHE_BYTES = 128 << 20          # of the words whose ids a worker keeps
HASH_BYTES = 96 << 20            # of the words whose hashes it keeps while counting
FLUSH_TOKENS = 4 << 20
RANGE_TOKENS = 4 << 20           # of text for each range of n-grams
RANGE_BYTES = 24 << 20           # of text for each range of words
LEAST_DISCOUNT = 0.1
NARROW = 1 << 64                 # keys up to here are single numbers
_U32 = np.uint64(32)


# -- arrays ---------------------------------------------------------------------------------------

def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; integers take their smallest type."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        kind = a.dtype.str.encode()
        parts += [struct.pack("<B", len(kind)), kind, struct.pack("<Q", len(a)), a.tobytes()]
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = data[0], 1, []
    for _ in range(n):
        k = data[at]
        kind = np.dtype(data[at + 1:at + 1 + k].decode())
        (size,) = struct.unpack_from("<Q", data, at + 1 + k)
        at += 9 + k
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate([c.astype(np.int64) for c in counts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[heads], np.add.reduceat(n, heads)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


PART = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("body", pa.binary())])
PART_SQL = "kind string, part long, body binary"


# -- the model's description, small enough for a closure --------------------------------------------

def _no_rows(kind=np.int64, columns: int | None = None):
    return field(default_factory=lambda: np.zeros(0 if columns is None else (0, columns), kind))


@dataclass
class Level:
    """The n-grams of one order above 1; a few numbers for each range."""
    order: int
    firsts: int                                      # how many first parts there are, begin and unknown included
    radix: int                                       # how many last words, likewise
    wide: bool                                       # whether keys are pairs of doubles
    bounds: np.ndarray                               # first key of ranges 1..
    sizes: np.ndarray = _no_rows()                   # n-grams of each range
    contexts: np.ndarray = _no_rows()                # contexts of each range
    discounts: tuple = (0.0, 0.0, 0.0)
    split: np.ndarray = _no_rows(columns=5)          # contexts at borders: number, totals

    @property
    def types(self) -> int:
        return int(self.sizes.sum())

    def key(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if self.wide:
            return first.astype(np.float64) + 1j * last.astype(np.float64)
        return first.astype(np.uint64) * np.uint64(self.radix) + last.astype(np.uint64)

    def parts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first part, last word) of keys."""
        if self.wide:
            return key.real.astype(np.int64), key.imag.astype(np.int64)
        first = key // np.uint64(self.radix)
        return first.astype(np.int64), (key - first * np.uint64(self.radix)).astype(np.int64)

    def pack(self, keys: np.ndarray, counts: np.ndarray) -> bytes:
        first, last = self.parts(keys)
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        return _pack(_small(first[heads]), _small(np.diff(np.append(heads, len(keys)))), _small(last), _small(counts))

    def unpack(self, block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first, sizes, last, counts = block
        return self.key(np.repeat(first.astype(np.int64), sizes), last), counts

    def ranks(self) -> np.ndarray:
        """The rank of each range's first n-gram, and the number of n-grams."""
        return np.concatenate([[0], np.cumsum(self.sizes)])


@dataclass
class Model:
    folder: str
    n_ranges: int                                    # of words
    offsets: np.ndarray                              # first id of each word range, and V
    tokens: int                                      # N
    order: int = 2
    levels: dict[int, Level] = field(default_factory=dict)      # by order, from 2
    discounts: tuple = (0.0, 0.0, 0.0)               # of the words' continuation counts
    gamma: float = 1.0                               # what the uniform share gets

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    @property
    def types(self) -> int:
        """Distinct pairs."""
        return self.levels[2].types if 2 in self.levels else 0

    def begin(self, order: int) -> int:
        """The number of the begin context of ``order`` words; the next number is an unknown one."""
        return self.words if order == 1 else self.levels[order].types

    def length(self, name: str, part: int) -> int:
        """How many entries an array file has: ``hash``, ``count``, ``before`` of words; ``key2``, ``count2``, ... of pairs."""
        if name in ("hash", "count", "before"):
            return int(self.offsets[part + 1] - self.offsets[part])
        level = self.levels[int(name[-1])]
        return int((level.contexts if name[:-1] in ("context", "totals") else level.sizes)[part])


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many items have count 1, 2, 3, 4; never nothing, so that unseen words keep a share."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, LEAST_DISCOUNT), k + 1.0) for k, x in enumerate(d))


def _discounted(c: np.ndarray, d: tuple) -> np.ndarray:
    table = np.array([0.0, *d])
    return np.maximum(c - table[np.minimum(c, 3).astype(np.int64)], 0.0)


# -- words ------------------------------------------------------------------------------------------

def _tokens(bodies: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts, and where each text begins."""
    flat, starts = [], []
    for body in bodies:
        starts.append(len(flat))
        flat += body.lower().split()      # of bytes: A-Z, and ASCII white space, alone
        flat.append(END)
    return flat, np.array(starts)


def _range_of(hashes: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((hashes >> _U32) * np.uint64(n_ranges) >> _U32).astype(np.int64)


def _cut(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, kind: str, pack) -> list[tuple]:
    out, edges = [], [0, *cuts.tolist(), len(keys)]
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            out.append((kind, part, pack(keys[a:b], counts[a:b])))
    return out


def _count_words(n_ranges: int):
    def run(batches):
        hashes, held, size = WordHashes(HASH_BYTES), [], 0
        # First hash of ranges 1, 2, ...: the least h with (h >> 32) * n >> 32 >= r.
        firsts = np.array([-(-(r << 32) // n_ranges) << 32 for r in range(1, n_ranges)], np.uint64)

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _rows(PART, _cut(keys, counts, np.searchsorted(keys, firsts), "words",
                                    lambda k, c: _pack(k, _small(c))))

        for _, bodies in bounded_chunks(batches):
            flat, _ = _tokens(bodies)
            held.append(hashes.of(flat))
            size += len(flat)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return run


def _gather(batches) -> dict[tuple[str, int], list]:
    """The unpacked blocks of a partition by (kind, range)."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for kind, part, body in zip(*(batch.column(i) for i in range(3))):
            found.setdefault((kind.as_py(), part.as_py()), []).append(_unpack(body.as_py()))
    return found


def _store_words(folder: str):
    def run(batches):
        for (_, part), blocks in _gather(batches).items():
            keys, counts = _merge([b[0] for b in blocks], [b[1] for b in blocks])
            save_array(folder, f"hash-{part}", keys)
            save_array(folder, f"count-{part}", _small(counts))
            yield _rows(PART, [("words", part, _pack(np.array([len(keys), counts.sum()])))])
    return run


class _Arrays:
    """The model's arrays, mapped into memory when first used."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def __call__(self, name: str, part: int) -> np.ndarray:
        key = (name, part)
        if key not in self.open:
            self.open[key] = map_array(self.model.folder, f"{name}-{part}", self.model.length(name, part))
        return self.open[key]


class Vocabulary:
    """Words to ids: V is the begin context, V + 1 an unknown word."""

    def __init__(self, model: Model):
        self.model, self.arrays, self.known, self.held = model, _Arrays(model), {}, 0

    def ids(self, flat: list[bytes]) -> np.ndarray:
        fresh = list(set(flat).difference(self.known))
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held, fresh = 0, list(set(flat))
        if fresh:
            self.held += sum(map(len, fresh)) + WordHashes.ENTRY * len(fresh)
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in fresh], np.uint64)
            order = np.argsort(hashes)
            hashes = hashes[order]
            found = np.full(len(fresh), self.model.words + 1, np.int64)
            parts = _range_of(hashes, self.model.n_ranges)
            for part in np.unique(parts).tolist():
                mine = np.flatnonzero(parts == part)
                table = self.arrays("hash", part)
                if len(table):
                    at = np.minimum(np.searchsorted(table, hashes[mine]), len(table) - 1)
                    good = table[at] == hashes[mine]
                    found[mine[good]] = at[good] + self.model.offsets[part]
            self.known.update(zip([fresh[i] for i in order.tolist()], found.tolist()))
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def at(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A value of every id from the arrays by word range; 0 for the unknown word. ``ids`` are sorted."""
        out = np.zeros(len(ids), np.int64)
        edges = np.searchsorted(ids, self.model.offsets)
        for part in range(self.model.n_ranges):
            a, b = int(edges[part]), int(edges[part + 1])
            if b > a:
                out[a:b] = self.arrays(name, part)[ids[a:b] - self.model.offsets[part]]
        return out


# -- n-grams ------------------------------------------------------------------------------------------

class Lookup:
    """The n-grams of texts, by order."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model)
        self.arrays = self.vocabulary.arrays

    def places(self, level: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(place in its range, whether it is there) of sorted keys, and (range, from, to) of the ranges they fall into."""
        at, found, ranges = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), []
        edges = [0, *np.searchsorted(keys, level.bounds).tolist(), len(keys)]
        for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            table = self.arrays(f"key{level.order}", part) if b > a else ()
            if len(table):
                at[a:b] = np.minimum(np.searchsorted(table, keys[a:b]), len(table) - 1)
                found[a:b] = table[at[a:b]] == keys[a:b]
                ranges.append((part, a, b))
        return at, found, ranges

    def firsts(self, order: int, ids: np.ndarray, starts: np.ndarray, known: dict | None = None) -> np.ndarray:
        """For each token the number of the ``order - 1`` words before it."""
        first = np.empty_like(ids)
        first[1:] = ids[:-1]
        first[starts] = self.model.begin(1)
        for n in range(2, order):
            level = self.model.levels[n]
            if known and n in known:
                rank = known[n]
            else:
                keys, back = np.unique(level.key(first, ids), return_inverse=True)
                rank = self.ranks(level, *self.places(level, keys))[back]
            first = np.empty_like(ids)
            first[1:] = rank[:-1]
            first[starts] = self.model.begin(n)
        return first

    def ranks(self, level: Level, at, found, ranges) -> np.ndarray:
        out, ranks = np.full(len(at), level.types + 1, np.int64), level.ranks()      # unknown ones have none
        for part, a, b in ranges:
            out[a:b] = np.where(found[a:b], at[a:b] + ranks[part], level.types + 1)
        return out


def _boundaries(model: Model, level: Level, prefix: np.ndarray, ranks: np.ndarray, step: float, n_ranges: int):
    """Keys that cut the mass of n-grams evenly; a share within a context's n-grams becomes a share of the last words."""
    name = "count" if level.order == 2 else f"count{level.order - 1}"

    def run(batches):
        arrays = _Arrays(model)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                counts = np.cumsum(np.asarray(arrays(name, part)).astype(np.float64))
                lows = np.arange(1, n_ranges) * step - prefix[part]
                lows = lows[(lows >= 0) & (lows < (counts[-1] if len(counts) else 0))]
                if len(lows):
                    at = np.searchsorted(counts, lows, "right")
                    before = np.where(at > 0, counts[at - 1], 0.0)
                    share = (lows - before) / (counts[at] - before)
                    keys = level.key(at + ranks[part], (share * model.words).astype(np.int64))
                    yield _rows(PART, [("bounds", part, _pack(keys))])
    return run


def _count_grams(model: Model, level: Level):
    kind = f"gram{level.order}"

    def run(batches):
        lookup, held, size = Lookup(model), [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _rows(PART, _cut(keys, counts, np.searchsorted(keys, level.bounds), kind, level.pack))

        for _, bodies in bounded_chunks(batches):
            flat, starts = _tokens(bodies)
            ids = lookup.vocabulary.ids(flat)
            held.append(level.key(lookup.firsts(level.order, ids, starts), ids))
            size += len(flat)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return run


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)])


def _store_contexts(folder: str, level: Level, part: int, keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Stores the totals by context of a range; [contexts, counts of counts, totals of the contexts at its borders]."""
    first, _ = level.parts(keys)
    heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    totals = np.stack([np.add.reduceat(x.astype(np.int64), heads)
                       for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
    save_array(folder, f"context{level.order}-{part}", first[heads])
    save_array(folder, f"totals{level.order}-{part}", _small(totals))
    ends = np.unique([0, len(heads) - 1])
    border = np.concatenate([first[heads][ends, None], totals[ends]], axis=1)
    return [np.array([len(heads)]), _counts_of_counts(counts), border.ravel()]


def _store_grams(model: Model, level: Level, last: bool):
    """Stores a range's n-grams and counts, for the highest order also its contexts; hands on how many distinct words
    precede each of the n-grams one word shorter (at their end)."""
    n = level.order

    def run(batches):
        arrays, lookup = _Arrays(model), Lookup(model)
        for (_, part), blocks in _gather(batches).items():
            keys, counts = _merge(*zip(*map(level.unpack, blocks)))
            save_array(model.folder, f"key{n}-{part}", keys)
            save_array(model.folder, f"count{n}-{part}", _small(counts))
            more = _store_contexts(model.folder, level, part, keys, counts) if last else []
            rows = [("stored", part, _pack(np.array([len(keys)]), np.array([counts.sum()]), *more))]
            first, word = level.parts(keys)
            if n == 2:
                ends, how_many = np.unique(word, return_counts=True)
                if not last:
                    save_array(model.folder, f"link{n}-{part}", _small(word))
                rows += _cut(ends.astype(np.uint64), how_many, np.searchsorted(ends, model.offsets[1:-1]), "before",
                             lambda k, c: _pack(_small(k), _small(c)))
            else:      # the first part's own end, then the last word
                below = model.levels[n - 1]
                ranks, begin = below.ranks(), first == model.begin(n - 1)
                shorter = np.full(len(first), model.begin(n - 2), np.int64)
                edges = np.searchsorted(first, ranks)
                for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    if b > a:
                        shorter[a:b] = arrays(f"link{n - 1}", p)[first[a:b] - ranks[p]]
                assert not (first > model.begin(n - 1)).any() and begin.sum() == len(first) - edges[-1]
                ends, back, how_many = np.unique(below.key(shorter, word), return_inverse=True, return_counts=True)
                if not last:
                    save_array(model.folder, f"link{n}-{part}", lookup.ranks(below, *lookup.places(below, ends))[back])
                rows += _cut(ends, how_many, np.searchsorted(ends, below.bounds), "before", below.pack)
            yield _rows(PART, rows)
    return run


def _store_continuations(model: Model, order: int):
    """Stores the continuation counts of a range of words (1) or n-grams (their order)."""
    def run(batches):
        arrays = _Arrays(model)
        for (kind, part), blocks in _gather(batches).items():
            if kind == "stored":      # passes through to the driver
                yield _rows(PART, [(kind, part, _pack(*blocks[0]))])
                continue
            if order == 1:
                n, more = np.zeros(int(model.offsets[part + 1] - model.offsets[part]), np.int64), []
                for ids, counts in blocks:      # ids of one block are distinct
                    n[ids.astype(np.int64) - model.offsets[part]] += counts
                more = [_counts_of_counts(n), np.array([(n >= 3).sum()])]
                save_array(model.folder, f"before-{part}", _small(n))
            else:
                level = model.levels[order]
                keys, n = _merge(*zip(*map(level.unpack, blocks)))
                assert len(keys) == level.sizes[part] and (keys == arrays(f"key{order}", part)).all()
                save_array(model.folder, f"before{order}-{part}", _small(n))
                more = _store_contexts(model.folder, level, part, keys, n)
            yield _rows(PART, [(kind, part, _pack(*more))])
    return run


def _collect(df: DataFrame) -> list[tuple[str, int, list]]:
    return [(r.kind, r.part, _unpack(bytes(r.body))) for r in df.collect()]      # totals by range


def _totals(level: Level, found: list[tuple[int, list]]) -> None:
    """Sets a level's contexts, discounts and border contexts from what its ranges tell."""
    n, border = np.zeros(4, np.int64), {}
    level.contexts = np.zeros(len(level.bounds) + 1, np.int64)
    for part, (contexts, counts, rows) in found:
        level.contexts[part] = contexts[0]
        n = n + counts
        for row in rows.reshape(-1, 5).astype(np.int64):
            border[int(row[0])] = border.get(int(row[0]), 0) + row[1:]
    level.discounts = _discounts(n)
    level.split = np.array([[i, *border[i]] for i in sorted(border)], np.int64)


def train(docs: DataFrame, order: int = ORDER, range_tokens: int = RANGE_TOKENS, range_bytes: int = RANGE_BYTES) -> Model:
    """Count all rows of ``docs`` (doc_id, text) and store the model in the shared folder."""
    if not 2 <= order <= 9:
        raise ValueError("the order is 2 or more (9 at most)")
    spark = docs.sparkSession
    prepare(spark)
    folder = model_folder(spark, "ngram-model")
    bodies = id_and_bytes(docs)
    size = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_ranges = max(1, -(-size // range_bytes))
    words = _collect(bodies.mapInArrow(_count_words(n_ranges), PART_SQL).repartition(n_ranges, "part")
                     .mapInArrow(_store_words(folder), PART_SQL))
    sizes, mass = np.zeros(n_ranges, np.int64), np.zeros(n_ranges, np.int64)
    for _, part, (total,) in words:
        sizes[part], mass[part] = total
    model = Model(folder, n_ranges, np.concatenate([[0], np.cumsum(sizes)]), int(mass.sum()), order)
    if not model.tokens:
        return model
    n_grams = max(1, -(-model.tokens // range_tokens))
    ranks, firsts = model.offsets, model.words + 2
    for n in range(2, order + 1):
        level = Level(n, firsts, model.words + 2, firsts * (model.words + 2) > NARROW, np.zeros(0))
        level.bounds = level.key(*np.zeros((2, 0), np.int64))
        if n_grams > 1:
            prefix, parts = np.concatenate([[0], np.cumsum(mass)]), spark.range(len(mass)).repartition(min(len(mass), n_grams), "id")
            cuts = _collect(parts.mapInArrow(_boundaries(model, level, prefix, ranks, int(mass.sum()) / n_grams, n_grams), PART_SQL))
            if cuts:
                level.bounds = np.unique(np.concatenate([b for _, _, (b,) in cuts]))
        below = n_ranges if n == 2 else len(model.levels[n - 1].sizes)
        rows = _collect(bodies.mapInArrow(_count_grams(model, level), PART_SQL).repartition(n_grams, "part")
                        .mapInArrow(_store_grams(model, level, n == order), PART_SQL).repartition(below, "part")
                        .mapInArrow(_store_continuations(model, n - 1), PART_SQL))
        stored = {part: found for kind, part, found in rows if kind == "stored"}
        before = [(part, found) for kind, part, found in rows if kind == "before"]
        level.sizes, mass = np.zeros((2, len(level.bounds) + 1), np.int64)
        for part, found in stored.items():
            level.sizes[part], mass[part] = found[0][0], found[1][0]
        model.levels[n] = level
        ranks, firsts = level.ranks(), level.types + 2
        if n == order:
            _totals(level, [(part, found[2:]) for part, found in stored.items()])
        if n > 2:
            _totals(model.levels[n - 1], before)
        else:
            counts, more = sum(found[0] for _, found in before), sum(int(found[1][0]) for _, found in before)
            model.discounts = _discounts(counts)
            model.gamma = float(np.dot(model.discounts, [counts[0], counts[1], more]) / level.types)
    return model


# -- scoring ------------------------------------------------------------------------------------------

class Scorer:
    def __init__(self, model: Model):
        self.model, self.lookup = model, Lookup(model)
        self.vocabulary, self.arrays = self.lookup.vocabulary, self.lookup.arrays

    def _totals(self, level: Level, keys: np.ndarray, ranges: list[tuple[int, int, int]]) -> np.ndarray:
        """(total, n1, n2, n3+) of the contexts of sorted keys; zeros for one that never occurred."""
        totals = np.zeros((len(keys), 4), np.int64)
        context, _ = level.parts(keys)
        for part, a, b in ranges:
            seen = self.arrays(f"context{level.order}", part)
            at = np.minimum(np.searchsorted(seen, context[a:b]), len(seen) - 1)
            totals[a:b] = self.arrays(f"totals{level.order}", part)[at] * (seen[at] == context[a:b])[:, None]
        at = np.minimum(np.searchsorted(level.split[:, 0], context), len(level.split) - 1)
        shared = level.split[at, 0] == context
        totals[shared] = level.split[at[shared], 1:]
        return totals

    def score(self, bodies: list[bytes]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of each text."""
        m = self.model
        flat, starts = _tokens(bodies)
        ids = self.vocabulary.ids(flat)
        word, word_at = np.unique(ids, return_inverse=True)
        count = self.vocabulary.at("count", word)
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        low = np.full(len(word), m.gamma / (m.words + 1))
        if m.types:
            low += _discounted(self.vocabulary.at("before", word), m.discounts) / m.types
        p, ranks = low[word_at], {}
        for n, level in m.levels.items():      # from 2 up
            keys, back = np.unique(level.key(self.lookup.firsts(n, ids, starts, ranks), ids), return_inverse=True)
            at, found, ranges = self.lookup.places(level, keys)
            c = np.zeros(len(keys), np.int64)
            for part, a, b in ranges:
                c[a:b] = np.where(found[a:b], self.arrays(f"{'count' if n == m.order else 'before'}{n}", part)[at[a:b]], 0)
            totals = self._totals(level, keys, ranges)
            total = np.maximum(totals[:, 0], 1)
            share = np.where(totals[:, 0] > 0, totals[:, 1:] @ np.array(level.discounts) / total, 1.0)
            p = (_discounted(c, level.discounts) / total)[back] + share[back] * p
            if n < m.order:
                ranks[n] = self.lookup.ranks(level, at, found, ranges)[back]
        logs = np.log10(p)
        sizes = np.diff(np.append(starts, len(ids)))
        return list(zip(sizes.tolist(), np.add.reduceat((count > 0)[word_at].astype(np.int64), starts).tolist(),
                        np.add.reduceat(base[word_at], starts).tolist(), np.add.reduceat(logs, starts).tolist()))


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        scorer = Scorer(model)
        for ids, bodies in bounded_chunks(batches):
            yield _rows(schema, [(i, n, known, model.tokens, base, score)
                                 for i, (n, known, base, score) in zip(ids, scorer.score(bodies))])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    prepare(docs.sparkSession)
    return (id_and_bytes(docs).mapInArrow(
        _score(model), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


def is_held_out():
    """crc32(doc_id as text) mod 7 = 2: never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def query(spark, sf_dir: str) -> DataFrame:
    """Log probability of every whole document under the model of six sevenths of them."""
    docs = read(spark, sf_dir, "documents")
    return (score(docs, train(docs.filter(~is_held_out()))).withColumn("held_out", is_held_out())
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"))
