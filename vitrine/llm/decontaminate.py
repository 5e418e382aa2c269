"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams (seeds). Every document, read whole in
one narrow pass, is joined to the items by the seeds it holds; places that
share enough seeds with an item are aligned with it word by word
(Smith-Waterman: equal word +1, other word 0, gap -1), and an item counts as
leaked when its best local score reaches ``similarity`` of its own length: at
0.8 a fifth of its words may be replaced, inserted or cut off.

Nothing is lost by the seeds. A score of t*n leaves a budget of B = (1-t)*n;
every replaced, inserted, deleted or cut word costs 1 or more of it and breaks
at most q seeds, so n - (q-1) - q*B of an item's seeds survive: with q = 3 and
t = 0.8 at least one, from six words on. (Seeds of five words would lose copies
whose edits lie evenly.) Shorter items take the widest seed that leaves one:
two words in items of two or five, the word itself in items of one. Places with
fewer are skipped. Rare seeds (in at most
``max_items`` items) open a place; seeds that
many items share only count along, except in items so poor in rare seeds that
the bound would not leave one: there every seed opens.

Scale: documents are read once and never shuffled, whatever passage a third of
them share; only leaks leave the tasks. The index is built in Spark: seeds with
their items are counted, and those that open a place are stored as sorted hash
arrays, one file for each hash range (their number follows the benchmark's
size); item words are stored as written by the tasks that cut them. Workers map
the files into memory from the shared folder, so a benchmark of any size costs
no driver or broadcast memory. Words are compared by 64-bit hashes.

Words are runs of digits, letters and other non-ASCII characters; in scripts
written without spaces (Han, kana, Thai, Lao, Khmer, Burmese and the like) each
character is a word, and full-width punctuation separates.

Defined results: items without a word (null, empty, punctuation alone) identify
nothing and are left out; at 0.8 items of up to four words have to stand
verbatim; items of fewer than ``least_words`` words (1: none) are left out too;
null texts are empty; an item
that occurs several times in a document gives its best place, the first of
equals; equal items each give a row; repeated documents repeat their rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import (WordHashes, bounded_chunks, id_and_bytes, map_array, model_folder, prepare, read,
                                save_array)
from vitrine.llm.license_scan import words_of
from vitrine.session import materialize

Q = 3
SIMILARITY = 0.8
MAX_ITEMS = 8
RANGE_WORDS = 4 << 20           # item words for each file of seeds
MIX = 0x9E3779B97F4A7C15

# As UTF-8: ideographic space and punctuation U+3000-4, U+3008-20, U+3030-3F, the
# middle dot U+30FB, full-width punctuation U+FF01-0F, U+FF1A-20, U+FF3B-40, U+FF5B-65.
_WIDE_PUNCTUATION = re.compile(
    rb"\xe3\x80[\x80-\x84\x88-\xa0\xb0-\xbf]|\xe3\x83\xbb|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
# Characters of scripts without spaces between words.
_UNSPACED = re.compile(
    rb"\xe0[\xb8-\xbf][\x80-\xbf]"                                  # Thai, Lao, Tibetan
    rb"|\xe1(?:[\x80\x81\x9e\x9f\xa6-\xa9\xac\xad][\x80-\xbf]"        # Burmese, Khmer, Tai, Balinese
    rb"|\x82[\x80-\x9f]|\xa5[\x90-\xbf]|\xaa[\x80-\xaf])"
    rb"|\xe3(?:\x80[\x85-\x87\xa1-\xaf]|[\x81-\xbf][\x80-\xbf])"     # kana, bopomofo, Han
    rb"|[\xe4-\xe9][\x80-\xbf]{2}"                                   # Han
    rb"|\xea(?:[\x80-\x92\xa6\xa7\xaa][\x80-\xbf]|\x93[\x80-\x8f]|\xa9[\xa0-\xbf]|\xab[\x80-\x9f])"
    rb"|\xef(?:[\xa4-\xab][\x80-\xbf]|\xbd[\xa6-\xbf]|\xbe[\x80-\x9f])"    # compatibility Han, half-width kana
    rb"|\xf0(?:\x9b[\x80-\x85]|[\xa0-\xbf][\x80-\xbf])[\x80-\xbf]")


def tokens_of(body: bytes) -> list[bytes]:
    """Words; single characters where a script has no spaces between them."""
    if not body.isascii():
        body = _UNSPACED.sub(rb" \g<0> ", _WIDE_PUNCTUATION.sub(b" ", body))
    return words_of(body)


def seed_width(n: int, q: int = Q, similarity: float = SIMILARITY) -> int:
    """The widest seed, up to ``q``, of which one survives in an item of ``n`` words; one word at least."""
    budget = int((1 - similarity) * n + 1e-9)
    return max(1, min(q, n // (budget + 1)))


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, first position in ``text`` at which it ends). Words are
    numbers; those of an item are above 0. Scores are never below 0, since a
    path may begin anywhere at 0 and other words cost nothing."""
    slope = np.arange(1, len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, -1
    for word in item.tolist():
        row = np.maximum(above[:-1] + (text == word), above[1:] - 1)
        row = np.maximum.accumulate(row + slope) - slope      # gaps along the text
        top = int(row.max(initial=0))
        if top > best:
            best, end = top, int(row.argmax())
        above[1:] = row
    return best, end


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, last word) of the best local alignment within ``text``."""
    score, end = smith_waterman(item, text)
    if not score:
        return 0, -1, -1
    # Backwards from the end the same score is reached first at the start.
    _, back = smith_waterman(item[::-1], text[:end + 1][::-1])
    return score, end - back, end


def grams_of(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of every ``q`` words that stand one after another."""
    out = np.zeros(max(len(words) - q + 1, 0), np.uint64)
    for j in range(q):
        out = (out ^ words[j:j + len(out)]) * np.uint64(MIX)
        out ^= out >> np.uint64(29)
    return out


def needed_seeds(n: int, q: int, distinct: int, similarity: float = SIMILARITY) -> int:
    """How many of its ``distinct`` seeds a place shares at least with an item of ``n`` words that leaked there."""
    survivors = n - (q - 1) - q * int((1 - similarity) * n + 1e-9)
    # They are counted with repeats; an item's repeated seeds count once in a place.
    return max(1, survivors - (n - q + 1 - distinct))


# -- the index ----------------------------------------------------------------------------------------

_SEEDS = pa.schema([("width", pa.int32()), ("seed", pa.int64()), ("item", pa.int64()), ("need", pa.int32())])
_SHARD = 33      # an item's number: the task that cut it, then its place there


def _cut_items(folder: str, q: int, similarity: float, least_words: int):
    """Stores the words of the items of a partition; rows (width, seed, item, need) of their distinct seeds,
    and one row (-1, task, items, 0) and (-2, task, words, 0) with what was stored."""
    def run(batches):
        from pyspark import TaskContext
        shard, hashes = TaskContext.get().partitionId(), WordHashes()
        ids, words, rows = [], [], []

        def row_batch():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows]), t) for i, t in
                                                enumerate(_SEEDS.types)], schema=_SEEDS)
            rows.clear()
            return batch

        for item_ids, bodies in bounded_chunks(batches):
            for item_id, body in zip(item_ids, bodies):
                text = hashes.of(tokens_of(body))
                if len(text) < max(least_words, 1):
                    continue
                width = seed_width(len(text), q, similarity)
                seeds = np.unique(grams_of(text, width)).view(np.int64)
                n = len(seeds)
                rows.append((np.full(n, width, np.int32), seeds, np.full(n, shard << _SHARD | len(ids)),
                             np.full(n, needed_seeds(len(text), width, n, similarity), np.int32)))
                ids.append(item_id)
                words.append(text)
            if rows:
                yield row_batch()
        if ids:
            save_array(folder, f"id-{shard}", np.array([i or 0 for i in ids], np.int64))
            save_array(folder, f"null-{shard}", np.array([i is None for i in ids]))
            save_array(folder, f"end-{shard}", np.cumsum([len(w) for w in words]))
            save_array(folder, f"word-{shard}", np.concatenate(words))
            for kind, size in ((-1, len(ids)), (-2, sum(map(len, words)))):
                rows.append(([kind], [shard], [size], [0]))
            yield row_batch()
    return run


def _store_seeds(folder: str):
    """Stores the opening seeds of each (width, range), sorted, with the items of each."""
    schema = pa.schema([("part", pa.int32()), ("seeds", pa.int64()), ("items", pa.int64())])

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            part, seed, item = (batch.column(i).to_numpy() for i in range(3))
            for p in np.unique(part).tolist():
                found.setdefault(p, []).append((seed[part == p].view(np.uint64), item[part == p]))
        for p, blocks in found.items():
            seed, item = (np.concatenate(x) for x in zip(*blocks))
            order = np.lexsort((item, seed))
            seed, item = seed[order], item[order]
            heads = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
            save_array(folder, f"seed-{p}", seed[heads])
            save_array(folder, f"first-{p}", np.append(heads, len(seed)))
            save_array(folder, f"item-{p}", item)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((p, len(heads), len(seed)), schema.types)],
                                             schema=schema)
    return run


@dataclass
class SeedIndex:
    """Where the arrays are and how long each is; a few numbers for each file."""
    folder: str
    n_ranges: int
    seeds: dict[int, tuple[int, int]]         # (width * n_ranges + range): seeds, items
    items: dict[int, tuple[int, int]]         # task: items, words
    similarity: float
    q: int

    @property
    def widths(self) -> list[int]:
        return sorted({part // self.n_ranges for part in self.seeds}, reverse=True)


def build_index(benchmark: DataFrame, q: int = Q, similarity: float = SIMILARITY, max_items: int = MAX_ITEMS,
                least_words: int = 1, range_words: int = RANGE_WORDS) -> SeedIndex:
    """Cut and store the items of ``benchmark`` (item_id, text)."""
    spark = benchmark.sparkSession
    prepare(spark)
    folder = model_folder(spark, "seed-index")
    items = id_and_bytes(benchmark, "item_id").toDF("item_id", "body").filter(F.length("body") > 0)
    cut = materialize(items.mapInArrow(_cut_items(folder, q, similarity, least_words),
                                       "width int, seed long, item long, need int"), "seed-postings")
    stored: dict[int, tuple[int, int]] = {}
    for r in cut.filter("width < 0").orderBy(F.desc("width")).collect():      # two rows for each task
        stored[r.seed] = (*stored.get(r.seed, ()), r.item)
    n_ranges = max(1, -(-sum(words for _, words in stored.values()) // range_words))
    postings = cut.filter("width > 0")
    common = postings.groupBy("width", "seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_items)
    common = materialize(common.select("width", "seed", F.lit(True).alias("common")), "common-seeds")
    poor = (postings.join(common, ["width", "seed"]).groupBy("item", "need").agg(F.count(F.lit(1)).alias("n"))
            .filter("n >= need").select("item", F.lit(True).alias("poor")))
    opening = (postings.join(common, ["width", "seed"], "left").join(poor, "item", "left")
               .filter("common IS NULL OR poor IS NOT NULL"))
    # The range of an unsigned hash by its upper 32 bits.
    part = (F.col("width") * n_ranges
            + F.shiftright(F.shiftrightunsigned("seed", 32) * F.lit(n_ranges).cast("long"), 32)).cast("int")
    rows = (opening.select(part.alias("part"), "seed", "item").repartition(n_ranges, "part")
            .mapInArrow(_store_seeds(folder), "part int, seeds long, items long").collect())      # one for each file
    return SeedIndex(folder, n_ranges, {r.part: (r.seeds, r.items) for r in rows}, stored, similarity, q)


class Searcher:
    """Finds the leaks of texts with the mapped arrays of an index."""

    def __init__(self, index: SeedIndex):
        self.index, self.hashes, self.open = index, WordHashes(), {}

    def _array(self, name: str, part: int, size: int) -> np.ndarray:
        if (name, part) not in self.open:
            self.open[name, part] = map_array(self.index.folder, f"{name}-{part}", size)
        return self.open[name, part]

    def item(self, number: int) -> tuple[int | None, np.ndarray]:
        shard, at = number >> _SHARD, number & (1 << _SHARD) - 1
        n, words = self.index.items[shard]
        end = self._array("end", shard, n)
        item_id = None if self._array("null", shard, n)[at] else int(self._array("id", shard, n)[at])
        return item_id, np.asarray(self._array("word", shard, words)[int(end[at - 1]) if at else 0:int(end[at])])

    def _opened(self, grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) wherever an opening seed of an item stands."""
        n_ranges, places, items = self.index.n_ranges, [], []
        of = ((grams >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        for r in range(n_ranges):
            part = width * n_ranges + r
            if part not in self.index.seeds:
                continue
            seeds, n_items = self.index.seeds[part]
            mine = np.arange(len(grams)) if n_ranges == 1 else np.flatnonzero(of == r)
            table = self._array("seed", part, seeds)
            at = np.minimum(np.searchsorted(table, grams[mine]), seeds - 1)
            hit = np.flatnonzero(table[at] == grams[mine])
            if not len(hit):
                continue
            first = self._array("first", part, seeds + 1)
            low, size = first[at[hit]], first[at[hit] + 1] - first[at[hit]]
            which = np.repeat(np.arange(len(hit)), size)
            posting = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
            places.append(mine[hit][which])
            items.append(self._array("item", part, n_items)[posting])
        if not places:
            return (np.zeros(0, np.int64),) * 2
        return np.concatenate(places), np.concatenate(items)

    def leaks(self, bodies: list[bytes]) -> list[tuple]:
        """(text number, item_id, score, first_word, last_word, n_seeds) of each leaked item."""
        texts = [self.hashes.of(tokens_of(b)) for b in bodies]
        sizes = np.array([len(t) for t in texts])
        words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(texts)), sizes)
        out = []
        for width in self.index.widths:
            grams = grams_of(words, width)
            if not len(grams):
                continue
            place, item = self._opened(grams, width)
            inside = of[place] == of[place + width - 1]
            place, item = place[inside], item[inside]
            if not len(place):
                continue
            order = np.lexsort((place, item, of[place]))
            place, item = place[order], item[order]
            text = of[place]
            cuts = np.append(np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]))), len(item))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = int(text[a])
                low = int(begin[at])
                leak = self._best(texts[at], grams[low:low + int(sizes[at]) - width + 1], place[a:b] - low, int(item[a]), width)
                if leak:
                    out.append((at, *leak))
        return out

    def _best(self, text: np.ndarray, grams: np.ndarray, places: np.ndarray, number: int, width: int) -> tuple | None:
        """(item_id, score, first word, last word, seeds) of the best place at which an item leaked into a text."""
        item_id, words = self.item(number)
        n, best = len(words), None
        seeds = np.unique(grams_of(words, width))
        need = needed_seeds(n, width, len(seeds), self.index.similarity)
        gaps = np.flatnonzero(np.diff(places) > 2 * n) + 1
        for c, d in zip([0, *gaps.tolist()], [*gaps.tolist(), len(places)]):
            first, last = max(int(places[c]) - 2 * n, 0), int(places[d - 1]) + 2 * n
            shared = int(np.isin(seeds, grams[first:last + 1]).sum())
            if shared < need:
                continue
            score, start, end = align(words, text[first:last + width])
            if score >= self.index.similarity * n - 1e-9 and (best is None or score > best[1]):
                best = (item_id, score, first + start, first + end, shared)
        return best and (best[0], best[1] / n, *best[2:])


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                    ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_seeds", pa.int64())])


def _leaks(index: SeedIndex):
    def run(batches):
        searcher = Searcher(index)
        for ids, bodies in bounded_chunks(batches):
            rows = [(ids[leak[0]], *leak[1:]) for leak in searcher.leaks(bodies)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LEAKS.types)], schema=_LEAKS)
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, similarity: float = SIMILARITY,
          max_items: int = MAX_ITEMS, least_words: int = 1, range_words: int = RANGE_WORDS) -> DataFrame:
    """One row per leaked (doc_id, item_id): score (0 to 1), first_word, last_word, n_seeds."""
    index = build_index(benchmark, q, similarity, max_items, least_words, range_words)
    return id_and_bytes(docs).mapInArrow(
        _leaks(index), "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long")


def query(spark, sf_dir: str) -> DataFrame:
    """Every test item that a whole document holds, exactly or edited, with its score and place."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
