"""Periodic runs of a text's words, found with an enhanced suffix array.

A run is a stretch of words with smallest period q, at least two periods long,
that no neighbouring word extends keeping the period. The texts of a chunk are
numbered (a word's number belongs to one text alone, a separator ends each
text), so one array pass serves many short texts and one long text alike.

1. Suffixes are sorted by prefix doubling: level k gives equal numbers to equal
   prefixes of 2**k words. Only suffixes whose prefix occurs again are sorted
   further. The levels also give longest common prefixes and suffixes.
2. LCP intervals come from previous and next smaller LCP values. For an interval
   of depth l, the suffixes i of all children but the largest look up the ranks
   of i + l and i - l: one within the interval, but followed by another word,
   makes a branching square of period l (no tree nodes are built).
3. A branching square stands at the end of its run; it is rotated left as far as
   the period holds. Squares of one end that lie within a run found with a
   smaller period are its multiples and merge into it.

With a least run length m, intervals shallower than m // 4 + 1 can't matter:
each smaller period has a multiple from there to m // 2, whose square ends the
same run. The smallest period is then looked for among its divisors.

Scale: one narrow pass, a text is never split or cut; a task's memory follows
the chunk (a few MB, or one longer text), times the logarithm of the longest
repeat.

Defined results: null, empty and white-space texts have no words, no run and an
empty collapsed text; repeated rows repeat; null ids pass through; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read

LEAST_LENGTH = 12


# -- the array ------------------------------------------------------------------------------------

def _dense(key: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... in the order of the keys."""
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int32)
    ordered = key[order]
    rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    return rank


def _starts(heads: np.ndarray) -> np.ndarray:
    """For each element, where its group (told by its first element) begins."""
    return np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))


def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(suffixes that share ``2**base <= depth`` words with another, sorted; levels; base)."""
    levels, base = [text], 0
    while 2 << base <= depth:
        rank, h = levels[-1], 1 << base
        after = np.zeros(len(text), np.int64)
        after[:-h] = rank[h:].astype(np.int64) + 1
        levels.append(_dense(rank.astype(np.int64) * (len(text) + 2) + after))
        base += 1
    order = np.argsort(levels[-1], kind="stable")
    ordered = levels[-1][order]
    heads = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(len(text), np.int32)
    rank[order] = _starts(heads)
    levels[-1] = rank if base else text
    shared = left = order[~(heads & np.append(heads[1:], True))]
    h = 1 << base
    while len(left):
        a, b = rank[left], rank[left + h]      # a shared prefix holds no separator: left + h is in the text
        order = np.lexsort((b, a))
        left, a, b = left[order], a[order], b[order]
        group = np.append(True, a[1:] != a[:-1])
        heads = group | np.append(True, b[1:] != b[:-1])
        rank = rank.copy()
        rank[left] = a + _starts(heads) - _starts(group)
        levels.append(rank)
        left = left[~(heads & np.append(heads[1:], True))]
        h *= 2
    return shared[np.argsort(rank[shared], kind="stable")], levels, base


def _common(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many words the suffixes at x and y share, or the texts before x and y (x < y)."""
    n = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        if forward:
            n += (levels[k][x + n] == levels[k][y + n]).astype(np.int64) << k
        else:
            at = x - n - (1 << k)
            inside = np.flatnonzero(at >= 0)
            same = levels[k][at[inside]] == levels[k][(at + y - x)[inside]]
            n[inside[same]] += 1 << k
    return n


def _smaller_before(v: np.ndarray) -> np.ndarray:
    """The last place before each with a smaller value; the first value is the smallest."""
    jump = np.arange(len(v)) - 1
    jump[0] = 0
    active = np.flatnonzero(v[jump] >= v)
    active = active[active > 0]
    while len(active):
        jump[active] = jump[jump[active]]
        active = active[(v[jump[active]] >= v[active]) & (jump[active] > 0)]
    return jump


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, every number from low to high - 1)."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]


def _squares(text: np.ndarray, sa: np.ndarray, lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching squares whose period is at least ``depth``."""
    bound = np.concatenate([[-1], lcp, [-1]])      # bound[k]: between the suffixes k - 1 and k
    k = np.flatnonzero(bound >= depth)
    if not len(k):
        return k, k
    low = _smaller_before(bound)[k]
    high = len(bound) - 1 - _smaller_before(bound[::-1])[len(bound) - 1 - k]
    order = np.lexsort((k, high, low))      # the borders of an interval's children together
    k, low, high = k[order], low[order], high[order]
    head = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    last = np.append(head[1:], True)
    interval = np.cumsum(head) - 1
    begin = np.concatenate([np.where(head, low, np.append(0, k[:-1])), k[last]])
    end = np.concatenate([k, high[last]])
    of = np.concatenate([interval, interval[last]])
    first = np.flatnonzero(head)
    order = np.lexsort((begin - end, of))      # largest child first, and left out
    small = order[np.append(False, of[order][1:] == of[order][:-1])]
    which, at = _ranges(begin[small], end[small])
    which = first[of[small][which]]
    low, high, period, i = low[which], high[which], bound[k[which]], sa[at]
    place = np.full(len(text), -1, np.int64)
    place[sa] = np.arange(len(sa))
    ahead = place[i + period]
    hit = np.flatnonzero((ahead >= low) & (ahead < high))
    hit = hit[text[i[hit] + period[hit]] != text[i[hit] + 2 * period[hit]]]
    back = place[np.maximum(i - period, 0)]
    hit2 = np.flatnonzero((i >= period) & (back >= low) & (back < high))
    hit2 = hit2[text[i[hit2]] != text[i[hit2] + period[hit2]]]
    return np.concatenate([i[hit], i[hit2] - period[hit2]]), np.concatenate([period[hit], period[hit2]])


def find_runs(text: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` words, by start, then period.

    ``text`` holds numbers from 0 up to its length; several texts may stand one
    after another if no number belongs to two of them. Each ends with a number
    that occurs nowhere else.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    none = np.zeros((0, 3), np.int64)
    depth = least // 4 + 1
    text = np.ascontiguousarray(text, np.int32)
    if not len(text):
        return none
    sa, levels, base = _suffixes(text, depth)
    if not len(sa):
        return none
    lcp = np.zeros(len(sa) - 1, np.int64)
    near = np.flatnonzero(levels[base][sa[:-1]] == levels[base][sa[1:]])
    lcp[near] = _common(levels, sa[near], sa[near + 1])
    start, period = _squares(text, sa.astype(np.int64), lcp, depth)
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    found = []
    while len(start):
        head = np.append(True, end[1:] != end[:-1])
        s, q, e = start[head], period[head], end[head]
        s = s - _common(levels, s, s + q, forward=False)
        found.append(np.stack([s, e - s, q], axis=1))
        left = start < s[np.cumsum(head) - 1]
        start, period, end = start[left], period[left], end[left]
    runs = np.concatenate(found) if found else none
    for d in range(depth - 1, 0, -1):      # the smallest divisor that holds is set last
        few = np.flatnonzero((runs[:, 2] % d == 0) & (runs[:, 2] <= least // 2) & (runs[:, 1] >= least))
        s, q = runs[few, 0], runs[few, 2]
        holds = np.ones(len(few), bool)
        for t in range(least // 2):
            holds &= (t >= q) | (text[s + np.minimum(t, q)] == text[s + np.minimum(t, q) + d])
        runs[few[holds], 2] = d
    runs = runs[runs[:, 1] >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


# -- texts ------------------------------------------------------------------------------------------

def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, a separator after each text; where each text begins."""
    flat: list[int] = []
    begins, first = [], 0
    for words in texts:
        begins.append(len(flat))
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        flat += [number(w, first + len(numbers)) for w in words]
        first += len(numbers)
        flat.append(first)
        first += 1
    return np.array(flat, np.int32), np.array(begins, np.int64)


def runs_of(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """The runs (start, length, period) of each text."""
    flat, begins = _numbered(texts)
    runs = find_runs(flat, least)
    cuts = np.searchsorted(runs[:, 0], np.append(begins, len(flat)))
    return [runs[a:b] - np.array([begin, 0, 0]) for a, b, begin in zip(cuts[:-1], cuts[1:], begins)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, of each run only its first period."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(step[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(least: int, rewrite):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN), ("collapsed", pa.string())])

    def run(batches):
        for ids, bodies in bounded_chunks(batches, 2 << 20):
            texts = [b.split() for b in bodies]      # of bytes: at ASCII white space
            if rewrite:
                texts = [rewrite(i, words) for i, words in zip(ids, texts)]
            found = runs_of(texts, least)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            columns = np.concatenate(found).T
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                              fields=list(RUN.value_type))
            collapsed = [collapse(words, f) for words, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), rows),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)
    return run


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH,
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text: ``runs`` lists (start, length, period)
    by start, then period; ``collapsed`` is the text with the first period of each run alone.
    ``rewrite`` may change a text's words before (id, words -> words)."""
    prepare(docs.sparkSession)
    return id_and_bytes(docs).mapInArrow(_find(least_length, rewrite), SCHEMA)


# -- the registered query -----------------------------------------------------------------------------

def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten (by CRC-32 of its decimal id; of nothing for a null id) goes on periodically from some word."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[:n - a]


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row, and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"),
                        "collapsed", "n_words")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                       (-F.col("best.period")).alias("period"),
                       F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
                       F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
                       "n_words")


def query(spark, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words of every whole document, one in ten made periodic first."""
    return digests(periodic_runs(read(spark, sf_dir, "documents"), rewrite=planted))
