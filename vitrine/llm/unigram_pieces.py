"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public model file (never trained here). A text gets the
white-space marker (U+2581) for each space and one at its front; the best
segmentation maximises the sum of the pieces' log scores; a character that no
piece covers becomes its UTF-8 bytes as byte pieces. Decoding joins the
pieces, turns byte pieces into bytes and markers into spaces, and drops the
marker added at the front, so decode(encode(text)) is the text, unless it
itself holds the marker character (which decodes to a space).

Scores: ``zipf`` (default) gives piece number i the log probability
-log(i + 2) up to a constant, the usual rank law, since the public file holds
merge ranks and no probabilities; ``model`` takes the file's own scores (for a
unigram model file). Byte pieces cost ``byte_penalty`` each, below all others.

No piece of the file has a marker after another character, so a segmentation
falls apart into units (markers, then the characters up to the next marker);
the loader checks this. Distinct units of a chunk are segmented together: the
double-array trie is walked for all start bytes at once in numpy, and the
Viterbi recursion goes by end offset over all units. A cache bounded in bytes
keeps the short units of a worker. One narrow pass over the documents; nothing
is shuffled.

Long units (scripts without spaces, encoded data) are read in windows. Where no
piece of the table crosses a character border, a segmentation falls apart, so a
long unit is cut there into short ones; a stretch without such a border goes
through the recursion edge by edge, in windows too, and keeps a score and a
piece number for each byte. Memory is about 20 bytes for each byte of a text.

Defined results: null and empty text: no pieces; ties between segmentations:
the longer last piece; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
CACHE_BYTES = 48 << 20          # of cached units, their ids and what the table itself takes
LONG_UNIT = 1 << 12             # bytes; longer units are cut at borders and not cached
WINDOW = 1 << 16                # bytes of a long unit read at once
SLICE = 1 << 20                 # bytes of a text cut into units at once
_ENTRY = 150                    # bytes of a cache entry besides its key's and value's text
_MARK = MARKER.encode("utf-8")
# Markers, then all up to the next one; possessive, since a match keeps no way back.
_UNIT = re.compile(b"(?:\xe2\x96\x81)*+(?:[^\xe2]++|\xe2(?!\x96\x81))++|(?:\xe2\x96\x81)++")


class DoubleArray:
    """Trie of byte strings in two arrays: state t follows s on byte b if t = base[s] + b + 1 and check[t] = s."""

    def __init__(self, words: dict[bytes, int]):
        keys = sorted(words)
        n = max(1 << 12, 4 * sum(map(len, keys)))
        self.base, self.check = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        self.value = np.full(n, -1, np.int32)
        self.check[0] = 0
        free, top = 1, 0
        work = [(0, 0, len(keys), 0)]      # state, keys from..to, depth
        while work:
            state, low, high, depth = work.pop()
            if low < high and len(keys[low]) == depth:
                self.value[state] = words[keys[low]]
                low += 1
            if low == high:
                continue
            parts, at = [], low
            while at < high:
                byte, start = keys[at][depth], at
                while at < high and keys[at][depth] == byte:
                    at += 1
                parts.append((byte, start, at))
            while self.check[free] != -1:
                free += 1
            base = self._place(np.array([b + 1 for b, _, _ in parts]), free)
            self.base[state] = base
            for byte, start, end in parts:
                child = base + byte + 1
                self.check[child] = state
                top = max(top, child)
                work.append((child, start, end, depth + 1))
        size = top + 258      # any state + any byte stays within the arrays
        self.base, self.check, self.value = (np.resize(a, size) if len(a) < size else a[:size].copy()
                                             for a in (self.base, self.check, self.value))

    def _place(self, offsets: np.ndarray, free: int) -> int:
        """The first base at which all of a state's children fall on unused entries."""
        at = max(free, int(offsets[0]))      # the first child is placed there or later
        while True:
            if at + 4096 + 257 > len(self.check):
                more = len(self.check)
                self.base = np.append(self.base, np.zeros(more, np.int32))
                self.check = np.append(self.check, np.full(more, -1, np.int32))
                self.value = np.append(self.value, np.full(more, -1, np.int32))
            bases = np.flatnonzero(self.check[at:at + 4096] == -1) + at - offsets[0]
            fits = (self.check[bases[:, None] + offsets] == -1).all(axis=1)
            if fits.any():
                return int(bases[np.argmax(fits)])
            at += 4096

    def matches(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of every word that stands in ``data``, begins at one of the first
        ``len(limit)`` places and ends at or before ``limit[start]``."""
        at = np.arange(len(limit))
        state = np.zeros(len(limit), np.int64)
        depth, found = 0, []
        while len(at):
            inside = at + depth < limit[at]
            at, state = at[inside], state[inside]
            follow = self.base[state] + data[at + depth].astype(np.int64) + 1
            good = self.check[follow] == state
            at, state = at[good], follow[good]
            depth += 1
            hit = self.value[state] >= 0
            if hit.any():
                found.append((at[hit], np.full(int(hit.sum()), depth), self.value[state[hit]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


class Unigram:
    """A piece table with scores; ``segment`` finds the best segmentation of many units at once."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], byte_penalty: float,
                 usable: list[bool] | None = None):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids)
        ok = [i for i in range(len(pieces)) if (usable is None or usable[i]) and pieces[i]]
        for i in ok:
            if MARKER in pieces[i].lstrip(MARKER):
                raise ValueError(f"piece {pieces[i]!r} has a marker after another character")
        self.scores = np.array(scores, np.float64)
        self.byte_penalty = byte_penalty
        self.trie = DoubleArray({pieces[i].encode("utf-8"): i for i in ok})
        self.longest = max((len(pieces[i].encode("utf-8")) for i in ok), default=1)
        self.sizes = np.array([len(p.encode("utf-8")) for p in pieces], np.int64)
        byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.surface = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARKER, " ").encode("utf-8")
                        for i, p in enumerate(pieces)]
        self.cache: dict[bytes, bytes] = {}
        self.cached = 0      # bytes

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "cached": 0}

    @classmethod
    def load(cls, model: str = MODEL, scores: str = "zipf") -> "Unigram":
        import public_tokenizers
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
        usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        score = [-math.log(i + 2) for i in range(n)] if scores == "zipf" else [sp.get_score(i) for i in range(n)]
        return cls(pieces, score, byte_ids, min(score) - 10.0, usable)

    def segment(self, units: list[bytes]) -> list[bytes]:
        """Piece ids (uint32 bytes) of each unit."""
        data = np.frombuffer(b"".join(units), np.uint8)
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes)
        first = np.repeat(ends - sizes, sizes)
        limit = np.repeat(ends, sizes)
        start, length, piece = self.trie.matches(data, limit)
        score = self.scores[piece]
        # Byte fallback: one edge for each character, of as many byte pieces as it has bytes.
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(data)))
        start = np.concatenate([start, lead])
        length = np.concatenate([length, width])
        piece = np.concatenate([piece, np.full(len(lead), -1)])
        score = np.concatenate([score, width * self.byte_penalty])
        # Only edges between character borders; then by offset of the end, end, longer last.
        end = start + length
        offset = end - first[start]
        order = np.argsort((offset * (len(data) + 1) + end) * (self.longest + 4) + length)      # no two are alike
        start, length, piece, score, end, offset = (x[order] for x in (start, length, piece, score, end, offset))
        slot = lambda pos_first, pos: pos + unit_of[pos_first]      # noqa: E731  a unit of n bytes has n + 1 slots
        unit_of = np.repeat(np.arange(len(units)), sizes)
        best = np.full(len(data) + len(units), -np.inf)
        back = np.zeros(len(best), np.int64)
        best[(ends - sizes) + np.arange(len(units))] = 0.0
        source, target = slot(start, start), slot(start, end)
        cuts = np.searchsorted(offset, np.arange(1, offset[-1] + 2)) if len(offset) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            total = best[source[a:b]] + score[a:b]
            to = target[a:b]
            heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(total, heads)
            good = np.flatnonzero(total == np.repeat(top, np.diff(np.append(heads, b - a))))
            best[to[good]] = total[good]
            back[to[good]] = a + good      # the last of equals, which is the longest
        # Back from the ends of all units at once; then the edges of each unit in order.
        begin, at = ends - sizes, ends.copy()
        active, edges, owners = np.flatnonzero(sizes > 0), [], []
        while len(active):
            edge = back[at[active] + active]
            edges.append(edge)
            owners.append(active)
            at[active] = start[edge]
            active = active[at[active] > begin[active]]
        if not edges:
            return [b""] * len(units)
        owner, edge = np.concatenate(owners[::-1]), np.concatenate(edges[::-1])
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        # A piece is one id, a character without one as many as it has bytes.
        n = np.where(piece[edge] >= 0, 1, length[edge])
        ids = np.repeat(piece[edge], n)
        by_byte = np.flatnonzero(np.repeat(piece[edge], n) < 0)
        if len(by_byte):
            place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[edge], n)
            ids[by_byte] = self.byte_ids[data[place[by_byte]]]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, n, len(units)))]).astype(np.int64) * 4
        flat, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _windows(self, unit: bytes):
        """(first byte, bytes, starts, lengths, pieces) of the matches that begin in each window of a long unit."""
        data = np.frombuffer(unit, np.uint8)
        for at in range(0, len(data), WINDOW):
            part = data[at:at + WINDOW + self.longest]
            yield at, part, *self.trie.matches(part, np.full(min(WINDOW, len(data) - at), len(part)))

    def _apart(self, unit: bytes):
        """A long unit cut, in lists, at all character borders that no piece crosses."""
        begin, crossing = 0, np.zeros(1, np.int64)      # how many matches cross the borders before each byte
        for at, part, start, length, _ in self._windows(unit):
            step = np.zeros(len(part) + 1, np.int64)
            step[:min(len(crossing), len(step))] += crossing[:len(step)]
            np.add.at(step, start + 1, 1)
            np.add.at(step, start + length, -1)
            cover = np.cumsum(step)
            inside = min(WINDOW, len(part))
            free = np.flatnonzero((cover[:inside] == 0) & ((part[:inside] & 0xC0) != 0x80)) + at
            crossing = step[inside:].copy()
            if len(crossing):
                crossing[0] = cover[inside]
            cuts = [begin, *free[free > begin].tolist()]
            yield [unit[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            begin = cuts[-1]
        yield [unit[begin:]]

    def _segment_long(self, unit: bytes) -> bytes:
        """Piece ids of a unit without any border, edge by edge."""
        n = len(unit)
        best, back = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1)))
        for i in range(1, n + 1):
            best[i] = -math.inf
        held = [np.zeros(0, np.int64)] * 3      # edges that end beyond their window
        for at, part, start, length, piece in self._windows(unit):
            last = at + WINDOW >= n
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            width = np.diff(np.append(lead, len(part)))
            mine = lead < WINDOW
            # Byte fallback: piece -w for a character of w bytes.
            edges = [np.concatenate([start, lead[mine]]) + at, np.concatenate([length, width[mine]]),
                     np.concatenate([piece, -width[mine]])]
            start, length, piece = (np.concatenate(x) for x in zip(held, edges))
            now = np.ones(len(start), bool) if last else start + length <= at + WINDOW
            held = [x[~now] for x in (start, length, piece)]
            start, length, piece = start[now], length[now], piece[now]
            order = np.lexsort((length, start + length))
            start, length, piece = start[order], length[order], piece[order]
            score = np.where(piece >= 0, self.scores[piece], length * self.byte_penalty)
            for s, e, k, x in zip(start.tolist(), (start + length).tolist(), piece.tolist(), score.tolist()):
                x += best[s]
                if x >= best[e]:      # of equals the longer piece, which comes later
                    best[e] = x
                    back[e] = k
        out, at = array("I"), n
        while at:
            k = back[at]
            if k >= 0:
                out.append(k)
                at -= int(self.sizes[k])
            else:
                out.extend(self.byte_ids[list(unit[at + k:at])][::-1].tolist())
                at += k
        return np.array(out, "<u4")[::-1].tobytes()

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """Piece ids of units, those of ``LONG_UNIT`` bytes or less some at a time."""
        out, at, held = [], 0, 0
        for i, unit in enumerate(units):
            held += len(unit)
            if held > 1 << 17 or i + 1 == len(units):
                out += self.segment(units[at:i + 1])
                at, held = i + 1, 0
        return out

    def _long(self, unit: bytes) -> bytes:
        out = []
        for parts in self._apart(unit):
            short = [p for p in parts if len(p) <= LONG_UNIT]
            found = iter(self._ids(short))
            out.append(b"".join([next(found) if len(p) <= LONG_UNIT else self._segment_long(p) for p in parts]))
        return b"".join(out)

    def _slices(self, body: bytes):
        """A text with its first marker, cut before spaces that begin a unit."""
        at = 0
        while at < len(body):
            end = at + SLICE
            while 0 < end < len(body):
                end = body.find(b" ", end)
                if end > 0 and body[end - 1] != 0x20 and body[end - 3:end] != _MARK:
                    break
                end += end > 0
            end = len(body) if end <= 0 else min(end, len(body))
            yield (b"" if at else _MARK) + body[at:end].replace(b" ", _MARK)
            at = end

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each text."""
        whole: list[list[bytes]] = [[] for _ in bodies]      # ids by slice
        waiting, held = [], 0

        def flush():
            every = set().union(*[units for _, units in waiting])
            long = {u for u in every if len(u) > LONG_UNIT}
            fresh = list(every.difference(self.cache, long))
            size = sum(map(len, fresh))
            if self.cached + 5 * size + _ENTRY * len(fresh) > CACHE_BYTES:
                self.cache.clear()
                self.cached, fresh = 0, list(every - long)
            found = dict(zip(fresh, self._ids(fresh)))
            self.cache.update(found)      # of one slice at most
            self.cached += sum(map(len, fresh)) + sum(map(len, found.values())) + _ENTRY * len(fresh)
            get = self.cache.__getitem__
            for at, units in waiting:
                if long:
                    whole[at].append(b"".join([self._long(u) if u in long else get(u) for u in units]))
                else:
                    whole[at].append(b"".join(map(get, units)))
            waiting.clear()

        for at, body in enumerate(bodies):
            for part in self._slices(body):
                waiting.append((at, _UNIT.findall(part)))
                held += len(part)
                if held >= SLICE:
                    flush()
                    held = 0
        flush()
        return [np.frombuffer(b"".join(parts), "<u4") for parts in whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids, as bytes."""
        if not len(ids):
            return b""
        found = b"".join([b"".join(map(self.surface.__getitem__, ids[at:at + WINDOW].tolist()))
                          for at in range(0, len(ids), WINDOW)])
        return found[1:] if found.startswith(b" ") else found


@cache
def _loaded(model: str, scores: str) -> Unigram:
    return Unigram.load(model, scores)


def _share(spark, model: str, scores: str):
    """The table, built once on the driver, as a broadcast (its size is that of the model file)."""
    prepare(spark)
    return spark.sparkContext.broadcast(_loaded(model, scores))


_ENCODED = [("doc_id", pa.int64()), ("piece_ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()),
            ("n_bytes", pa.int64()), ("log_score", pa.float64())]
_DECODED = [("text", pa.binary())]
ENCODED = "doc_id long, piece_ids array<int>, n_pieces long, n_bytes long, log_score double"
DECODED = "text binary"


def _with_sums(decoded: DataFrame) -> DataFrame:
    """The bytes ``text`` as a string, and their CRC-32 and length."""
    return (decoded.withColumns({"text_crc32": F.crc32("text"), "text_length": F.octet_length("text").cast("long")})
            .withColumn("text", F.col("text").cast("string")))


def _encode(shared, decoded: bool):
    schema = pa.schema(_ENCODED + _DECODED * decoded)

    def run(batches):
        table = shared.value
        for ids, bodies in bounded_chunks(batches, 1 << 20):
            found = table.encode(bodies)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            is_byte = np.isin(np.arange(len(table.pieces)), table.byte_ids)
            cost = np.where(is_byte, table.byte_penalty, table.scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([int(is_byte[f].sum()) for f in found], pa.int64()),
                 pa.array([float(cost[f].sum()) for f in found], pa.float64()),
                 *([pa.array([table.decode(f) for f in found], pa.binary())] if decoded else [])], schema=schema)
    return run


def encode(docs: DataFrame, model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """(doc_id, piece_ids, n_pieces, n_bytes, log_score): n_bytes counts byte-fallback pieces."""
    return id_and_bytes(docs).mapInArrow(_encode(_share(docs.sparkSession, model, scores), False), ENCODED)


def round_trip(docs: DataFrame, model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """``decode(encode(docs))`` in one pass: ids are decoded where they were made."""
    return _with_sums(id_and_bytes(docs).mapInArrow(_encode(_share(docs.sparkSession, model, scores), True),
                                                    f"{ENCODED}, {DECODED}"))


def _decode(shared):
    schema = pa.schema(_ENCODED + _DECODED)

    def run(batches):
        table = shared.value
        for batch in batches:
            # The decoded texts of a whole batch are never held together.
            at, held, texts = 0, 0, []
            for i, ids in enumerate(batch.column(1)):
                texts.append(table.decode(ids.values.to_numpy(zero_copy_only=False)))
                held += len(texts[-1])
                if held > 1 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, pa.array(texts, pa.binary())],
                                                     schema=schema)
                    at, held, texts = i + 1, 0, []
    return run


def decode(encoded: DataFrame, model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """The columns of ``encode``, the decoded ``text``, and its CRC-32 and length in bytes."""
    return _with_sums(encoded.select("doc_id", "piece_ids", "n_pieces", "n_bytes", "log_score").mapInArrow(
        _decode(_share(encoded.sparkSession, model, scores)), f"{ENCODED}, {DECODED}"))


def query(spark, sf_dir: str) -> DataFrame:
    """Piece ids of all whole documents, and the checksum and length of the text decoded from them."""
    return round_trip(read(spark, sf_dir, "documents")).drop("text")
