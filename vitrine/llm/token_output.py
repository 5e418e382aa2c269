"""Token-id output in a binary file format with Simple-8b word-aligned coding.

Documents are range-partitioned by id, encoded with a public tokenizer, and
each partition writes one file to the shared folder, so the files in order of
their index hold the ids in ascending doc_id order. Reading goes over the
files block by block.

File format (little-endian):
    magic ``S8B1``, uint32 number of blocks, uint64 number of documents,
    per block: uint64 byte offset, uint32 ids, uint32 words;
    per document: int64 doc_id, uint64 tokens (end id included);
    then the blocks' 64-bit words.
A word's top 4 bits select how many ids of how many bits the other 60 hold
(240 or 120 zeros, 60x1, 30x2, ... 1x60); selector 14 is one id of 60 bits,
selector 15 an escape: the next word is one raw 64-bit id. Blocks hold
``block_ids`` ids (the last one fewer) and are decoded without the others,
all words of a selector at once.

Encoding speed: a token never spans white space in this tokenizer (its
pattern drops white space and no special token contains any), so a text is cut
at ASCII spaces and line ends and each distinct piece is encoded once per
worker; a cache bounded in bytes, kept from task to task, holds the short pieces. Tests
compare with the library's encoding of whole texts.

Recovery: a file is written under an attempt's own name and then moved to its
final name, so a retried or speculative task replaces it by the same content.
Files are reached through the file system of the shared folder's URI.

Defined results: null text is empty: the end id alone; rows with a null id
come first; repeated rows each have their own ids, in the order of their
texts; an empty table gives no rows and no documents.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read
from vitrine.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 14
CACHE_BYTES = 192 << 20         # of cached pieces, their ids and what the table itself takes, in two generations
LONG_PIECE = 64                 # bytes; longer pieces are not cached
_ENTRY = 150                    # bytes of a cache entry besides its key's and value's text
# Fixed values of Simple-8b: (ids in a word, bits of each) by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
             (6, 10), (5, 12), (4, 15), (3, 20), (1, 60)]
ESCAPE = 15
MAGIC = b"S8B1"
HEAD, BLOCK = struct.Struct("<4sIQ"), np.dtype([("at", "<u8"), ("ids", "<u4"), ("words", "<u4")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("tokens", "<u8")])


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of 64 bits for unsigned ids; the most ids that fit go into each word."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8")
    # choice[i]: the selector of a word that begins at id i. Dense selectors are tried last and win.
    choice = np.full(n, ESCAPE, np.int8)
    taken = np.ones(n, np.int32)
    # Bits of each id: the exponent of its double, unless that was rounded up to the next power of two.
    width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    width[(width > 53) & (ids >> np.maximum(width, 1).astype(np.uint64) - np.uint64(1) == 0)] -= 1
    bad = np.zeros(n + 1, np.int32)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[selector]
        if count > n:
            continue
        over = width > bits
        if n - np.count_nonzero(over) < count:
            continue
        np.cumsum(over, dtype=np.int32, out=bad[1:])
        fits = bad[count:] == bad[:n - count + 1]
        choice[:n - count + 1][fits], taken[:n - count + 1][fits] = selector, count
    starts, step, at = [], taken.tolist(), 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        word = np.full(len(mine), selector << 60, np.uint64)
        if selector == ESCAPE:
            words[place[mine] + 1] = ids[starts[mine]]
        else:
            count, bits = SELECTORS[selector]
            for j in range(count if bits else 0):
                word |= ids[starts[mine] + j] << np.uint64(j * bits)
        words[place[mine]] = word
    return words.astype("<u8")


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a block's words."""
    words = np.asarray(words, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int8)
    # The word after an escape is raw, whatever its top bits are: runs of 15s alternate.
    escape = kind == ESCAPE
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(escape).tolist():
        if not raw[at] and at + 1 < len(words):
            raw[at + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [0])[kind]
    counts[raw] = 1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    out[starts[raw]] = words[raw]
    for selector in np.unique(kind[~raw]).tolist():
        if selector == ESCAPE:
            continue
        count, bits = SELECTORS[selector]
        mine = np.flatnonzero((kind == selector) & ~raw)
        for j in range(count if bits else 0):
            out[starts[mine] + j] = words[mine] >> np.uint64(j * bits) & np.uint64((1 << bits) - 1)
    return out


# Space, tab, line feed and return all end a piece.
_BLANKS = bytes(0x20 if b in (0x09, 0x0A, 0x0D) else b for b in range(256))
# Pre-tokens of pieces without other characters: runs of Latin-1 letters, digits, runs of punctuation but
# for the apostrophe (which may join the letters after it).
_PARTS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"      # without the apostrophe, and what special tokens begin with
_LETTERS = "".join(map(chr, [*range(97, 123), *(c for c in range(0xDF, 0x100) if c != 0xF7)]))
_PROBES = ("station", "Ünïcode", "it's", "été.", "a,", "x", "straße", "ÿ", "ABC.", "x2y30", "(ab-cd)_&", "a@b.org", "12:30")


class Pieces(dict):
    """Piece of text to its ids as uint32 bytes; a missing one is encoded when asked for.

    A run of Latin-1 letters is one pre-token, so the library's BPE model alone
    encodes it; digits and runs of punctuation are pre-tokens too and are
    encoded once. All else goes through the whole tokenizer. ``cuts`` tells
    whether the tokenizer treats pieces and pre-tokens in this way (a few
    probes decide); for one that doesn't, whole texts are encoded.
    """

    def __init__(self, tokenizer: str, most: int = CACHE_BYTES):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.most, self.held, self.before = most, 0, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.cuts = (self._whole(" a\nb  c ".encode()) == b"".join(map(self._whole, (b"a", b"b", b"c")))
                     and all(self[p.encode()] == self._whole(p.encode()) for p in _PROBES))

    def _whole(self, piece: bytes) -> bytes:
        return np.array(self.library.encode(piece.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self._ids(piece)
        if len(piece) <= LONG_PIECE:
            self.held += len(piece) + len(found) + _ENTRY
            if 2 * self.held > self.most:      # the generation before the last goes
                self.before = dict(self)
                self.clear()
                self.held = len(piece) + len(found) + _ENTRY
            self[piece] = found
        return found

    def _ids(self, piece: bytes) -> bytes:
        if piece.isalpha():      # ASCII letters: the byte-level alphabet has them as they are
            return self._word(piece.decode("ascii").lower())
        stem = piece.rstrip(_MARKS)
        if stem.isalpha():
            return self[stem] + self[piece[len(stem):]]
        parts = _PARTS.findall(piece)
        if sum(map(len, parts)) < len(piece) or b"<|" in piece:
            return self._whole(piece)
        if len(parts) > 1:
            return b"".join([self[part] for part in parts])
        if piece and piece[0] >= 0x41 and piece[0] not in _MARKS:
            return self._word(piece.decode("utf-8").lower().translate(self.letters))
        return self._whole(piece)

    def _word(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(word)])

    def encode(self, body: bytes) -> bytes:
        if not self.cuts:
            return self._whole(body)
        if b"<|" not in body:      # special tokens are told by their case, all else is lower-cased anyway
            body = body.lower()
        return b"".join(map(self.__getitem__, body.translate(_BLANKS).split(b" ")))


@cache
def _pieces(tokenizer: str) -> Pieces:
    """The worker's own, kept from task to task."""
    return Pieces(tokenizer)


class Writer:
    """Packs documents as they come and writes the file at the end."""

    def __init__(self, block_ids: int = BLOCK_IDS):
        self.block_ids, self.rest, self.held = block_ids, [], 0
        self.blocks, self.counts, self.docs, self.tokens = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((-(1 << 63) if doc_id is None else doc_id, len(ids)))
        self.tokens += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            block = ids[at:min(at + self.block_ids, whole)]
            self.blocks.append(pack(block))
            self.counts.append(len(block))
        self.rest, self.held = [ids[whole:].copy()], len(ids) - whole

    def save(self, filesystem: pafs.FileSystem, path: str) -> None:
        self._flush(True)
        index = np.zeros(len(self.blocks), BLOCK)
        index["ids"], index["words"] = self.counts, [len(b) for b in self.blocks]
        first = HEAD.size + BLOCK.itemsize * len(index) + DOCUMENT.itemsize * len(self.docs)
        index["at"] = first + 8 * np.concatenate([[0], np.cumsum(index["words"], dtype=np.uint64)])[:len(index)]
        attempt = f"{path}.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(attempt) as out:
            out.write(HEAD.pack(MAGIC, len(index), len(self.docs)))
            out.write(index.tobytes())
            out.write(np.array(self.docs, DOCUMENT).tobytes())
            for block in self.blocks:
                out.write(block.tobytes())
        filesystem.move(attempt, path)


def documents_of(filesystem: pafs.FileSystem, path: str):
    """(doc_id, ids) of every document of a file, block by block."""
    with filesystem.open_input_file(path) as f:
        magic, n_blocks, n_docs = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        index = np.frombuffer(f.read(BLOCK.itemsize * n_blocks), BLOCK)
        docs = np.frombuffer(f.read(DOCUMENT.itemsize * n_docs), DOCUMENT)
        held, block = np.zeros(0, np.uint64), 0
        for doc_id, tokens in docs.tolist():
            parts, need = [held[:tokens]], tokens - len(held[:tokens])
            held = held[len(parts[0]):]
            while need:
                f.seek(int(index["at"][block]))
                held = unpack(np.frombuffer(f.read(8 * int(index["words"][block])), "<u8"))
                block += 1
                parts.append(held[:need])
                held = held[len(parts[-1]):]
                need -= len(parts[-1])
            yield (None if doc_id == -(1 << 63) else doc_id), np.concatenate(parts)


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """A folder's file system and its path there. Hadoop's names of the S3 scheme are Arrow's ``s3``."""
    for name in ("s3a://", "s3n://"):
        if folder.startswith(name):
            folder = "s3://" + folder[len(name):]
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _name(folder: str, part: int) -> str:
    return f"{folder}/tokens-{part:08d}.s8b"


def _write(folder: str, tokenizer: str, end_id: int, block_ids: int):
    schema = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        pieces, out = _pieces(tokenizer), Writer(block_ids)
        end = np.array([end_id], "<u4").tobytes()
        for ids, bodies in bounded_chunks(batches):
            for doc_id, body in zip(ids, bodies):
                out.add(doc_id, np.frombuffer(pieces.encode(body) + end, "<u4"))
        if out.docs:
            filesystem, root = _filesystem(folder)
            filesystem.create_dir(root, recursive=True)
            out.save(filesystem, _name(root, part))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, len(out.docs), out.tokens), schema.types)], schema=schema)
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write every document; returns the manifest (part, docs, tokens, start), a row for each file."""
    spark = docs.sparkSession
    prepare(spark)
    ordered = id_and_bytes(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
    rows = ordered.mapInArrow(_write(folder, tokenizer, end_id, block_ids), "part int, docs long, tokens long").collect()
    manifest, start = [], 0
    for part, n, tokens in sorted(tuple(r) for r in rows):
        manifest.append((part, n, tokens, start))
        start += tokens
    return spark.createDataFrame(manifest, "part int, docs long, tokens long, start long")


_READ = [("doc_id", pa.int64()), ("start", pa.int64())]
_SUMS = [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
_IDS = [("token_ids", pa.list_(pa.int32()))]


def _read(folder: str, sums: bool):
    schema = pa.schema(_READ + (_SUMS if sums else _IDS))

    def run(batches):
        filesystem, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows, start, held = [], row["start"], 0
                for doc_id, ids in documents_of(filesystem, _name(root, row["part"])):
                    rows.append((doc_id, start, *((len(ids), zlib.crc32(ids.astype("<u4").tobytes())) if sums
                                                  else (ids.astype(np.int32),))))
                    start += len(ids)
                    held += 1 if sums else len(ids)
                    if held > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def _files(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(manifest.count(), 1), "part")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, token_ids) of every document, from the files of a manifest."""
    return _files(manifest).mapInArrow(_read(folder, False), "doc_id long, start long, token_ids array<int>")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document: the sums of what ``read_ids`` gives."""
    return _files(manifest).mapInArrow(_read(folder, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """Token ids of all whole documents, written in the file format and read back."""
    folder = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), folder), folder)
