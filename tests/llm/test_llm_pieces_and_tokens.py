import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_data import SF, frame, rows, sample
from vitrine.llm import token_output as T
from vitrine.llm import unigram_pieces as U


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert np.array_equal(T.unpack(T.pack(a)), a)


def test_simple8b_words_take_as_many_ids_as_fit():
    assert len(T.pack(np.zeros(480, np.uint64))) == 2
    assert len(T.pack(np.full(60, 1023, np.uint64))) == 10
    assert len(T.pack(np.array([1 << 60], np.uint64))) == 2          # escape and raw word
    assert len(T.pack(np.array([(1 << 64) - 1] * 3, np.uint64))) == 6


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))


def tokens_of(library, data):
    out, start = [], 0
    for doc_id, text in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_token_files_equal_the_library(spark, library, tmp_path):
    got = sorted((tuple(r) for r in T.query(spark, SF).collect()), key=str)
    assert got == tokens_of(library, [(d["doc_id"], d["text"]) for d in sample()])


def test_token_edges(spark, library, tmp_path):
    data = rows() + [(20, "<|endoftext|> it's we'll été <|startoftext|>x", "en", "a", 1)]
    manifest = T.write_tokens(frame(spark, data), str(tmp_path), block_ids=100)
    got = sorted((tuple(r) for r in T.read_tokens(manifest, str(tmp_path)).collect()), key=str)
    assert got == tokens_of(library, [d[:2] for d in data])
    empty = T.write_tokens(frame(spark, []), str(tmp_path / "empty"))
    assert T.read_tokens(empty, str(tmp_path / "empty")).count() == 0


@pytest.fixture(scope="module")
def table():
    return U.Unigram.load()


def best_score(table, unit: bytes) -> float:
    """Plain Viterbi over a dictionary."""
    usable = {p.encode(): i for i, p in enumerate(table.pieces)
              if i not in set(table.byte_ids.tolist()) and p not in ("<unk>", "<s>", "</s>")}
    best = [0.0] + [-np.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            part = unit[start:end]
            if part in usable:
                best[end] = max(best[end], best[start] + table.scores[usable[part]])
            try:
                if len(part.decode()) == 1:
                    best[end] = max(best[end], best[start] + len(part) * table.byte_penalty)
            except UnicodeDecodeError:
                pass
    return best[-1]


def test_units_have_the_best_score(table):
    texts = [d["text"] for d in sample()[:40]] + ["\U0001f600東京x", "   a  b ", "ééé\x00"]
    table.encode([t.encode() for t in texts])
    units = random.Random(5).sample([u for u in table.cache if len(u) < 30], 60)
    cost = np.where(np.isin(np.arange(len(table.pieces)), table.byte_ids), table.byte_penalty, table.scores)
    for unit in units:
        assert cost[np.frombuffer(table.cache[unit], "<u4")].sum() == pytest.approx(best_score(table, unit)), unit


def test_double_array_finds_every_word():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"ab\xe2\xff\x00") for _ in range(rng.randint(1, 6))): i for i in range(300)}
    trie = U.DoubleArray(words)
    data = bytes(rng.choice(b"ab\xe2\xff\x00") for _ in range(500))
    start, length, value = trie.matches(np.frombuffer(data, np.uint8), np.full(500, 500))
    got = sorted(zip(start.tolist(), length.tolist(), value.tolist()))
    want = sorted((i, len(w), v) for w, v in words.items() for i in range(500) if data.startswith(w, i))
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_round_trip(text):
    table = U._loaded(U.MODEL, "zipf")
    (ids,) = table.encode([text.encode("utf-8", "replace")])
    assert table.decode(ids) == text.encode("utf-8", "replace").replace("▁".encode(), b" ")


def test_pieces_of_documents(spark):
    got = {r.doc_id: r for r in U.query(spark, SF).collect()}
    for d in sample():
        body = (d["text"] or "").encode()
        assert (got[d["doc_id"]].text_crc32, got[d["doc_id"]].text_length) == (zlib.crc32(body), len(body))
        assert got[d["doc_id"]].n_pieces == len(got[d["doc_id"]].piece_ids)


def test_pieces_edges(spark):
    got = U.decode(U.encode(frame(spark))).collect()
    assert sorted(got, key=str) == sorted(U.round_trip(frame(spark)).collect(), key=str)
    want = sorted((r[0], zlib.crc32((r[1] or "").replace("▁", " ").encode())) for r in rows() if r[0] is not None)
    assert sorted((r.doc_id, r.text_crc32) for r in got if r.doc_id is not None) == want
    assert U.decode(U.encode(frame(spark, []))).count() == 0


def test_decoded_texts_are_returned(spark):
    """The texts themselves, from both paths and from the pipeline's last stage."""
    import corpus_pipeline as C
    want = sorted(((r[0], (r[1] or "").replace("▁", " ")) for r in rows()), key=str)
    for decoded in (U.round_trip(frame(spark)), U.decode(U.encode(frame(spark))), C.pieces(spark, frame(spark), SF)):
        assert dict(decoded.dtypes)["text"] == "string"
        got = decoded.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
        assert all((r.text_crc32, r.text_length) == (zlib.crc32(r.text.encode()), len(r.text.encode())) for r in got)


def test_token_ids_are_returned(spark, library, tmp_path):
    manifest = T.write_tokens(frame(spark), str(tmp_path), block_ids=100)
    got = T.read_ids(manifest, str(tmp_path)).collect()
    sums = [(r.doc_id, r.start, len(r.token_ids), zlib.crc32(np.array(r.token_ids, "<u4").tobytes())) for r in got]
    assert sorted(sums, key=str) == tokens_of(library, [d[:2] for d in rows()])
    empty = T.write_tokens(frame(spark, []), str(tmp_path / "empty"))
    assert T.read_ids(empty, str(tmp_path / "empty")).count() == 0


def test_long_units_are_cut_without_change(monkeypatch):
    """Windows, cut borders and slices of any size give the pieces of whole units."""
    rng, table = random.Random(3), U.Unigram.load()
    alphabet = "abcdefghij klmnopéü東京都の天気予報▁  .,0123"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))).encode() for _ in range(120)]
    texts += [b"a" * 300, b"the" * 100, "天気予報説明".encode() * 30, b" " * 50, b"  a  b " * 20, "▁ ▁x ".encode() * 30, b""]
    want = table.encode(texts)
    for long, window, part in ((8, 16, 20), (3, 64, 7), (40, 32, 100), (1, 100, 1 << 20)):
        monkeypatch.setattr(U, "LONG_UNIT", long)
        monkeypatch.setattr(U, "WINDOW", window)
        monkeypatch.setattr(U, "SLICE", part)
        table.cache.clear()
        assert all(np.array_equal(a, b) for a, b in zip(want, table.encode(texts)))
    monkeypatch.setattr(U, "CACHE_BYTES", 2000)
    assert all(np.array_equal(a, b) for a, b in zip(want, table.encode(texts))) and table.cached <= 2000


LONG_TEXTS = """
import base64, random, resource, sys, time
from vitrine.llm import token_output as T, unigram_pieces as U
rng, table, began = random.Random(1), U.Unigram.load(), time.monotonic()
size = 3_000_000
texts = {"base64": base64.b64encode(rng.randbytes(size)), "han": "".join(chr(rng.randrange(0x4e00, 0x9000)) for _ in range(size // 3)).encode(),
         "one letter": b"a" * size, "lines": b"\\n".join(b"%030d" % rng.randrange(10**30) for _ in range(size // 31))}
for text in texts.values():
    assert table.decode(table.encode([text])[0]) == text
assert table.cached <= U.CACHE_BYTES
pieces = T.Pieces(T.TOKENIZER, 4 << 20)
for _ in range(4):      # many distinct long lines, and many distinct words
    pieces.encode(b"\\n".join(b"x%0200d" % rng.randrange(10**30) for _ in range(2000)))
    pieces.encode(b" ".join(b"w%d" % rng.randrange(10**9) for _ in range(20_000)))
assert pieces.held <= 4 << 20 and max(map(len, pieces)) <= T.LONG_PIECE
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10, time.monotonic() - began)
"""


def test_long_texts_need_bounded_memory():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", LONG_TEXTS], cwd=root, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    mb, seconds = map(float, out.stdout.split())
    assert mb < 600 and seconds < 120
