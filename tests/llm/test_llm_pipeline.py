import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from llm_data import SF, frame, rows, sample
from vitrine.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    assert entry.queries()["pipeline"] is C.run
    assert len([n for n in entry.queries() if n.startswith("op")]) == 13


def test_stages_by_brute_force(spark):
    """Each stage on its own input: what it keeps follows from the operator's plain rules."""
    from test_llm_simhash import brute, plain_fingerprint
    from test_llm_sql_operators import plain_lines
    from test_llm_text_scans import words
    from vitrine.llm import line_dedup
    docs, data = None, sample()
    seen = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = seen["language_id"]
    letters = {d["doc_id"] for d in before if any(c.isalpha() for c in d["text"] or "")}
    assert {d["doc_id"] for d in after} <= letters and len(after) >= 0.98 * len(letters)
    before, after = seen["line_dedup"]
    want = plain_lines([tuple(d[c] for c in COLUMNS) for d in before], line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert sorted((d["doc_id"], d["text"]) for d in after) == sorted(want)
    assert all(d["n_chars"] == len(d["text"]) for d in after)
    before, after = seen["simhash_near_dedup"]
    group = brute([(d["doc_id"], plain_fingerprint(d["text"])) for d in before])
    assert sorted(d["doc_id"] for d in after) == sorted(set(group.values()))
    before, after = seen["decontamination"]
    items = [" ".join(words(i["text"])) for i in sample("benchmark")]
    held = {d["doc_id"] for d in before if any(f" {i} " in f" {' '.join(words(d['text']))} " for i in items)}
    assert held and not held & {d["doc_id"] for d in after} and len(after) >= len(before) - 2 * len(held)
    before, after = seen["sentencepiece"]
    text = {d["doc_id"]: d["text"].encode() for d in before}
    assert {d["doc_id"]: (d["text_crc32"], d["text_length"]) for d in after} == {
        i: (zlib.crc32(t), len(t)) for i, t in text.items()}


@pytest.mark.parametrize("data", [rows(), []])
def test_run_on_edge_tables(spark, tmp_path, data):
    df = frame(spark, data)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": pa.array([None, "x"])}),
                   str(tmp_path / "benchmark.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    assert len(got) <= len(data)
    if data:
        assert {3, 4, 5, 10} & {r.doc_id for r in got} == set()


def test_rows_with_null_or_repeated_ids_are_judged_one_by_one(spark, tmp_path):
    """Clean rows stay beside rejected ones of the same id; copies go whatever their ids."""
    import itertools
    import random
    rng = random.Random(3)
    texts = [d["text"] for d in sample() if len((d["text"] or "").split()) > 40][:60]
    item = " ".join(f"leak{rng.randrange(10**6)}" for _ in range(20))
    bench = pa.table({"item_id": pa.array([1, 2, 3], pa.int64()), "text": pa.array([item, "word", "a word"])})
    pq.write_table(bench, str(tmp_path / "benchmark.parquet"))
    clean = iter(texts)
    fixed = [(d["doc_id"] + 1000, d["text"], d["lang"], "a", 1) for d in sample()]
    train = spark.createDataFrame(fixed, "doc_id long, text string, lang string, source string, n_chars long")

    def stage(fn, data):
        df = frame(spark, data).withColumn("row_key", F.lit(0))
        if fn is C.language:
            df = df.unionByName(train.select(*train.columns, *[F.lit("extra").alias(c) for c in df.columns[5:-1]],
                                             F.lit(0).alias("row_key")))
        out = fn(spark, df, str(tmp_path))
        assert out.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in out.collect() if (r.doc_id or 0) < 1000), key=str)

    for one in (None, 7):
        a, b, c = itertools.islice(clean, 3)
        row = lambda text: (one, text, "en", "a", 1)
        gibberish = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
        polish = "Szybki brązowy lis przeskakuje nad leniwym psem a potem idzie do domu i je kolację z przyjaciółmi"
        odd = [(one, t, None, "a", 1) for t in (gibberish, polish)]
        assert stage(C.language, [row(a), row("12 34"), row(None), row(b), *odd]) == sorted([(one, a), (one, b)], key=str)
        assert stage(C.decontaminated, [row(a), row(f"so {item} end"), row(b)]) == sorted([(one, a), (one, b)], key=str)
        assert len(stage(C.decontaminated, [row("a word"), row("here")])) == 2      # items 2 and 3 are too short to tell
        # equal rows, rows that differ in case alone, and another document under the same id
        big = a.encode().upper().decode()
        near = stage(C.near_duplicates, [row(a), row(a), row(big), row(b), row(c)])
        assert len(near) == 3 and {t.lower() for _, t in near} == {a.lower(), b.lower(), c.lower()}
        assert near == stage(C.near_duplicates, [row(c), row(big), row(b), row(a), row(a)])
    a, b = itertools.islice(clean, 2)
    assert stage(C.near_duplicates, [(None, a, "en", "a", 1), (5, a, "en", "a", 1), (3, a, "en", "a", 1),
                                     (None, b, "en", "a", 1)]) == sorted([(3, a), (None, b)], key=str)
