"""Sources and sinks: defaults for absent columns, picture files, the
embedder hooks, CSV/Parquet round trips."""

import os
import tempfile

import numpy as np

from vitrine.operators import embed
from vitrine.schemas import PRODUCTS, RAW_PRODUCTS
from vitrine.sources import files


def test_absent_columns_take_defaults(spark):
    df = spark.createDataFrame([("Lamp", "Home")], "title string, category string")
    out = files.with_defaults(df, PRODUCTS, {"price": 0.0, "title": ""})
    r = out.first()
    assert out.columns == [f.name for f in PRODUCTS.fields]
    assert r.title == "Lamp" and r.price == 0.0 and r.product_id is not None and r.brand is None


def test_picture_files_to_vectors_with_stub_encoder(spark):
    folder = tempfile.mkdtemp(prefix="vitrine-pics-")
    for pid, payload in [("P00001", b"\x01\x02\x03"), ("P00002", b"\x05"), ("P00003", b"bad")]:
        with open(os.path.join(folder, f"{pid}.jpg"), "wb") as fh:
            fh.write(payload)

    def make_encoder():
        def enc(blobs):
            b = blobs[0]
            if b == b"bad":
                raise ValueError("not a picture")
            return np.array([[len(b), sum(b)]], dtype=np.float32)
        return enc

    pics = files.read_picture_files(spark, folder)
    vecs = {r.product_id: r.image_vec for r in embed.image_file_vectors(pics, make_encoder, 2).collect()}
    assert vecs == {"P00001": [3.0, 6.0], "P00002": [1.0, 5.0], "P00003": [0.0, 0.0]}


def test_model_text_vectors_hook(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")

    def make_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = {r.id: r.text_vec for r in embed.model_vectors(df, "text", make_encoder, 2).collect()}
    assert out == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_model_failure_sets_row_aside(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "fine")], "id long, text string")

    def make_encoder():
        def enc(texts):
            if "boom" in texts:
                raise RuntimeError("cannot embed")
            return np.ones((len(texts), 2))
        return enc

    rows = {r.id: (r.text_vec, r.embed_error) for r in
            embed.model_vectors(df.coalesce(1), "text", make_encoder, 2).collect()}
    assert rows[1] == ([1.0, 1.0], None) and rows[3] == ([1.0, 1.0], None)
    assert rows[2][0] is None and "cannot embed" in rows[2][1]


def test_csv_round_trip_keeps_rows_and_nulls(spark):
    path = tempfile.mkdtemp(prefix="vitrine-csv-") + "/p"
    rows = [("1", "Lamp", None, "Home", "B", "9.5", None, "3"), ("2", "Desk, big", "d", "Home", None, "NA", "4.5", None)]
    df = spark.createDataFrame(rows, RAW_PRODUCTS)
    files.write_csv(df, path)
    back = files.read_csv(spark, path, RAW_PRODUCTS).orderBy("product_id").collect()
    assert [tuple(r) for r in back] == rows


def test_parquet_keeps_vectors(spark):
    path = tempfile.mkdtemp(prefix="vitrine-pq-") + "/v"
    df = spark.createDataFrame([(1, [0.5, 0.25])], "id long, v array<float>")
    files.write_parquet(df, path)
    assert files.read_parquet(spark, path).first().v == [0.5, 0.25]
    assert dict(files.read_parquet(spark, path).dtypes)["v"] == "array<float>"


def test_encoder_built_once_per_worker(spark):
    """Tasks reuse the encoder their Python worker already built."""
    df = spark.range(400).selectExpr("id", "cast(id as string) as text").repartition(40)

    def make_encoder():
        import os
        import vitrine.operators.embed as e
        e._test_builds = getattr(e, "_test_builds", 0) + 1
        builds = e._test_builds
        return lambda texts: np.array([[os.getpid(), builds]] * len(texts), dtype=np.float64)

    rows = embed.model_vectors(df, "text", make_encoder, 2).select("text_vec").collect()
    per_pid = {}
    for r in rows:
        pid, builds = int(r.text_vec[0]), int(r.text_vec[1])
        per_pid.setdefault(pid, set()).add(builds)
    assert all(b == {1} for b in per_pid.values()), per_pid


def test_outputs_go_under_the_sessions_checkpoint_dir(spark):
    """Writes are placed in the shared folder the session names, not in a
    folder of our choosing."""
    from vitrine.session import local_path, materialize, scratch_path, shared_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured
    base = local_path(shared_dir(spark))
    assert base.startswith(local_path(configured))
    assert local_path(scratch_path(spark, "x")).startswith(base)
    m = materialize(spark.range(3), "probe")
    assert m.count() == 3
    assert all(local_path(f).startswith(base) for f in m.inputFiles())


def test_csv_as_pandas_writes_it(spark, tmp_path):
    """Quotes, line ends and a reordered header of a pandas export; fields a type can't hold are told."""
    import pandas as pd
    from pyspark.sql import types as T
    rows = [('say "hi", lamp', "Home", 1.5), ("two\nlines", "", 2.0), (" blanks ", None, 3.0)]
    pd.DataFrame(rows, columns=["title", "category", "price"])[["price", "category", "title"]].to_csv(
        tmp_path / "p.csv", index=False)
    shape = T.StructType([T.StructField("title", T.StringType()), T.StructField("category", T.StringType()),
                          T.StructField("price", T.DoubleType()), T.StructField("brand", T.StringType())])
    got = sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "p.csv"), shape).collect())
    assert got == sorted([('say "hi", lamp', "Home", 1.5, None), ("two\nlines", got[2][1], 2.0, None),
                          (" blanks ", None, 3.0, None)])
    (tmp_path / "bad.csv").write_text("price,title\n1.0,ok\nx,bad\n")
    rows = files.read_csv(spark, str(tmp_path / "bad.csv"), shape, corrupt=True).collect()
    assert {(r.title, r.price, r._corrupt_record) for r in rows} == {("ok", 1.0, None), ("bad", None, "x,bad")}


def test_interactions_csv(spark, tmp_path):
    (tmp_path / "i.csv").write_text("timestamp,user_id,product_id,interaction_type\n"
                                    "2024-01-02T03:04:05,U00001,P00002,view\nnever,U00002,P00001,click\n")
    rows = files.read_interactions_csv(spark, str(tmp_path / "i.csv")).collect()
    assert sorted((r.user_id, r.product_id, r.interaction_type, str(r.ts)) for r in rows) == [
        ("U00001", "P00002", "view", "2024-01-02 03:04:05"), ("U00002", "P00001", "click", "None")]


def test_pictures_join_the_catalogue_by_text_id(spark, tmp_path):
    """From picture files to combined vectors; an unreadable picture is zeros and told."""
    for pid, payload in [("P00001", b"\x01\x02"), ("P00002", b"bad")]:
        (tmp_path / f"{pid}.jpg").write_bytes(payload)

    def make_encoder():
        def enc(blobs):
            if b"bad" in blobs:
                raise ValueError("not a picture")
            return np.array([[len(b), sum(b)] for b in blobs], dtype=np.float32)
        return enc

    images = embed.image_file_vectors(files.read_picture_files(spark, str(tmp_path)), make_encoder, 2)
    errors = {r.product_id: r.embed_error for r in images.collect()}
    assert errors["P00001"] is None and "not a picture" in errors["P00002"]
    products = spark.createDataFrame([("P00001", "Lamp", "Home"), ("P00002", "Desk", "Home"), ("P00003", "Mat", "Home")],
                                     "product_id string, title string, category string")
    got = {r.product_id: r.vector[-2:] for r in embed.product_vectors(products, images, 2).collect()}
    assert got == {"P00001": [2.0, 3.0], "P00002": [0.0, 0.0], "P00003": [0.0, 0.0]}


def test_null_keys_stay_null_and_long_keys_whole(spark):
    from vitrine.sources import tables
    df = spark.createDataFrame([(1,), (None,), (99_999,), (123_456,), (-1,), (-123_456,), (0,)], "k long")
    got = df.select(tables.product_key(df.k).alias("p"), tables.user_key(df.k).alias("u")).collect()
    assert [r.p for r in got] == ["P00001", None, "P99999", "P123456", "P-0001", "P-123456", "P00000"]
    assert [r.u for r in got] == ["U00001", None, "U99999", "U123456", "U-0001", "U-123456", "U00000"]


def test_null_keys_invent_neither_users_nor_products(spark, tmp_path):
    """Null part, customer and event keys: no user, no product, no join of null with null."""
    from vitrine.operators import analytics, clean, recommend
    from vitrine.plans.registry import QUERIES
    from vitrine.sources import tables
    sf = str(tmp_path)

    def put(name, rows):
        spark.createDataFrame(rows, tables.TABLE_SCHEMAS[name]).write.parquet(f"{sf}/{name}.parquet")
    put("part", [(1, "a", "b", "Home", 1, 2.0), (None, "c", "b", "Home", 1, 2.0)])
    put("orders", [(1, 7, "O", 1.0, None, "x"), (2, None, "O", 1.0, None, "x"), (None, 9, "O", 1.0, None, "x")])
    put("lineitem", [(o, p, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for o, p in ((1, 1), (1, None), (2, 1), (2, None), (None, 1))])
    inter = tables.interactions(spark, sf)
    assert sorted(((r.user_id, r.product_id) for r in inter.collect()), key=str) == [
        ("U00007", "P00001"), ("U00007", None), (None, "P00001"), (None, None)]
    assert [r.user_id for r in analytics.distinct_users(inter).collect()] == ["U00007"]
    products = tables.products(spark, sf)
    assert [r.reason for r in clean.clean_rejects(products).collect()] == ["missing_id"]
    cat = clean.clean_products(products)
    assert [r.product_id for r in cat.collect()] == ["P00001"]
    assert recommend.interactions_enriched(inter, cat).count() == 2 and recommend.orphan_interactions(inter, cat).count() == 2
    assert [tuple(r) for r in QUERIES["orphan_interactions"](spark, sf).collect()] == [(4, 2)]
