"""File sources and sinks: CSV, Parquet, vector tables, picture files.

Reads always name their schema; nothing is inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import materialize

CORRUPT = "_corrupt_record"

# The dialect of a pandas CSV export. Quotes inside a quoted
# field are doubled, a field may hold line ends, blanks belong to the field.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    """CSV with header lines, typed by ``schema``; columns are taken by name.

    Each file's header decides which field is which, so columns may stand in any
    order, also in another one in each file (files of equal headers are read
    together); a column that a file lacks is null. An empty field is null, a
    quoted empty one is the empty string. A value its type can't hold makes
    that field null; with ``corrupt`` the row's text then stands in
    ``_corrupt_record`` (null for sound rows), so that such rows can be set
    aside. Files with line ends in fields are not split over tasks: many files
    are read in parallel, one file by one task.
    """
    files = spark.read.text(path).inputFiles()      # a listing: no file is read
    groups: dict[str, list[str]] = {}
    for file in files if len(files) > 1 else ():
        header = _header(spark, file)
        if header is not None:      # else the file is empty
            groups.setdefault(header, []).append(file)
    if len(groups) <= 1:
        return _read_alike(spark, path, schema, corrupt)
    parts = [_read_alike(spark, alike, schema, corrupt) for alike in groups.values()]
    return reduce(DataFrame.unionByName, parts)


def _header(spark: SparkSession, file: str) -> str | None:
    """The header of a CSV file as it stands there (a quoted name may hold line ends)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        if codec is not None:
            stream = codec.createInputStream(stream)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        header = lines.readLine()
        while header is not None and header.count('"') % 2:
            more = lines.readLine()
            if more is None:
                break
            header += "\n" + more
        return header
    finally:
        stream.close()


def _read_alike(spark: SparkSession, path: str | list[str], schema: T.StructType, corrupt: bool) -> DataFrame:
    """CSV files that all have the header of the first."""
    reader = spark.read.options(**CSV_DIALECT).option("emptyValue", "").option("nullValue", None)
    # Only the header is read here, and no type is inferred: the names by place.
    names = reader.option("inferSchema", "false").csv(path).columns
    by_name = {f.name: f for f in schema.fields}
    placed = [by_name.get(n, T.StructField(n, T.StringType())) for n in names]
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in placed] + [T.StructField(CORRUPT, T.StringType())])
    rows = (reader.option("mode", "PERMISSIVE").option("enforceSchema", "true")
            .option("columnNameOfCorruptRecord", CORRUPT).schema(shape).csv(path))
    cols = [F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*cols, *([CORRUPT] if corrupt else []))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line, replacing what is there; reads back as it was
    (null: an empty field, empty string: two quotes)."""
    (df.write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue='""',
                                        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path))


def read_interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Interaction log from CSV files with the columns user_id, product_id,
    interaction_type and timestamp (text, parsed to a time without zone; a
    text that is no time gives null)."""
    raw = read_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in
                                              ("user_id", "product_id", "interaction_type", "timestamp")]))
    return raw.select("user_id", "product_id", "interaction_type", F.col("timestamp").try_cast("timestamp_ntz").alias("ts"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_picture_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Picture files as rows (path, modificationTime, length, content)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(folder))


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """Adds consecutive row numbers from 0, as a data frame's index counts them: the order of the partitions, then of
    their rows. Partition counts are summed up to a first number for each partition; the rows are written once, so both
    passes see the same partitions, and none of them is moved."""
    part, place = f"{name}__part", f"{name}__place"
    rows = materialize(df.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "row-index")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))      # a row for each partition
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(part), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # The number that Spark gives: the partition in the upper bits, the row below them.
    row = F.col(place) - F.shiftleft(F.col(part).cast("long"), 33)
    return rows.join(first, part).withColumn(name, F.col("first") + row).drop(part, place, "first")


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select ``schema``'s columns in order; an absent column takes its
    default (``defaults[name]`` or null), and ``product_id`` when absent is
    the row's number (``with_row_index``)."""
    defaults = defaults or {}
    if "product_id" in schema.names and "product_id" not in df.columns:
        df = with_row_index(df, "product_id")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
