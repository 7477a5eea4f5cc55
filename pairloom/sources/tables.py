"""CSV, JSON lines, JSON documents, parquet, split and batch folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import dropped, shuffles_end, stored

# JSON documents are gathered in so many turns
TURNS = 4
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header, quoted text with newlines. A quoted multi-line file is one task, so
    keep a large table in many files, or convert it to parquet once."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine="true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Null fields are written, not dropped."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file holds one JSON array (or object); a file is one task."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json_documents(
    df: DataFrame, path: str, key: str, records: int = 1000, shard: str = "shard", compression: str = "none"
) -> None:
    """Records as JSON arrays, one array per file, about ``records`` in each.

    Shards are hashed from a unique key, so none can grow with the data. Rows meet by shard
    before they are collected: with many shards, lists begun on the way there would be sorted and spilled.
    The rows are worked out once and written; then a part of the shards after the other is gathered, so that
    shuffle files of the joins before, or of all shards, never lie beside the documents.
    """
    spark = df.sparkSession
    # a column of nulls alone has no type that a table could hold
    df = stored(df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"}), "records", lean=True)
    with shuffles_end(spark):
        shards = max(1, -(-df.count() // records))
    columns = [F.col(c) for c in df.columns]
    document = F.to_json(F.collect_list("record"), {"ignoreNullFields": "false"})
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias(shard), F.struct(*columns).alias("record"))
    for turn in range(turns := min(TURNS, shards)):
        with shuffles_end(spark):
            (
                rows.filter(F.pmod(shard, F.lit(turns)) == turn)
                .repartition(shard).groupBy(shard).agg(document.alias("value"))
                .write.mode("append" if turn else "error").option("compression", compression).partitionBy(shard).text(path)
            )
    dropped(df)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row frame of nested values as one JSON record."""
    report.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_splits(df: DataFrame, path: str, form: str = "parquet", split: str = "split") -> None:
    """One folder per split value, as parquet or JSON lines."""
    if form not in ("parquet", "json"):
        raise ValueError(f"unknown form: {form}")
    writer = df.write.partitionBy(split)
    if form == "json":
        writer = writer.option("ignoreNullFields", "false")
    getattr(writer, form)(path)


def sample_record(df: DataFrame, order: str, split: str = "train") -> DataFrame:
    """The first record of a split."""
    return df.filter(F.col("split") == split).orderBy(order).limit(1)


def write_batches(requests: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Request lines in one folder per batch.

    Rows meet by batch before the write, so a batch is one file and the number of
    open files per task stays small. A batch is bounded by the batch size.
    """
    (
        requests.repartition(batch)
        .sortWithinPartitions(batch)
        .write.partitionBy(batch)
        .option("ignoreNullFields", "false")
        .json(path)
    )
