"""Incremental ingest of response files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.generate import generated, judged, keyed_pairs, parse_lines
from pairloom.session import stored


def response_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Responses from JSON line files, with a ``place`` of their own.

    A file is read once by the stream's own log. The place is a uuid: its seed is fixed per
    micro-batch and partition and it is drawn straight after the file scan, so a task
    that runs again draws the same ones.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_lines(lines.withColumn("place", F.uuid()), keep=("place",))


def accepted_keys(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Keys accepted by the micro-batches before number ``before``, as stored beside the rows."""
    keys = spark.read.schema("key string, batch bigint").parquet(path)
    return keys.filter(F.col("batch") < before).select("key")


def fresh(good: DataFrame, known: DataFrame) -> DataFrame:
    """Good responses whose key was never accepted, one per key: that of the least place."""
    rows = good.join(known, "key", "left_anti")
    kept = F.min_by(F.struct(*[F.col(c) for c in good.columns]), "place")
    return rows.groupBy(F.col("key").alias("_key")).agg(kept.alias("_kept")).select("_kept.*")


def ingest(
    spark: SparkSession,
    folder: str,
    pairs: DataFrame,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    order: str | None = None,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Read all files present, write accepted and rejected rows, stop.

    The pairs are keyed and written once, before the stream starts; with ``order`` the last pair
    of a repeated key is the one. A micro-batch reads their keys alone, and their texts for
    its accepted rows. The outcome comes first: a key counts as delivered only once a response for it is
    good, so a good retry after a failed one is taken, and every failure is kept. Keys once accepted are a
    table of their own, ``<accepted_path>-keys``, narrow and stored by micro-batch; good responses meet it in an
    anti join, so a redelivery is dropped however late it comes, and the stream itself holds no state.

    Each micro-batch writes to a folder named by its number and looks at the keys of earlier
    ones alone, so a batch run again after a failure replaces its own output and nothing is doubled or
    lost. ``checkpoint`` must be on storage the whole cluster reaches.
    """
    keyed = stored(keyed_pairs(pairs, order), "keyed-pairs")
    keys_path = f"{accepted_path.rstrip('/')}-keys"
    keyed.select("key").limit(0).write.mode("ignore").parquet(f"{keys_path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = F.col("outcome") == "ok"
        try:
            taken = fresh(batch.filter(good), accepted_keys(batch.sparkSession, keys_path, number)).persist()
            try:
                generated(taken.join(keyed, "key")).drop("place").write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
                taken.select("key").write.mode("overwrite").parquet(f"{keys_path}/batch={number}")
            finally:
                taken.unpersist()
            batch.filter(~good).select("key", "outcome").write.mode("overwrite").parquet(
                f"{rejected_path}/batch={number}"
            )
        finally:
            batch.unpersist()

    responses = response_stream(spark, folder, files_per_trigger)
    return (
        judged(responses, keyed.select("key"), keep=("place",))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
