"""From enriched pairs and model responses to training records on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.fixed_values import BATCH_SIZE, SEED, SPLIT_RATIOS
from pairloom.operators import generate, quality
from pairloom.operators.prepare import training_records
from pairloom.operators.rank import split_exact
from pairloom.session import stored
from pairloom.sources import tables


def write_requests(
    pairs: DataFrame, full_pairs: DataFrame, path: str, done: DataFrame | None = None,
    batch_size: int = BATCH_SIZE,
) -> None:
    """Number the narrow pair table, drop finished batches, attach texts, write batches."""
    batched = generate.assign_batches(
        pairs.select("resume_id", "job_id"), ["resume_id", "job_id"], batch_size
    )
    if done is not None:
        batched = generate.pending(batched, done)
    ready = full_pairs.join(batched, ["resume_id", "job_id"])
    tables.write_batches(generate.requests(ready, keep=("batch_id",)), path)


def curate(
    examples: DataFrame, order: str, valid_path: str, report_path: str
) -> DataFrame:
    """Label once, store, then write the valid rows and the report from the stored labels."""
    labelled = stored(quality.labelled(examples), "labelled")
    tables.write_jsonl(quality.valid(labelled), valid_path)
    tables.write_report(quality.report(labelled, order), report_path)
    return quality.valid(labelled)


def prepare(
    examples: DataFrame, path: str, form: str = "instruction", store: str = "json",
    ratios: tuple[float, float, float] = SPLIT_RATIOS, seed: int = SEED,
) -> DataFrame:
    """Split by pair, format, write one folder per split."""
    split = split_exact(examples, ["resume_id", "job_id"], ratios, seed)
    records = training_records(split, form, keep=("split",))
    tables.write_splits(records, path, store)
    return records
