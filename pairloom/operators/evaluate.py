"""Metrics of predictions against references, as long ``(section, metric, value)`` rows.

Every metric is a narrow per-row score followed by one global aggregate; token lists
never cross a shuffle. ``evaluate`` takes all of them from a single pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.fixed_values import BLEU_MAX_ORDER, OVERLAP_STOP_WORDS
from pairloom.functions.scores import (
    bleu_tokens, cosine, f_measure, lcs_length, ngram_matches, rouge_tokens,
)
from pairloom.functions.stem import stem_tokens
from pairloom.functions.text import concat_text, keyword_overlap, keyword_overlaps

ROUGE_PARTS = ("precision", "recall", "fmeasure")


def _rouge_tokens(c: str, stemmed: bool) -> Column:
    found = rouge_tokens(F.col(c))
    return stem_tokens(found) if stemmed else found


def rouge_scores(
    df: DataFrame,
    prediction: str,
    reference: str,
    keep: tuple[str, ...] = (),
    orders: Iterable[int] = (1, 2),
    longest: bool = True,
    stemmed: bool = True,
) -> DataFrame:
    """Per row ``rouge1_precision`` ... ``rougeL_fmeasure``.

    Tokens are native. Stemming, n-gram matches and the LCS run as Arrow functions on token
    lists inside the same rows.
    """
    orders = list(orders)
    rows = df.select(
        *keep, _rouge_tokens(prediction, stemmed).alias("p"), _rouge_tokens(reference, stemmed).alias("r")
    )
    names, p, r = [f"rouge{n}" for n in orders], F.col("p"), F.col("r")
    counts = []
    if orders:
        counts.append(ngram_matches(p, r, max(orders)).alias("matches"))
    if longest:
        names.append("rougeL")
        counts.append(lcs_length(p, r).alias("common"))
    rows = rows.select("*", *counts)
    scores = [f_measure(F.get("matches", F.lit(n - 1)), _grams(p, n), _grams(r, n)) for n in orders]
    if longest:
        scores.append(f_measure(F.col("common"), F.size(p), F.size(r)))
    scored = rows.select(
        *keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip(names, scores)])))
    )
    return scored.select(
        *keep, *[F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in names for part in ROUGE_PARTS]
    )


def _grams(tokens: Column, n: int) -> Column:
    """How many n-grams a token list has."""
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def mean_rouge(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(c) for c in scores.columns if c.startswith("rouge")])


def bleu_counts(
    df: DataFrame, prediction: str, reference: str, max_order: int = BLEU_MAX_ORDER
) -> DataFrame:
    """One row: corpus lengths, clipped matches and n-gram totals for each order."""
    tokens = F.struct(
        bleu_tokens(F.col(prediction)).alias("p"), bleu_tokens(F.col(reference)).alias("r")
    )
    p, r = F.col("p"), F.col("r")
    # as a generator: worked out once, whatever uses it
    rows = df.select(F.inline(F.array(tokens))).select("p", "r", ngram_matches(p, r, max_order).alias("matches"))
    parts = _bleu_parts(p, r, lambda n: F.get("matches", F.lit(n - 1)), max_order)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in parts.items()])


def _bleu_parts(
    p: Column, r: Column, match: Callable[[int], Column], max_order: int
) -> dict[str, Column]:
    """Row lengths, clipped matches and n-gram totals of two token lists."""
    orders = range(1, max_order + 1)
    return {
        "sys_len": F.size(p), "ref_len": F.size(r),
        **{f"match_{n}": match(n) for n in orders},
        **{f"total_{n}": _grams(p, n) for n in orders},
    }


def _bleu_values(count: Callable[[str], Column], max_order: int) -> dict[str, Column]:
    """Score and precisions in percent from named counts: geometric mean, brevity
    penalty, each order without a match halving the share given to it."""
    orders = range(1, max_order + 1)
    precisions: list[Column] = []
    halvings = F.lit(0)
    for n in orders:
        match, total = count(f"match_{n}"), count(f"total_{n}")
        halvings = halvings + F.when((match == 0) & (total > 0), 1).otherwise(0)
        precisions.append(
            F.when(total == 0, F.lit(0.0))
            .when(match == 0, F.lit(100.0) / (F.pow(F.lit(2.0), halvings) * total))
            .otherwise(F.lit(100.0) * match / total)
        )
    made, wanted = count("sys_len"), count("ref_len")
    penalty = F.when(
        made < wanted, F.when(made > 0, F.exp(1 - wanted / made)).otherwise(0.0)
    ).otherwise(1.0)
    any_match = reduce(lambda a, b: a | b, [count(f"match_{n}") > 0 for n in orders])
    logs = reduce(
        lambda a, b: a + b,
        [F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0)) for p in precisions],
    )
    return {
        "bleu": F.when(any_match, penalty * F.exp(logs / max_order)).otherwise(0.0),
        **{
            f"bleu_precision_{n}": F.when(any_match, p).otherwise(0.0)
            for n, p in zip(orders, precisions)
        },
    }


def bleu(counts: DataFrame, max_order: int = BLEU_MAX_ORDER) -> DataFrame:
    """``bleu`` and ``bleu_precision_n`` from the counts."""
    return counts.select(*[c.alias(n) for n, c in _bleu_values(F.col, max_order).items()])


def semantic_similarity(df: DataFrame, left: str, right: str) -> DataFrame:
    """Row-wise cosine of two vector columns; mean and population deviation."""
    return df.select(cosine(F.col(left), F.col(right)).alias("s")).agg(
        F.avg("s").alias("semantic_similarity_mean"), F.stddev_pop("s").alias("semantic_similarity_std")
    )


def length_stats(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.length(text).alias("n")).agg(
        F.avg("n").alias("length_mean"), F.stddev_pop("n").alias("length_std"),
        F.min("n").alias("length_min"), F.max("n").alias("length_max"),
    )


def target_text(title: str = "job_title", description: str = "job_description") -> Column:
    return concat_text(F.col(title), F.col(description))


def overlap_stats(
    df: DataFrame, prediction: str, target: Column,
    stop_words: Iterable[str] = OVERLAP_STOP_WORDS, prefix: str = "keyword_overlap",
) -> DataFrame:
    """Mean and population deviation of the overlap; rows without target words stay out."""
    overlap = keyword_overlap(F.coalesce(prediction, F.lit("")), target, stop_words)
    # one element per row, so the overlap is worked out once for both aggregates
    return df.select(F.explode(F.array(overlap)).alias("o")).agg(
        F.avg("o").alias(f"{prefix}_mean"), F.stddev_pop("o").alias(f"{prefix}_std")
    )


def perplexity(df: DataFrame, loss: str = "loss", tokens: str = "num_tokens") -> DataFrame:
    """exp of the token-weighted mean loss."""
    mean = F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens).cast("double"))
    return df.agg(F.exp(mean).alias("perplexity"))


def has_ground_truth(df: DataFrame, reference: str = "ground_truth_resume") -> DataFrame:
    return df.agg(
        F.coalesce(F.bool_or(F.coalesce(reference, F.lit("")) != ""), F.lit(False)).alias("has_ground_truth")
    )


def as_metrics(row: DataFrame, section: str) -> DataFrame:
    """A one-row frame of named numbers as ``(section, metric, value)`` rows."""
    entries = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns
    ]
    return row.select(F.lit(section).alias("section"), F.inline(F.array(*entries)))


SIDES = (
    ("resume", "tailored_resume", "ground_truth_resume"),
    ("cover_letter", "cover_letter", "ground_truth_cover_letter"),
)


def evaluate(
    results: DataFrame, vectors: dict[str, tuple[str, str]] | None = None, stemmed: bool = True
) -> DataFrame:
    """All metrics of a result table, from one scan and one aggregate.

    ROUGE, BLEU and vector similarity count only if some resume reference is there; that is looked up first, and
    without one they are not worked out.
    ``vectors`` names, per side, the two vector columns. Keyword overlap is given
    against title plus description and, as ``title_overlap``, against the title alone.
    """
    vectors = vectors or {}
    prediction, truth = SIDES[0][1:]
    gate = not results.filter(F.coalesce(truth, F.lit("")) != "").select(F.lit(1)).limit(1).isEmpty()
    tokens, counts, scores = [], [], []
    # (section, metric, aggregate of a score column)
    metrics: list[tuple[str, str, Column]] = []

    def add_lengths(side: str, made: str) -> None:
        nonlocal metrics
        tokens.append(F.length(made).alias(f"{side}_length"))
        scores.append(F.col(f"{side}_length"))
        metrics += _spread_metrics(f"length_stats_{side}", "length", f"{side}_length")
        metrics += [
            (f"length_stats_{side}", f"length_{name}", f(f"{side}_length"))
            for name, f in (("min", F.min), ("max", F.max))
        ]

    for side, made, reference in SIDES:
        if not gate:
            add_lengths(side, made)
            continue
        tokens += [
            _rouge_tokens(made, stemmed).alias(f"{side}_p"), _rouge_tokens(reference, stemmed).alias(f"{side}_r"),
            # columns, not one struct, which the optimizer would work out again for every use of a field
            bleu_tokens(F.col(made)).alias(f"{side}_bleu_p"), bleu_tokens(F.col(reference)).alias(f"{side}_bleu_r"),
        ]
        p, r = F.col(f"{side}_p"), F.col(f"{side}_r")
        counts += [
            lcs_length(p, r).alias(f"{side}_common"), ngram_matches(p, r, 2).alias(f"{side}_rouge_matches"),
        ]
        rouge = {
            f"rouge{n}": f_measure(F.get(f"{side}_rouge_matches", F.lit(n - 1)), _grams(p, n), _grams(r, n))
            for n in (1, 2)
        }
        rouge["rougeL"] = f_measure(F.col(f"{side}_common"), F.size(p), F.size(r))
        scores += [c.alias(f"{side}_{name}") for name, c in rouge.items()]
        metrics += [
            (f"rouge_{side}", f"{name}_{part}", F.avg(f"{side}_{name}.{part}"))
            for name in rouge for part in ROUGE_PARTS
        ]
        p, r = F.col(f"{side}_bleu_p"), F.col(f"{side}_bleu_r")
        counts.append(ngram_matches(p, r, BLEU_MAX_ORDER).alias(f"{side}_bleu_matches"))
        parts = _bleu_parts(
            p, r, lambda n, side=side: F.get(f"{side}_bleu_matches", F.lit(n - 1)), BLEU_MAX_ORDER
        )
        scores += [c.alias(f"{side}_{name}") for name, c in parts.items()]

        def total(name: str, side: str = side) -> Column:
            return F.coalesce(F.sum(f"{side}_{name}"), F.lit(0))

        metrics += [
            (f"bleu_{side}", name, c) for name, c in _bleu_values(total, BLEU_MAX_ORDER).items()
        ]
        add_lengths(side, made)
        if side in vectors:
            tokens.append(cosine(*[F.col(v) for v in vectors[side]]).alias(f"{side}_cosine"))
            scores.append(F.col(f"{side}_cosine"))
            metrics += _spread_metrics(
                f"semantic_similarity_{side.split('_')[0]}", "semantic_similarity", f"{side}_cosine"
            )
    targets = {"keyword_overlap": target_text(), "title_overlap": concat_text(F.col("job_title"))}
    overlaps = keyword_overlaps(F.coalesce(prediction, F.lit("")), targets.values(), OVERLAP_STOP_WORDS)
    tokens.append(overlaps.alias("overlaps"))
    for i, name in enumerate(targets):
        scores.append(F.get("overlaps", F.lit(i)).alias(name))
        metrics += _spread_metrics("keyword_overlap", name, name)

    rows = results.select(*tokens)
    if gate:
        rows = rows.select("*", *counts)
    rows = rows.select(F.inline(F.array(F.struct(*scores))))
    one = rows.agg(*[c.cast("double").alias(f"m{i}") for i, (_, _, c) in enumerate(metrics)])
    entries = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(f"m{i}").alias("value"))
        for i, (section, metric, _) in enumerate(metrics)
    ])
    return one.select(F.inline(entries))


def _spread_metrics(section: str, prefix: str, column: str) -> list:
    """Mean and population deviation of a score column."""
    return [
        (section, f"{prefix}_mean", F.avg(column)),
        (section, f"{prefix}_std", F.stddev_pop(column)),
    ]


def compare(tuned: DataFrame, baseline: DataFrame, section: str = "rouge_resume") -> DataFrame:
    """Both values and the improvement in percent for each F measure; 0 if the baseline is 0."""

    def side(metrics: DataFrame, name: str) -> DataFrame:
        wanted = (F.col("section") == section) & F.col("metric").contains("fmeasure")
        return metrics.filter(wanted).select("metric", F.col("value").alias(name))

    a, b = F.col("fine_tuned"), F.col("baseline")
    return (
        side(tuned, "fine_tuned").join(side(baseline, "baseline"), "metric")
        .withColumn("improvement", F.when(b > 0, (a - b) / b * 100).otherwise(0.0))
    )


def comparison_report(tuned: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two runs and their improvements as one nested record."""
    improvements = compare(tuned, baseline).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "improvement")))).alias("i")
    )
    return metrics_report(tuned).select(
        F.col("metrics").alias("fine_tuned"), metrics_report(baseline).scalar().alias("baseline"),
        improvements.scalar().alias("improvements"),
    )


def metrics_report(metrics: DataFrame) -> DataFrame:
    """Metric rows as one nested record ``{section: {metric: value}}``, a few dozen numbers."""
    inner = metrics.groupBy("section").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    return inner.agg(
        F.map_from_entries(F.collect_list(F.struct("section", "metrics"))).alias("metrics")
    )
