"""Allow and block rules over URLs, matched by hashed host-suffix and path-prefix expressions.

A URL is expanded into host suffixes (``a.b.c``, ``b.c``, ``c``) times directory
prefixes of its path (none, ``/``, ``/x/``, ...). Expressions meet rules in an equi-join on
the first 32 bits of their digest; the full digest and the rest of the rule's path confirm
a match, and the longest rule decides.

Only as many labels and path levels are expanded as some rule has, which loses no match. The
shuffle side of the join is one row of a few hashes per expression. The rules are broadcast
only where Spark knows that they are small; otherwise both sides are dealt by the hash, and
adaptive execution splits an expression that very many URLs share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.text import lower_ascii, once

PREFIX_DIGITS = 8
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://`` or null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(rule, action)`` with their host, path, expression and digest.

    A rule is ``host/path``; without a slash it fits every path. Null rules or actions and
    rules without a host are left out, since they fit nothing; repeated rules count once,
    and of two actions for one rule the later in the alphabet (block) holds.
    """
    rule = F.col("rule")
    own_host = lower_ascii(F.substring_index(rule, "/", 1))
    own_path = F.expr("substring(rule, char_length(substring_index(rule, '/', 1)) + 1)")
    return (
        rules.groupBy("rule").agg(F.max("action").alias("action"))
        .filter(rule.isNotNull() & F.col("action").isNotNull() & (own_host != ""))
        .select("rule", "action", own_host.alias("rule_host"), own_path.alias("rule_path"))
        .withColumn("directory", F.regexp_extract("rule_path", "(?s)^.*/", 0))
        .withColumn("digest", _digest(F.concat("rule_host", "directory")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def _suffixes(host: Column, most: int) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )


def _directories(path: Column, most: int) -> Column:
    """Empty, ``/``, ``/x/``, ...: at most ``most`` slashes."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))
        ),
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null where none fits), verdict.

    Rows with a null id, repeated rows and repeated ids stay as they are. A null or empty URL,
    or one without ``://``, has an empty host and path and gets ``default``. Other columns of
    ``pages`` are left out, whatever their names. An empty table of pages or rules gives no row
    or ``default`` for each. A tie in length goes to the longer host, then to the later rule
    in order of text.
    """
    prepared = prepare_rules(rules)
    most = prepared.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("directory", "/")) - 1).alias("levels"),
    ).first()
    rows = pages.select(
        F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"),
        path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"),
    )
    if most["labels"] is None:
        return rows.select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
            F.lit(default).alias("verdict"),
        )
    pairs = F.flatten(F.transform(
        _suffixes(F.col("host"), most["labels"]),
        lambda s: F.transform(
            _directories(F.col("path"), most["levels"]), lambda d: F.concat(s, d)
        ),
    ))
    expressions = (
        rows.select("*", F.explode(pairs).alias("expression"))
        .select("row", "page_id", "host", "path", once(_digest(F.col("expression"))).alias("url_digest"))
        .withColumn("url_prefix", F.substring("url_digest", 1, PREFIX_DIGITS))
    )
    matched = expressions.join(
        prepared,
        (F.col("url_prefix") == F.col("prefix")) & (F.col("url_digest") == F.col("digest"))
        & F.startswith(F.col("path"), F.col("rule_path")),
        "left",
    )
    rank = F.when(F.col("rule").isNotNull(), F.struct(
        F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), "rule", "action",
    ))
    return (
        matched.groupBy("row")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"),
             F.first("path").alias("path"), F.max(rank).alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
    )
