"""Secret scan with linking of multipart credentials.

Strong kinds (assigned secrets, access identifiers, long hex) are reported by themselves. Weak
kinds mean little alone: a 40-character key, a user name, an endpoint. An interval join inside each
text finds what stands near them, and a weak part is reported only where its complement
co-occurs within ``scope`` characters: a key with an identifier or an endpoint, a user
with a secret, an endpoint with both an identifier and a secret.

Patterns run as built-in expressions on whole texts; only the lengths of matches and of the gaps
before them are kept. Prefix sums give positions, in code points. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import stored

# Kind, pattern, group whose length counts (0: the whole match), least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("key", r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])", 0, 40),
    ("user", r"""(?i)(?<![a-z0-9_])(?:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 3),
    ("endpoint", r"""(?<=[a-z0-9]{2})://[A-Za-z0-9._-]+(?::[0-9]+)?""", 0, 6),
]
BASE = ("assign", "access", "hex")
IDENTIFIERS = ("access", "user")
SECRETS = ("assign", "key", "hex")


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(gap before, length, length of the group) of every match, or null without one."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # both lists have one entry per match; split has a last gap more
    return F.when(F.regexp_like(text, F.lit(pattern)), F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), found,
                   lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        inner, lambda a, g: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), F.length(g).alias("inner")),
    ))


def strong_and_weak(rows: DataFrame) -> DataFrame:
    """Spans (row, kind number, start, end) of stored matches, weak ones included."""
    listed = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(least).alias("least"), F.col(name).alias("found"))
        for k, (name, _, _, least) in enumerate(KINDS)
    ])
    order = Window.partitionBy("row", "kind").orderBy("i")
    return (
        rows.select("row", F.explode(F.filter(listed, lambda x: x["found"].isNotNull())).alias("x"))
        .select("row", "x.kind", "x.least", F.posexplode("x.found").alias("i", "m"))
        .withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(order))
        .filter(F.col("m.inner") >= F.col("least"))
        .select("row", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")
    )


def _numbers(kinds) -> list[int]:
    return [k for k, one in enumerate(KINDS) if one[0] in kinds]


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans whose complement lies within ``scope`` characters.

    The interval join is an equi-join on stretches of ``scope`` characters: a span is filed under
    every stretch that it touches, a weak one looks into those that its neighbourhood
    touches. What one stretch can hold is bounded, as matches of a kind don't overlap.
    """
    weak = spans.filter(~F.col("kind").isin(_numbers(BASE))).select(
        "row", F.col("kind").alias("weak"), F.col("start").alias("a"), F.col("end").alias("b"),
        F.explode(F.expr(f"sequence((greatest(start - {scope}, 0)) div {scope}, (end + {scope}) div {scope})")).alias("bin"),
    )
    filed = spans.select(
        "row", "kind", "start", "end", F.explode(F.expr(f"sequence(start div {scope}, end div {scope})")).alias("bin")
    )
    near = (
        (F.col("start") <= F.col("b") + scope) & (F.col("end") >= F.col("a") - scope)
        & ~((F.col("kind") == F.col("weak")) & (F.col("start") == F.col("a")))
    )
    identifier, secret, endpoint = (
        F.coalesce(F.bool_or(F.col("kind").isin(_numbers(kinds))), F.lit(False))
        for kinds in (IDENTIFIERS, SECRETS, ("endpoint",))
    )
    key, user, end = (_numbers((name,))[0] for name in ("key", "user", "endpoint"))
    return (
        weak.join(filed, ["row", "bin"]).filter(near).groupBy("row", "weak", "a", "b")
        .agg(identifier.alias("identifier"), secret.alias("secret"), endpoint.alias("endpoint"))
        .filter(
            ((F.col("weak") == key) & (F.col("identifier") | F.col("endpoint")))
            | ((F.col("weak") == user) & F.col("secret"))
            | ((F.col("weak") == end) & F.col("identifier") & F.col("secret"))
        )
        .select("row", F.col("weak").alias("kind"), F.col("a").alias("start"), F.col("b").alias("end"))
    )


def _matched(docs: DataFrame, text_col: str, **kept: Column) -> DataFrame:
    """``kept`` columns, a row number and the matches of every kind, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stored(docs.select(
        *[c.alias(name) for name, c in kept.items()], F.monotonically_increasing_id().alias("row"),
        *[_matches(text, pattern, group).alias(name) for name, pattern, group, _ in KINDS],
    ), "secrets")


def reported(rows: DataFrame, scope: int) -> DataFrame:
    """Strong spans and linked weak ones."""
    spans = strong_and_weak(rows)
    return spans.filter(F.col("kind").isin(_numbers(BASE))).union(linked(spans, scope))


def without_secrets(docs: DataFrame, *, text_col: str = "text", scope: int = 200) -> DataFrame:
    """The rows of ``docs`` without a reported span, with all their columns.

    Rows without any match go straight through; only the others meet the join.
    """
    rows = _matched(docs, text_col, doc=F.struct(*[F.col(c) for c in docs.columns]))
    some = F.coalesce(*[F.col(name) for name, *_ in KINDS]).isNotNull()
    weak = rows.filter(some).join(reported(rows, scope).select("row").distinct(), "row", "left_anti")
    return rows.filter(~some).select("doc.*").union(weak.select("doc.*"))


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200,
) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists all reported spans as kind:start:end, by start, then kind as listed, then end,
    joined by commas; base_sha256 is the digest of the same list of strong kinds alone. Without a
    span both are those of empty text; so it is for a null or empty text. Null ids, repeated rows
    and ids stay as they are; other columns are left out. An empty table gives no rows.
    """
    rows = _matched(docs, text_col, doc_id=F.col(id_col))
    names = F.array(*[F.lit(name) for name, *_ in KINDS])
    listed = reported(rows, scope).groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in _numbers(BASE)],
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("list"),
    )

    def text_of(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    strong = F.filter("list", lambda s: s["kind"].isin(_numbers(BASE)))
    return rows.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{name}"), F.lit(0)).cast("long").alias(f"n_{name}") for name in BASE],
        F.sha2(F.coalesce(text_of(strong), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(text_of(F.col("list")), F.lit("")).alias("spans"),
    )
