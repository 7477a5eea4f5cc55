"""Similarity join on word shingles by groups of documents with one prefix.

1. Every text gets its set of shingles (64-bit hashes), a key of the set, and the set's first elements by
   hash. A set that is linked has at most ``spare`` elements which its partner lacks, so a set with more than
   that among those first elements which no other set has is linked with nothing, and goes.
   Equal sets are one class from here on.
2. Elements of what is left are ordered by the number of classes that hold them, then by hash. A
   class's prefix is its first ``spare + 1`` elements. Two linked classes share an element of both
   prefixes. Elements that one class alone has come first, match nothing, and only count.
3. Classes of the same size with identical prefixes are collapsed into one group. An index from prefix
   elements to groups is all that is joined.
4. Verification on whole sets goes in rounds, so that links are found without forming all pairs: members with
   the first of their group; groups with the least altered group that shares an element and about the
   size; then, for pairs of groups whose members are not all in one component yet, the pairs of members
   across components. Pairs of groups are filtered by size, by what is theirs alone, and by position: the first
   shared element has to stand early in both, and what follows the last one bounds the rest of the intersection.

So every pair that may be linked is verified, ruled out by an exact bound, or already inside one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.batches import map_texts, pieces
from pairloom.llm.neardup import components, set_key, shingle_set
from pairloom.llm.words import SPACED, WordTable
from pairloom.session import stored

SHINGLE, PERCENT = 4, 85
PIECE = 1 << 20


def spare(n, percent: int):
    """How many elements of a set of ``n`` a linked set may lack at most; for columns and arrays too."""
    needed = -(-n * percent // 100) if not isinstance(n, Column) else F.ceil(n * percent / 100).cast("long")
    return n - needed


class Sets:
    """Shingle sets of texts, as sorted hashes."""

    def __init__(self, width: int):
        self.words, self.width = WordTable(SPACED), width

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [shingle_set(self.words.hashes[n], self.width) for n in self.words.texts(texts)]


def _digests(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, n, key (null for an empty set) and the first elements by hash of every row."""
    fields = [T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType()))]

    def make():
        sets = Sets(width)

        def work(texts):
            made = sets(texts)
            return {
                "n": [len(s) for s in made], "key": [set_key(s) if len(s) else None for s in made],
                "first": [s[:2 * spare(len(s), percent) + 1].view(np.int64) for s in made],
            }

        return work

    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col, most=PIECE)


def _alone(elements: DataFrame) -> DataFrame:
    """(no, own): how many elements of a class no other class has, from rows (element, no)."""
    single = elements.groupBy("element").agg(F.min("no").alias("no"), F.max("no").alias("last")).filter("no = last")
    return single.groupBy("no").agg(F.count("*").alias("own"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """no, n and the whole set of the classes ``wanted`` (key, no, id). An id may stand for several texts, so keys
    are worked out again and matched."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = wanted.select("id").distinct()
    near = rows.join(ids, rows["doc_id"].eqNullSafe(ids["id"]), "left_semi")

    def run(batches):
        sets = Sets(width)
        for batch in batches:
            for a, b in pieces(batch.column(0), PIECE):
                made = [s for s in sets([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()]) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in made], pa.binary()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))],
                    names=["key", "elements"])

    keyed = near.select("text").mapInArrow(run, "key binary, elements array<long>")
    return keyed.join(wanted.select("key", "no"), "key").dropDuplicates(["no"]).select(
        "no", F.size("elements").cast("long").alias("n"), "elements")


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    """no, n, own, group (the least no of the group) and prefix (without elements of one class) of the classes
    that may have a link."""
    each = sets.select("no", F.explode("elements").alias("element"))
    held = stored(each.groupBy("element").agg(F.count("*").alias("classes"), F.min("no").alias("no")), "elements")
    own = held.filter("classes = 1").groupBy("no").agg(F.count("*").alias("own"))
    left = sets.join(own, "no", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    left = stored(left.filter(F.col("own") <= spare(F.col("n"), percent)), "linkable")
    listed = left.select("no", F.explode("elements").alias("element")).join(held.filter("classes > 1").select("element", "classes"), "element")
    prefix = F.transform(F.array_sort(F.collect_list(F.struct("classes", "element"))), lambda x: x["element"])
    prefixes = listed.groupBy("no").agg(prefix.alias("prefix")).join(left.select("no", "n", "own"), "no")
    prefixes = stored(prefixes.select(
        "no", "n", "own", F.slice("prefix", F.lit(1), (spare(F.col("n"), percent) + 1 - F.col("own")).cast("int")).alias("prefix")), "prefixes")
    same = ["n", "own", "prefix"]
    groups = stored(prefixes.groupBy(*same).agg(F.min("no").alias("group")), "groups")
    return stored(prefixes.join(groups, same), "members")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that are linked, by their whole sets."""
    shared = F.size(F.array_intersect("u_set", "v_set"))
    return (
        pairs.join(sets.select(F.col("no").alias("u"), F.col("n").alias("u_n"), F.col("elements").alias("u_set")), "u")
        .join(sets.select(F.col("no").alias("v"), F.col("n").alias("v_n"), F.col("elements").alias("v_set")), "v")
        .select("u", "v", "u_n", "v_n", shared.cast("long").alias("shared"))
        .filter(100 * F.col("shared") >= percent * (F.col("u_n") + F.col("v_n") - F.col("shared"))).select("u", "v")
    )


def _may_link(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether two sets of n and m elements that share at most ``shared`` can be linked."""
    return 100 * shared >= percent * (n + m - shared)


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(no, root) of every class with a link, but the roots."""
    groups = members.filter("no = group").select("group", "n", "own", "prefix")
    # size classes so narrow that linked sets are in one or in neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    index = groups.select("group", "n", "own", band.alias("band"), F.posexplode("prefix").alias("at", "element"))
    index = stored(index.withColumn("at", F.col("at") + F.col("own") + 1), "index")

    within = members.filter("no <> group").select(F.col("no").alias("u"), F.col("group").alias("v"))
    rank = F.struct((F.col("own") * 1000 / F.col("n")).cast("int").alias("part"), "group", "n", "own")
    leaders = index.groupBy("element", "band").agg(F.min(rank).alias("lead"), F.count("*").alias("size"))
    lead = leaders.select("element", "band", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("group", "n", "own")])
    most = F.least(F.col("n") - F.col("own"), F.col("lead_n") - F.col("lead_own"))
    led = index.join(lead, ["element", "band"]).filter(
        (F.col("group") != F.col("lead_group")) & _may_link(most, F.col("n"), F.col("lead_n"), percent)
    ).select(F.col("group").alias("u"), F.col("lead_group").alias("v"))
    first = stored(within.union(led).distinct(), "pairs")
    links = stored(_verified(first, sets, percent), "verified")
    found = stored(components(links), "components")

    # pairs of groups that are not in one component as a whole
    labelled = stored(members.select("no", "group", "n", "own").join(found.withColumnRenamed("key", "no"), "no", "left").withColumn(
        "root", F.coalesce("root", "no")), "labelled")
    spans = labelled.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    open_ = index.join(spans, "group")
    mixed = open_.groupBy("element").agg(F.min("a").alias("low"), F.max("b").alias("top")).filter("low < top")
    open_ = stored(open_.join(mixed.select("element"), "element", "left_semi"), "open")
    other = open_.select("element", *[F.col(c).alias(f"o_{c}") for c in ("group", "n", "own", "at", "a", "b")])
    most = F.least(F.col("n") - F.col("own"), F.col("o_n") - F.col("o_own"))
    # two linked sets share so many elements that the first of them stands this early in both
    needed = F.ceil(percent * (F.col("n") + F.col("o_n")) / (100 + percent))
    early = (F.col("at") <= F.col("n") - needed + 1) & (F.col("o_at") <= F.col("o_n") - needed + 1)
    pairs = open_.join(other, "element").filter(
        (F.col("group") >= F.col("o_group")) & ((F.least("a", "o_a") != F.greatest("b", "o_b"))) & early
        & _may_link(most, F.col("n"), F.col("o_n"), percent))
    bound = F.col("common") + F.least(F.col("n") - F.col("last"), F.col("o_n") - F.col("o_last"))
    pairs = pairs.groupBy("group", "o_group", "n", "o_n").agg(
        F.count("*").alias("common"), F.max("at").alias("last"), F.max("o_at").alias("o_last")
    ).filter(_may_link(bound, F.col("n"), F.col("o_n"), percent)).select("group", "o_group")
    # expanded to members across components; a group paired with itself, too
    one = labelled.select("group", F.col("no").alias("u"), F.col("root").alias("u_root"))
    two = labelled.select(F.col("group").alias("o_group"), F.col("no").alias("v"), F.col("root").alias("v_root"))
    expanded = pairs.join(one, "group").join(two, "o_group").filter(
        (F.col("u_root") != F.col("v_root")) & ((F.col("group") != F.col("o_group")) | (F.col("u") > F.col("v"))))
    done = first.union(first.select(F.col("v"), F.col("u")))
    more = stored(_verified(expanded.select("u", "v").join(done, ["u", "v"], "left_anti"), sets, percent), "verified")
    if more.isEmpty():
        return found
    return stored(components(links.union(more)), "components")


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of other characters than space and the controls 9 to 13, A-Z lower-cased. A text's set holds its
    distinct shingles of ``width`` words; a shorter text is one shingle, and null, empty and blank texts
    have none and are linked with nothing. Two texts are linked if 100 * intersection >= percent * union.
    component_id is the least id reachable; null ids come last, and stay null where no other id is
    reachable. Repeated rows are linked and get the same result each. Other columns are left out. An
    empty table gives no rows.
    """
    rows = stored(_digests(docs, id_col, text_col, width, percent), "digests")
    classes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("first").alias("first"))
    classes = stored(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    alone = _alone(classes.select("no", F.explode("first").alias("element")))
    linkable = classes.select("no", "key", "id", "n").join(alone, "no", "left").filter(
        F.coalesce("own", F.lit(0)) <= spare(F.col("n"), percent))
    wanted = stored(linkable.select("key", "no", "id"), "linkable")
    sets = stored(_whole_sets(docs, wanted, id_col, text_col, width), "sets")
    found = _links(_grouped(sets, percent), sets, percent)
    rooted = classes.select("key", "no", "id").join(found.withColumnRenamed("key", "no"), "no", "left").select(
        "key", "id", F.coalesce("root", "no").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    # a table of its own, so that a class with very many copies can be split in the last join
    named = stored(rooted.join(least, "root").select("key", "component_id"), "named")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
