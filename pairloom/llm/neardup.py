"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. Every text gets its set of five-word shingles (64-bit hashes), a 128-bit key of the set, and a
   SuperMinHash signature: an element draws the ranks of a permutation one by one, and stops
   once no slot can be lowered any more. Texts with equal sets are one class from here on.
2. Bands of the signature are hashed. Classes that share a band are candidates. Of these, shingles
   that only one text has are counted: they bound every similarity from above, exactly, and
   take out altered copies that can have no link. Every class left is compared with the
   least altered one of each of its buckets, on the full sets.
3. Verified links are contracted by union-find inside each task, then by star steps over the
   whole table, until each class points to the least key of its component.
4. Buckets that still hold classes of several components are worked off: the pairs across
   components that this bound admits, and one from how many shingles each has per part of all hashes, are
   compared once more on full sets. So every candidate pair is verified,
   ruled out by the bound or already inside one component; no link that banding finds is lost.

Bands have six rows; there are so many that a pair at the threshold shares none with a probability
of one in a million at most (30 at 0.85, 46 at 0.8).
Large groups of copies are one class; a large group of near copies needs a link per member and
leader, never one per pair. Joins by bucket or class are plain equi-joins that adaptive
execution can split. Texts move only for classes that have a candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.bloom import Bloom
from pairloom.llm.batches import map_texts, pieces, settled
from pairloom.llm.words import SPACED, WordTable
from pairloom.session import stored

SHINGLE = 5
ROWS = 6
MISS = 1e-6
PARTS = 128  # of a set, in its profile
PIECE = 1 << 18
WORD = r"[^\x20\x09-\x0D]"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a word sequence, in order of number; a shorter one is one shingle."""
    own = min(width, len(hashes))
    if not own:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - own + 1, own, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(own):
            out = mix(out * _A + hashes[k:k + len(out)])
    return np.unique(out)


def set_key(elements: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        parts = mix(elements + _A).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(elements ^ _C))
    return np.array(parts, ">u8").tobytes()


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash of every non-empty set: rank in the high bits, a 40-bit draw in the low ones.

    Rank j of an element's random permutation names the slot that its j-th draw may lower. A
    set stops as soon as all its slots hold a value of a lower rank than the next.
    """
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    elements = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None  # the permutations, as far as they are drawn
    for rank in range(size):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            draw = mix(elements + np.uint64(rank + 1) * _A)
        pick = rank + ((draw & np.uint64(0xFFFFFF)) % np.uint64(size - rank)).astype(np.int64)
        if rank == 0:
            slot, first = pick, pick
        elif rank == 1:
            # what two swaps from the identity leave at the picked place
            slot, second = np.where(pick == first, 0, pick), pick
        else:
            row = np.arange(len(elements))
            if rank == 2:
                order = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
                for place, other in ((0, first), (1, second)):
                    held = order[row, place].copy()
                    order[row, place] = order[row, other]
                    order[row, other] = held
            slot = order[row, pick]
            order[row, pick] = order[row, rank]
            order[row, rank] = slot
        np.minimum.at(flat, owner * size + slot, (np.uint64(rank) << np.uint64(40)) | (draw >> np.uint64(24)))
        open_ = (out.max(axis=1) >> np.uint64(40)) > np.uint64(rank)
        keep = open_[owner]
        if not keep.all():
            elements, owner, first = elements[keep], owner[keep], first[keep]
            second = second[keep] if rank else None
            order = order[keep] if order is not None else None
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number per band, different between bands."""
    parts = signature.reshape(len(signature), bands, rows)
    out = np.tile(mix(np.arange(bands, dtype=np.uint64) + _A), (len(signature), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * _A + parts[:, :, k])
    return out


class Shingler:
    """Shingle sets of texts, with the word hashes of a task at hand."""

    def __init__(self):
        self.words = WordTable(SPACED)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [shingle_set(self.words.hashes[n]) for n in self.words.texts(texts)]


def signed(docs: DataFrame, *, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set) and band hashes of every row."""
    fields = [
        T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]

    def make():
        shingler = Shingler()

        def work(texts):
            sets = shingler(texts)
            hashes = band_hashes(signatures(sets, bands * rows), bands, rows).view(np.int64)
            return {
                "n_shingles": [len(s) for s in sets], "key": [set_key(s) if len(s) else None for s in sets],
                "bands": [h if len(s) else None for h, s in zip(hashes, sets, strict=True)],
            }

        return work

    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col, most=PIECE)


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of class keys with 100 * intersection >= percent * union."""
    joined = (
        pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("u_text")), "u")
        .join(texts.select(F.col("key").alias("v"), F.col("text").alias("v_text")), "v")
    )

    def run(batches):
        shingler, last = Shingler(), (None, None)
        for batch in batches:
            for a, b in pieces(batch.column("u_text"), PIECE):
                part = batch.slice(a, b - a)
                ok, left = [], shingler(part.column("u_text").to_pylist())
                for own, key, text in zip(left, part.column("v").to_pylist(), part.column("v_text"), strict=True):
                    if key != last[0]:
                        last = key, shingler([text.as_py()])[0]
                    shared = len(np.intersect1d(own, last[1], assume_unique=True))
                    ok.append(100 * shared >= percent * (len(own) + len(last[1]) - shared))
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("u", "v", "u_text", "v_text").mapInArrow(settled(run), "u binary, v binary")


def _forest(edges: DataFrame) -> DataFrame:
    """Edges replaced, task by task, by edges from every node to its root (union-find)."""
    def run(batches):
        for batch in batches:
            parent: dict = {}

            def root(x, parent=parent):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((root(u), root(v)))
                parent[b] = a
            made = [(x, root(x)) for x in parent if root(x) != x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[k] for m in made], batch.column(0).type) for k in range(2)], names=["u", "v"])

    return edges.mapInArrow(settled(run), edges.schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of every node are hung on the least of them.

    A large step moves greater neighbours, a small one lesser neighbours and the node itself. Both
    keep components; the least key of each ends up as the centre of a star.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges
    # a table of its own, so that the join can split the edges of a hub
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "least")
    hung = both.join(least, "u")
    if large:
        moved = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            least.select("u", F.col("least").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) with as many v per u as there are bands at most, replaced by links of all of them
    to the least: a large group whose members share leaders then has few links per member."""
    near = links.groupBy("u").agg(F.min("v").alias("least"), F.collect_set("v").alias("all"))
    least = F.least("u", "least")
    ends = F.explode(F.array_append("all", F.col("u")))
    return near.select(ends.alias("u"), least.alias("v")).filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every node with an edge but the roots: root is the component's least key.

    Each step is written to the shared folder; rounds end when all links are stars.
    """
    greater = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(_forest(greater).distinct(), "links")
    while not _open_nodes(now).isEmpty():
        # a table per star: the next one reads its edges twice
        now = stored(_star(stored(_star(now, True), "links"), False), "links")
    return now.select(F.col("u").alias("key"), F.col("v").alias("root"))


def _open_nodes(links: DataFrame) -> DataFrame:
    """Nodes that hang on several others, or on one while others hang on them. Without any, distinct
    links to lesser nodes are stars around the least key of each component."""
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("on")).union(
        links.select("v", F.lit(None).cast(links.schema["v"].dataType)))
    return ends.groupBy("node").agg(F.min("on").alias("least"), F.max("on").alias("most"), F.count_if(F.col("on").isNull()).alias("hung")).filter(
        (F.col("least") != F.col("most")) | (F.col("least").isNotNull() & (F.col("hung") > 0)))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
    bands: int | None = None, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than space and the controls 9 to 13, A-Z lower-cased. Two texts
    are linked if 100 * intersection >= percent * union of their sets of five-word shingles; a
    shorter text is one shingle, and null, empty and blank texts have none and are linked with
    nothing. component_id is the least id reachable; null ids come last, and stay null where no
    other id is reachable. kept: the row's id is its component_id (two nulls count as equal).
    Repeated rows get the same result each, so all rows that repeat the least id are kept. Other
    columns are left out. An empty table gives no rows.
    """
    rooted, table = _grouped(docs, id_col, text_col, percent, bands, rows)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    # a table of its own, so that the last join can split a class with very many copies
    named = stored(rooted.join(least, "root").select("key", "component_id"), "named")
    return table.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
    bands: int | None = None, rows: int = ROWS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have no words or stand for their component.

    Texts without words are linked with nothing, so all of them stay, whatever their ids. Of every
    component of ``near_duplicates`` exactly one row stays: that of the least id (null ids last); where texts with
    different sets share that id, one of them, chosen by the set; of rows that repeat both, any one.
    """
    rooted, table = _grouped(docs, id_col, text_col, percent, bands, rows)
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("one"))
    ids = stored(chosen.select(F.col("one.id").alias("own_id"), F.col("one.key").alias("own")), "chosen")
    # ids whose rows do not all stay: of one row that goes, or of several
    single, named = _single(table), F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    lone = table.filter(named).select("doc_id").join(single, F.col("doc_id") == F.col("single"), "left_semi")
    lone = lone.join(ids, F.col("doc_id") == F.col("own_id"), "left_anti").select("doc_id", F.lit(False).alias("several"))
    several = table.filter(named).select("doc_id").join(
        single, F.col("doc_id") == F.col("single"), "left_anti").distinct().select("doc_id", F.lit(True).alias("several"))
    touched = stored(lone.union(several).withColumnRenamed("doc_id", "touched_id"), "touched")
    bloom = Bloom.of(touched, "touched_id")
    # only rows that the filter lets through move to the exact join; the others have no such id
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    maybe = worded & (F.col(id_col).isNull() | bloom.test(F.col(id_col), bloom.column()))
    left_id = F.col(f"d.{id_col}")  # docs may have columns of any name
    kept = docs.filter(~maybe).union(docs.filter(maybe & F.col(id_col).isNotNull()).alias("d").join(
        touched.alias("t"), left_id == F.col("t.touched_id"), "left_anti"))
    shared = ids.join(touched.filter("several"), F.col("own_id") == F.col("touched_id"), "left_semi").union(ids.filter("own_id is null"))
    if shared.isEmpty():
        return kept
    # ids of several rows: which of them has the chosen set
    wanted = shared.select("own_id").distinct()
    near = docs.filter(worded).alias("d").join(wanted.alias("t"), left_id.eqNullSafe(F.col("t.own_id")), "left_semi")
    packed = near.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([packed.schema["doc"], packed.schema["id"], T.StructField("key", T.BinaryType())])

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for a, b in pieces(batch.column(2), PIECE):
                keys = pa.array([set_key(s) for s in shingler(batch.column(2).slice(a, b - a).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), keys], names=["doc", "id", "key"])

    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own"))
    each = packed.mapInArrow(settled(run), schema).join(shared, same, "left_semi").dropDuplicates(["id", "key"])
    return kept.union(each.select("doc.*"))


def _single(table: DataFrame) -> DataFrame:
    """The ids that only one row has; such an id finds its text without working out sets again."""
    once = table.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n = 1")
    return once.select(F.col("doc_id").alias("single"))


def _grouped(docs, id_col, text_col, percent, bands, rows) -> tuple[DataFrame, DataFrame]:
    """(key, id, root) of every class, with the least id of its texts, and the stored signatures."""
    if bands is None:
        bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
    table = stored(signed(docs, id_col=id_col, text_col=text_col, bands=bands, rows=rows), "signatures")
    classes = table.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # one row per class and band; the band's number is part of the hash
    filed = classes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(filed.join(shared.select("bucket"), "bucket"), "buckets")
    # texts of classes that share a bucket, one row each
    involved = members.select("key").distinct()
    found_in = table.join(involved, "key", "left_semi").select("key", "doc_id").join(
        _single(table), F.col("doc_id") == F.col("single"), "left")
    row_ids = stored(
        found_in.groupBy("key").agg(F.first("single", True).alias("single"), F.first("doc_id", True).alias("id")), "row-ids")
    texts = stored(_texts(docs, row_ids, id_col, text_col).withColumn("no", F.monotonically_increasing_id()), "texts")
    # shingles that no other of these texts has; a class with too many of them has no link
    own = _unique_shingles(texts)
    members = members.join(texts.select("key", "no").join(own, "no", "left"), "key").select(
        "bucket", "key", "n", F.coalesce("own", F.lit(0)).alias("own")
    ).filter(F.col("own") * 100 <= F.col("n") * (100 - percent))
    members = stored(members, "candidates")

    # the least altered class of a bucket leads it
    rank = F.struct((F.col("own") * 1000 / F.col("n")).cast("int").alias("part"), "key", "n", "own")
    leaders = members.groupBy("bucket").agg(F.min(rank).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    fits = _fits(percent)
    first = stored(
        members.join(leaders.select("bucket", F.col("lead.key").alias("v"), F.col("lead.n").alias("m"), F.col("lead.own").alias("other_own")), "bucket")
        .filter((F.col("key") != F.col("v")) & fits).select(F.col("key").alias("u"), "v").distinct(), "pairs")
    links = stored(_contracted(stored(verified(first, texts, percent), "verified")), "links")
    found = components(links)

    # what is still in several components of a bucket: all pairs across them that may be links
    labelled = members.join(found, "key", "left").withColumn("root", F.coalesce("root", "key")).select(
        "bucket", "key", "n", "own", "root")
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
    rest = stored(labelled.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")
    # at most one bucket per band and class; a pair is formed in the first that it shares
    mine = rest.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))
    profiles = _profiles(texts.join(mine.select("key"), "key", "left_semi"))
    rest = stored(rest.join(mine.join(profiles, "key"), "key"), "mixed")
    other = rest.select(
        F.col("bucket").alias("other_bucket"), F.col("key").alias("v"), F.col("n").alias("m"), F.col("own").alias("other_own"), F.col("root").alias("other"),
        F.col("buckets").alias("other_buckets"), F.col("profile").alias("other_profile"))
    first_shared = F.array_min(F.array_intersect("buckets", "other_buckets"))
    second = rest.join(
        other, (F.col("bucket") == F.col("other_bucket")) & (F.col("key") > F.col("v")) & (F.col("root") != F.col("other"))
        & fits & (F.col("bucket") == first_shared) & _profiles_fit(percent))
    second = second.select(F.col("key").alias("u"), "v")
    done = first.union(first.select(F.col("v"), F.col("u")))
    more = stored(verified(second.join(done, ["u", "v"], "left_anti"), texts, percent), "verified")
    if not more.isEmpty():
        found = components(links.union(more))

    rooted = table.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("id")).join(
        found, "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    return stored(rooted, "rooted"), table


def _fits(percent: int):
    """Whether two classes of n and m shingles, own and other_own of them found nowhere else, can
    be similar enough: what they share is within the rest of either."""
    rest, other_rest = F.col("n") - F.col("own"), F.col("m") - F.col("other_own")
    return F.least(rest, other_rest) * 100 >= (
        F.greatest(rest, other_rest) + F.col("own") + F.col("other_own")) * percent


def _profiles(texts: DataFrame) -> DataFrame:
    """(key, profile): how many of a set's shingles fall into each of ``PARTS`` parts by hash."""
    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for a, b in pieces(batch.column(1), PIECE):
                sets = shingler(batch.column(1).slice(a, b - a).to_pylist())
                made = [np.bincount((x % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(made, pa.list_(pa.int32()))], names=["key", "profile"])

    return texts.select("key", "text").mapInArrow(settled(run), "key binary, profile array<int>")


def _profiles_fit(percent: int):
    """Whether two classes can be similar enough by their profiles: of each part they share no more
    than the lesser has."""
    least = F.zip_with("profile", "other_profile", lambda a, b: F.least(a, b))
    most = F.aggregate(least, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return most * (100 + percent) >= (F.col("n") + F.col("m")) * percent


def _unique_shingles(texts: DataFrame) -> DataFrame:
    """(no, own): how many of a text's shingles no other of ``texts`` has."""
    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for a, b in pieces(batch.column(1), PIECE):
                sets = shingler(batch.column(1).slice(a, b - a).to_pylist())
                numbers = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)), pa.array(numbers)], names=["shingle", "no"])

    each = texts.select("no", "text").mapInArrow(settled(run), "shingle long, no long")
    single = each.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("no").alias("no")).filter("texts = 1")
    return single.groupBy("no").agg(F.count("*").alias("own"))


def _texts(docs: DataFrame, row_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of the classes in ``row_ids``, one row per class, by an id that one row has. Where a
    class has none, its id may stand for several texts, so keys are worked out again and matched;
    rows without an id are then all looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    alone = row_ids.filter("single is not null").select("key", "single")
    bloom = Bloom.of(alone, "single")
    plain = rows.filter(bloom.test(F.col("doc_id"), bloom.column())).join(alone, F.col("doc_id") == F.col("single"))
    plain = plain.select("key", "text")
    shared = row_ids.filter("single is null").select("key", "id")
    if shared.isEmpty():
        return plain
    wanted = shared.select("id").distinct()
    near = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]), "left_semi")

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for a, b in pieces(batch.column(0), PIECE):
                texts = batch.column(0).slice(a, b - a)
                keys = [set_key(s) if len(s) else None for s in shingler([t or "" for t in texts.to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), texts], names=["key", "text"])

    keyed = near.select("text").mapInArrow(settled(run), "key binary, text string")
    return plain.union(keyed.join(shared, "key", "left_semi").dropDuplicates(["key"]))
