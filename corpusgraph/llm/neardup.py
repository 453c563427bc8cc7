"""Near-duplicates by circulant MinHash with exact verification.

A document's set holds the hashes of its distinct word shingles.  Two permutations
of the 32-bit numbers make every signature coordinate: the first places a shingle
on a circle, the second, shifted k places around it, orders the circle for
coordinate k.  BANDS bands of ROWS coordinates propose candidates; a pair at
similarity 0.8 is missed by all bands with a probability of 4e-7.

Rows with equal sets are one class before anything is paired.  Inside a band's
bucket pairs are not expanded.  Links are found in three steps, each followed by a
contraction of the components, and only buckets that still hold several components
go on:

1. Every member of a bucket is compared with the bucket's first class.
2. Classes of which too few shingles occur in any other open class can't be linked
   and leave.  The member of which the largest share does leads the bucket, and all
   members are compared with it.
3. What is left are pairs of different components under one leader, of which one at
   least isn't linked with the leader.  Their common shingles are some that the
   leader has, at most as many as either shares with it, and common ones outside the
   leader.  Pairs with common shingles outside it meet in those shingles, rarest
   first and only as many as a link needs (prefix filter); a pair without any needs a
   member smaller than the leader, and meets by the sizes that are possible.

So a group of copies costs two comparisons a member, and every step rules pairs out
by a bound that holds exactly: no link is lost that a bucket proposes.  Each
comparison is the exact similarity of the full sets.  Components come from
contracting the graph of links: every component takes the smallest label among its
neighbours until no link is left between different labels.

Edge cases: null text, or text without words, has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is one; repeated rows
share their class; rows that repeat a doc_id with other texts are linked by their own
texts; rows without a doc_id are linked too, but never name a component (it is null
where no row has one); ties go to the smallest doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, shuffles_freed, slices, utf8

BANDS, ROWS, STEP = 28, 4, 1 << 20
#: Stands for a missing doc_id where one is sorted or joined.
NO_ID = (1 << 63) - 1
#: Up to so many edges (1 MB) are contracted in one partition, and what comes of them is told to all tasks.
FEW = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles."""
    n, rows = len(data), len(off) - 1
    none = np.zeros(0, np.uint64)
    if not n:
        return [none] * rows
    with np.errstate(over="ignore"):
        doc = np.repeat(np.arange(rows), np.diff(off))
        word = ~SPACE[data]
        same = doc[1:] == doc[:-1]
        start = np.flatnonzero(word & np.r_[True, ~word[:-1] | ~same])
        end = np.flatnonzero(word & np.r_[~word[1:] | ~same, True]) + 1
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(n, _BACK)])
        total = np.r_[np.uint64(0), np.cumsum(mix64(LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n])]
        h = mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
        count = np.bincount(doc[start], minlength=rows)
        at = np.r_[0, np.cumsum(count)]
        long = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            long = mix64(long * _BASE + h[j : j + len(long)])
        out = []
        for i in range(rows):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                out.append(np.unique(long[a : b - k + 1]))
            elif b > a:
                x = np.uint64(b - a)  # the number of words keeps these apart from shingles
                for w in h[a:b]:
                    x = mix64(np.asarray(x * _BASE + w + np.uint64(7)))
                out.append(np.array([x], np.uint64))
            else:
                out.append(none)
    return out


def permute(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of the 32-bit numbers."""
    x = x ^ np.uint32(seed)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash of each set that isn't empty: sets x size."""
    count = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), size), np.uint32)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    place = permute((np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32), 0x3C6EF372)
    starts = np.cumsum(count[full]) - count[full]
    with np.errstate(over="ignore"):
        for k in range(size):
            out[full, k] = np.minimum.reduceat(permute(place + np.uint32(k), 0x1B873593), starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
        grid = sig.reshape(len(sig), bands, rows).astype(np.uint64)
        for r in range(rows):
            key = mix64(key * _BASE + grid[:, :, r])
    return key.view(np.int64)


def describe(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set_id (digest of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            sets = shingle_sets(*utf8(b.column(2)), words)
            keys = band_keys(signatures(sets, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([k.tolist() if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                ["doc_id", "th", "n_shingles", "set_id", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, set_id binary, bands array<long>")


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def longs(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of 64-bit words, as signed numbers."""
    ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of 64-bit words."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[i:j] for i, j in zip(off[:-1], off[1:])]


def shingles_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted) of classes (id, first, set_id), taken from the texts of their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            sets = shingle_sets(*utf8(b.column(0)), words)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), longs(sets)], ["set_id", "shingles"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("first"), "text")
    asked = classes.select(F.coalesce("first", F.lit(NO_ID)).alias("first")).distinct()
    texts = rows.join(asked, "first", "left_semi").select("text")
    found = texts.mapInArrow(run, "set_id binary, shingles array<long>")
    return found.join(classes.select("set_id", "id"), "set_id").select("id", "shingles").dropDuplicates(["id"])


def compare(pairs: DataFrame, shingles: DataFrame, rest: bool = False) -> DataFrame:
    """Pairs (a, b) of classes with their sizes, ``both`` (the number of common shingles), and with ``rest`` those of b that a lacks.

    b meets its set first: a may lead very many pairs, and adaptive execution can
    split the last join without dealing its rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, others = [], []
            left, right = rows_of(batch.column(2)), rows_of(batch.column(3))
            for x, y in zip(left, right):
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                both.append(int(np.count_nonzero(z[1:] == z[:-1])))
                if rest:
                    others.append(np.setdiff1d(y, x, assume_unique=True))
            found = [batch.column(0), batch.column(1), *(pa.array([len(z) for z in side], pa.int64()) for side in (left, right)), pa.array(both, pa.int64())]
            yield pa.RecordBatch.from_arrays([*found, longs(others)] if rest else found, ["a", "b", "n_a", "n_b", "both", "rest"][: 5 + rest])

    of_a, of_b = (shingles.withColumnsRenamed({"id": x, "shingles": f"of_{x}"}) for x in "ab")
    met = pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "of_a", "of_b")
    return met.mapInArrow(run, "a long, b long, n_a long, n_b long, both long" + ", rest array<long>" * rest)


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` checkpointed and its number of rows.

    A checkpoint inherits the planner's guess of a join's size, the product of both
    sides.  Joined again and again, that guess gets three times as many digits a round,
    until the driver does nothing else.  Rows that are cached have a size that is known.
    """
    kept = df.persist()
    try:
        n = kept.count()
        return cut_lineage(kept), n
    finally:
        kept.unpersist()


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) with the labels of linked ids made one, the smallest; links are pairs (a, b) of ids.

    Edges only get fewer.  Many are dealt out in every round; the last FEW would be dealt
    out into as many tasks again and again, and take one partition instead, without a
    shuffle; labels, which are many, stay where they are.
    """
    links, n = sized(links)
    few = n <= FEW

    def one(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    def to_all(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    la, lb = (labels.withColumnsRenamed({"id": x, "label": f"l{x}"}) for x in "ab")
    edges = to_all(to_all(one(links)).join(la, "a")).join(lb, "b").filter("la <> lb").select(F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v"))
    edges, n = sized(edges if few else edges.distinct())
    while n:
        few = n <= FEW
        both = edges.union(edges.select("v", "u"))
        to = one(both).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("old"), F.least("u", "v").alias("new")).filter("new < old")
        to = one(sized(to)[0])
        while True:  # labels that point down a path jump to its end, twice as far each time
            onward = to.select(F.col("old").alias("new"), F.col("new").alias("end"))
            jumped = to.join(to_all(onward), "new").select("old", F.col("end").alias("new"))
            jumped, on = sized(jumped)
            if not on:
                break
            jumped = one(jumped)
            to = one(sized(to.join(to_all(jumped.withColumnRenamed("new", "end")), "old", "left").select("old", F.coalesce("end", "new").alias("new")))[0])
        labels = cut_lineage(labels.join(to_all(to), labels["label"] == to["old"], "left").select("id", F.coalesce("new", "label").alias("label")))
        tu, tv = to.withColumnsRenamed({"old": "u", "new": "nu"}), to.withColumnsRenamed({"old": "v", "new": "nv"})
        moved = one(edges).join(to_all(tu), "u", "left").join(to_all(tv), "v", "left").select(F.coalesce("nu", "u").alias("x"), F.coalesce("nv", "v").alias("y"))
        edges, n = sized(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    return labels


def reaches(both: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m elements with ``both`` common ones are linked."""
    return (100 + percent) * both >= percent * (n + m)


def unsettled(members: DataFrame, labels: DataFrame, settled: Column) -> DataFrame:
    """Members of buckets that hold several components without those that ``settled`` names: all their pairs are decided."""
    named = members.join(labels, "id")
    several = named.filter(~settled).groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    return named.join(several, "key", "left_semi").drop("label")


def central(members: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """key, id, n, lead: members of which enough shingles occur in other open classes, and whom of them their bucket follows."""
    tokens = shingles.join(members.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("h"))
    alone = tokens.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    held = members.select("key", "id", "n").join(alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    held = cut_lineage(held.filter(100 * F.col("common") >= percent * F.col("n")))
    lead = held.groupBy("key").agg(F.min(F.struct((-F.col("common") / F.col("n")).alias("order"), "id"))["id"].alias("lead"), F.count("*").alias("c")).filter("c > 1")
    return held.join(lead.select("key", "lead"), "key").select("key", "id", "n", "lead")


def beside_leaders(told: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components under one leader that may be linked (step 3).

    told: lead, lead_n, id, n, label, both (common with the leader), rest (not the leader's).
    """
    tokens = told.select("lead", "id", "label", F.explode("rest").alias("h"))
    shared = tokens.groupBy("lead", "h").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("lead", "h", "df")
    # one text's shingles, the rarest first
    ordered = tokens.join(shared, ["lead", "h"]).groupBy("lead", "id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    held = told.drop("rest").join(ordered, ["lead", "id"], "left").withColumn("t", F.coalesce("t", F.array().cast("array<struct<df:bigint,h:bigint>>"))).withColumn("r", F.size("t").cast("long"))
    held = cut_lineage(held.filter(100 * (F.col("both") + F.col("r")) >= percent * F.col("n")))
    need = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100) - F.col("both"))
    reach = F.greatest(F.lit(0), F.col("r") - need + 1).cast("int")
    first = held.select("lead", "id", "label", "n", "both", "r", F.explode(F.slice("t", F.lit(1), reach)).alias("t")).withColumn("h", F.col("t.h")).drop("t")
    x, y = first.alias("x"), first.alias("y")
    most = F.least("x.both", "y.both") + F.least("x.r", "y.r")
    outside = x.join(y, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & reaches(most, F.col("x.n"), F.col("y.n"), percent))
    # none common outside the leader: y isn't linked with it, x is smaller than it
    far = held.filter(~reaches(F.col("both"), F.col("n"), F.col("lead_n"), percent))
    low, high = F.ceil(percent * F.col("n") / 100), F.least(F.floor((100 + percent) * F.col("both") / percent) - F.col("n"), F.col("lead_n") - 1)
    far = far.withColumns({"low": low.cast("long"), "high": high.cast("long")}).filter("low <= high").withColumn("m", F.explode(F.sequence("low", "high")))
    u, v = held.filter("n < lead_n").alias("x"), far.alias("y")
    inside = u.join(v, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.n") == F.col("y.m")) & (F.col("x.label") != F.col("y.label")) & reaches(F.least("x.both", "y.both"), F.col("x.n"), F.col("y.n"), percent))
    ends = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return outside.select(*ends).union(inside.select(*ends)).distinct()


def components(docs: DataFrame, words: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """doc_id, th, n_shingles, set_id, root (number of the component; null if the set is empty), component_id of every row."""
    percent = round(100 * similarity)
    with shuffles_freed(docs.sparkSession):
        told = cut_lineage(describe(docs, words, bands, rows))
        grouped = told.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        classes = cut_lineage(grouped.withColumn("id", F.monotonically_increasing_id()))  # fixed by the checkpoint
        members = classes.select("id", "n", F.coalesce("first", F.lit(NO_ID)).alias("order"), F.explode("bands").alias("key"))
        # in a band's bucket with company
        met = members.groupBy("key").agg(F.min(F.struct("order", "id", "n")).alias("lead"), F.count("*").alias("c")).filter("c > 1")
        open_ = cut_lineage(members.join(met, "key").select("key", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))
        labels = cut_lineage(open_.select("id", F.col("id").alias("label")).distinct())
        shingles = cut_lineage(shingles_of(docs, classes.select("id", "first", "set_id").join(labels, "id", "left_semi"), words))
        linked = reaches(F.col("both"), F.col("n_a"), F.col("n_b"), percent)

        # 1: with the first of the bucket
        near = open_.filter((F.col("id") != F.col("lead")) & reaches(F.least("n", "lead_n"), F.col("n"), F.col("lead_n"), percent))
        first = compare(near.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), shingles)
        labels = contract(labels, first.filter(linked).select("a", "b"))
        # 2: with the most central of the bucket
        led = cut_lineage(central(unsettled(open_, labels, F.col("id") == F.col("lead")).drop("lead", "lead_n"), shingles, percent))
        followers = led.filter("id <> lead")
        second = cut_lineage(compare(followers.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), shingles, rest=True))
        labels = contract(labels, second.filter(linked).select("a", "b"))
        # 3: those beside it
        beside = unsettled(followers, labels, F.lit(False)).select("lead", "id").distinct()
        facts = second.select(F.col("a").alias("lead"), F.col("b").alias("id"), F.col("n_a").alias("lead_n"), F.col("n_b").alias("n"), "both", "rest")
        third = compare(beside_leaders(cut_lineage(facts.join(beside, ["lead", "id"]).join(labels, "id")), percent), shingles)
        labels = contract(labels, third.filter(linked).select("a", "b"))

    named = classes.select("set_id", "first", "id").join(labels, "id", "left").withColumn("root", F.coalesce("label", "id"))
    smallest = named.filter("label IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root", "left").select("set_id", "root", F.coalesce("component_id", "first").alias("component_id"))
    out = told.select("doc_id", "th", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, words: int = 4, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return components(docs, words, similarity, bands, rows).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, words: int, similarity: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and th (hash of the text) of one row of each component, that with the smallest doc_id, then th."""
    found = components(docs, words, similarity, bands, rows).filter("root IS NOT NULL AND doc_id IS NOT NULL")
    return found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("one")).select("one.*")


def label_documents(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, 4, 0.8)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
