"""K-d tree sharding.

The corpus is cut recursively.  Every node cuts along its widest metadata
dimension at the weighted quantile that gives both children bytes in proportion
to the shards they will hold, until every leaf holds one shard.  Coordinates
derive from the text alone, so equal texts never part and no join is needed to
keep them together; a hash of the text breaks ties, so any cut can be met to
within one group of equal texts.

Quantiles are found without sorting: one histogram of bytes by leading bits for
all nodes of a level, then by the next bits inside the chosen bin, until the
coordinate is exact.  Only these histograms (nodes x 2**BITS rows at most)
reach the driver.

Edge cases: null text counts as empty; ties and copies stay together, so a
shard that holds a group larger than its share is larger by that group; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BITS, ROUNDS = 13, 4
DIMS = ("c_bytes", "c_foreign", "c_lines")


def _coordinate(value: Column, text: Column) -> Column:
    """20 bits of the value, then 32 bits of the text's hash to break ties."""
    top = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit((1 << 20) - 1)).cast("long")
    return F.shiftleft(top, 32).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # as long: an int fails at 32,768 bytes beyond ASCII or 2,048 lines times the scale
    n = F.octet_length(text).cast("long")
    lines = n - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n + F.lit(8)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _coordinate(F.log2(n + F.lit(1)) * 8192, text).alias("c_bytes"),
        _coordinate((n - F.char_length(text)) * 65536 / (n + 1), text).alias("c_foreign"),
        _coordinate(lines * 1048576 / (n + 1), text).alias("c_lines"),
    )


def _case(values: dict[int, int]) -> Column:
    """The value of each open node, of which there are fewer than shards."""
    (first, v), *more = values.items()
    out = F.when(F.col("node") == first, F.lit(v))
    for n, v in more:
        out = out.when(F.col("node") == n, F.lit(v))
    return out


def _cuts(rows: DataFrame, nodes: dict[int, int], scale: list[int]) -> dict[int, tuple[int, int]]:
    """For each node (first shard -> number of shards) its dimension and the last coordinate of the left child."""
    dims = range(len(DIMS))
    high = lambda d: F.shiftright(F.col("at")[d], 32)
    rows = rows.filter(F.col("node").isin(*nodes))
    extents = rows.groupBy("node").agg(F.sum("size").alias("w"), *(F.min(high(d)).alias(f"lo{d}") for d in dims), *(F.max(high(d)).alias(f"hi{d}") for d in dims)).collect()
    dim, goal, prefix, before = {}, {}, {}, {}
    for r in extents:
        k = nodes[r["node"]]
        dim[r["node"]] = max(dims, key=lambda d, r=r: (r[f"hi{d}"] - r[f"lo{d}"]) / scale[d])
        goal[r["node"]] = r["w"] * (k // 2) / k
        prefix[r["node"]], before[r["node"]] = 0, 0
    for step in range(ROUNDS if dim else 0):
        shift = BITS * (ROUNDS - 1 - step)
        bins = (
            rows.select("node", "size", F.shiftright(F.col("at")[_case(dim)], shift).alias("bin"))
            .filter(F.shiftright("bin", BITS) == _case(prefix))
            .groupBy("node", "bin")
            .agg(F.sum("size").alias("w"))
            .collect()
        )
        found: dict[int, list] = {}
        for r in bins:
            found.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for n, pairs in found.items():
            for at, (b, w) in enumerate(sorted(pairs)):
                if before[n] + w >= goal[n] or at == len(pairs) - 1:
                    prefix[n] = b
                    break
                before[n] += w
            if step == ROUNDS - 1 and w - (goal[n] - before[n]) > goal[n] - before[n]:
                prefix[n] = b - 1  # nearer without this group
    return {n: (dim[n], prefix[n]) for n in dim}


def kd_shards(measured: DataFrame, shards: int) -> DataFrame:
    """Add the column ``shard`` to rows that have ``size`` and the coordinates."""
    span = measured.agg(*(f(F.shiftright(d, 32)).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    scale = [max(1, (span[f"hi_{d}"] or 0) - (span[f"lo_{d}"] or 0)) for d in DIMS]
    rows = measured.withColumn("at", F.array(*DIMS)).drop(*DIMS)
    splits: dict[tuple[int, int], tuple[int, int, int]] = {}

    def node(level: int, n: int) -> Column:
        """Where a row stands below node n of a level: one expression of the splits found so far."""
        if (level, n) not in splits:
            return F.lit(n)
        d, cut, half = splits[level, n]
        return F.when(F.col("at")[d] > cut, node(level + 1, n + half)).otherwise(node(level + 1, n))

    nodes, level = {0: shards}, 0
    while any(k > 1 for k in nodes.values()):
        cuts = _cuts(rows.withColumn("node", node(0, 0)), {n: k for n, k in nodes.items() if k > 1}, scale)
        if not cuts:
            break  # no rows
        splits |= {(level, n): (*cuts.get(n, (0, 1 << 62)), k // 2) for n, k in nodes.items() if k > 1}
        nodes = {n: k for n, k in nodes.items() if k == 1} | {m: c for n, k in nodes.items() if k > 1 for m, c in ((n, k // 2), (n + k // 2, k - k // 2))}
        level += 1
    return rows.withColumn("shard", node(0, 0)).drop("at")


def with_slots(rows: DataFrame, keys: list[str], parts: int = 256) -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    A shard is dealt into ``parts`` by hash; each part is numbered on its own and
    starts where the parts before it end, so no task sorts a whole shard.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy(*keys)
    # starts has shards x parts rows at most
    return rows.withColumn("at", F.row_number().over(own) - 1).join(F.broadcast(starts), ["shard", "part"]).withColumn("slot", F.col("start") + F.col("at")).drop("part", "start", "at")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    measured = cut_lineage(measure(docs))
    placed = with_slots(kd_shards(measured, shards), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
