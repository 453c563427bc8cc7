"""Windows over groups of any size: rows in ranges of keys and order, and what each range carries to the next.

A group (a profile, a run) may hold a third of all rows, and a window over it would
run in one task.  Here rows are dealt into blocks by ranges of (keys, order), so a
block holds many small groups or a piece of a large one.  A block's summary for a
group is one small row (count, sums, largest values, last row); prefix sums over
summaries, as many a group as there are blocks, are what a block starts from.

Rows that tie in keys and order stay in one block, in no defined order.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint where the session names a folder for them, else persisted (with the disk as overflow)."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", ""):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Blocks:
    def __init__(self, df: DataFrame, by: str | tuple[str, ...], order: str | tuple[str, ...], block: str = "__block", parts: int | None = None):
        self.by, self.order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
        self.block = block
        # cut here: another run of the same plan might draw other ranges
        self.rows = kept(df.repartitionByRange(*([parts] if parts else []), *self.by, *self.order).withColumn(block, F.spark_partition_id()))

    def over(self, rows: DataFrame) -> Blocks:
        """The same blocks with other columns."""
        other = object.__new__(Blocks)
        other.by, other.order, other.block, other.rows = self.by, self.order, self.block, rows
        return other

    def done(self) -> DataFrame:
        return self.rows.drop(self.block)

    def scan(
        self,
        number: str | None = None,
        sums: dict[str, Column] | None = None,
        highest_before: dict[str, Column] | None = None,
        last: dict[str, Column] | None = None,
        before: dict[str, str | Column] | None = None,
    ) -> Blocks:
        """Rows with further columns, each over its group in order.

        number: the row's number from 1; sums: running sums, this row included;
        highest_before: the largest value of the rows before; last: the newest value that
        isn't null, this row included; before: the row before's value.
        """
        sums, highest_before, last, before = sums or {}, highest_before or {}, last or {}, before or {}
        key = [*self.by, self.block]
        inner = Window.partitionBy(*key).orderBy(*self.order)
        upto, ahead = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct(*self.order)
        cols = {f"__before_{n}": F.col(c) if isinstance(c, str) else c for n, c in before.items()}
        made = self.rows.withColumns(cols | {f"__sum_{n}": c for n, c in sums.items()} | {f"__high_{n}": c for n, c in highest_before.items()} | {f"__last_{n}": c for n, c in last.items()})
        told = [F.count(F.lit(1)).alias("__n")]
        told += [F.sum(f"__sum_{n}").alias(f"__sum_{n}") for n in sums] + [F.max(f"__high_{n}").alias(f"__high_{n}") for n in highest_before]
        told += [F.max_by(F.struct(F.col(f"__last_{n}").alias("v")), F.when(F.col(f"__last_{n}").isNotNull(), place)).alias(f"__last_{n}") for n in last]
        told += [F.max_by(F.struct(*cols), place).alias("__row")] if cols else []
        summary = made.groupBy(*key).agg(*told)
        across = Window.partitionBy(*self.by).orderBy(self.block)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        carry = [F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__c_n")]
        carry += [F.sum(f"__sum_{n}").over(earlier).alias(f"__c_sum_{n}") for n in sums] + [F.max(f"__high_{n}").over(earlier).alias(f"__c_high_{n}") for n in highest_before]
        carry += [F.last(f"__last_{n}", ignorenulls=True).over(earlier).alias(f"__c_last_{n}") for n in last]
        carry += [F.lag("__row").over(across).alias("__c_row")] if cols else []
        starts = summary.select(*key, *carry)
        # groups may have null keys, which a join has to match as well
        names = [f"__k{i}" for i in range(len(key))]
        starts = starts.withColumnsRenamed(dict(zip(key, names)))
        match = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names)]
        both = made.join(starts, match).drop(*names)
        out: dict[str, Column] = {}
        if number:
            out[number] = F.row_number().over(inner) + F.col("__c_n")
        for n in sums:
            out[n] = F.sum(f"__sum_{n}").over(upto) + F.coalesce(F.col(f"__c_sum_{n}"), F.lit(0))
        for n in highest_before:
            out[n] = F.greatest(F.max(f"__high_{n}").over(ahead), F.col(f"__c_high_{n}"))
        for n in last:
            out[n] = F.coalesce(F.last(f"__last_{n}", ignorenulls=True).over(upto), F.col(f"__c_last_{n}")["v"])
        for n in before:
            out[n] = F.when(F.row_number().over(inner) == 1, F.col("__c_row")[f"__before_{n}"]).otherwise(F.lag(f"__before_{n}").over(inner))
        return self.over(both.withColumns(out).select(*self.rows.columns, *out))


def numbered(df: DataFrame, by: str | tuple[str, ...], order: str | tuple[str, ...], name: str) -> DataFrame:
    """Rows with their number (from 1) in their group."""
    return Blocks(df, by, order).scan(number=name).done()
