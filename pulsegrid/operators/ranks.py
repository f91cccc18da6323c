"""Ranks, running totals, followers and exact quantiles of groups of any size: a group is sorted over as many tasks as it
needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import materialize, ship_package


def changes(batch: pa.RecordBatch, names: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows begin a group; last: the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for c in names:
        own = batch.column(c)
        a, b = own.slice(1), own.slice(0, len(own) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
        new[0] |= last is not None and own[0].as_py() != last.column(c)[0].as_py()
    new[0] |= last is None
    return new


def _sums(by: list[str]):
    """Adds _before, the sum of _amount over the rows of the same group that come before, to sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changes(batch, by, last)
            amount = batch.column("_amount").to_numpy()
            before = np.cumsum(amount) - amount
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            before = before - np.where(at >= 0, before[at], -carry)
            carry, last = int(before[-1] + amount[-1]), batch.slice(len(new) - 1)
            yield batch.append_column("_before", pa.array(before))

    return run


def running_totals(df: DataFrame, by: list[str], order: list[str], amount: Column, name: str = "before", total: str | None = None) -> DataFrame:
    """df with the sum of amount (a whole number) over the rows of the same group (by) that come before, in the order of the
    columns given, and with ``total`` the group's sum.

    Rows move once: they are sorted by ranges of (by, order), so a large group lies in several tasks, and added up as they are
    written; sums of a group's earlier ranges are then added, from one row for each range and group. Equal rows come in any
    order.
    """
    ship_package(df.sparkSession)
    own = df.withColumn("_amount", amount.cast("long"))
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields], "_before long"])
    ordered = own.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(_sums(by), kinds)
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()), "ordered")
    totals = ordered.groupBy("_part", *by).agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = [F.sum("_total").over(Window.partitionBy(*by)).alias("_all")] if total else []
    offsets = totals.select(F.col("_part").alias("_at"), *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"), *everything)
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = ordered.join(offsets, same)
    return met.select(*df.columns, (F.col("_before") + F.col("_offset")).alias(name), *([F.col("_all").alias(total)] if total else []))


def followers(values: DataFrame, by: list[str], column: str, shift: int | Column, strict: bool = True) -> DataFrame:
    """Distinct values (by, column, ...) with rank in their group, from 1, and next, the rank of the first one beyond
    column + shift, or, if not strict, of the first one at it or beyond; it may be one more than there are."""
    own, bound = (F.lit(0), F.lit(1)) if strict else (F.lit(1), F.lit(0))
    marks = values.select(*by, F.col(column).alias("_v"), own.alias("_tag"), F.lit(1).alias("_one"), F.col(column).alias("_own"))
    marks = marks.unionByName(values.select(*by, (F.col(column) + shift).alias("_v"), bound.alias("_tag"), F.lit(0).alias("_one"), F.col(column).alias("_own")))
    ranked = materialize(running_totals(marks, by, ["_v", "_tag"], F.col("_one"), "_rank"), "ranked")
    ranked = ranked.select(*[F.col(c).alias(f"_{c}") for c in by], "_own", (F.col("_rank") + 1).alias("_rank"), "_one")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = values
    for one, name in ((1, "rank"), (0, "next")):
        side = ranked.where(F.col("_one") == one).select(*[f"_{c}" for c in by], "_own", F.col("_rank").alias(name))
        met = met.join(side, same & (F.col(column) == F.col("_own"))).drop("_own", *[f"_{c}" for c in by])
    return met


def exact_quantiles(values: DataFrame, by: list[str], column: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """Quantiles of a column by group; shares gives names and shares. Between two values they are interpolated, or, if nearest,
    the value at floor(share * n) of the sorted ones is taken. Equal values are counted before they are sorted."""
    counts = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, by, ["_value"], F.col("_n"), "_place", "_size")
    at = lambda rank: F.max(F.when((F.col("_place") <= rank) & (rank < F.col("_place") + F.col("_n")), F.col("_value")))
    picked = []
    for name, share in shares.items():
        if nearest:
            hundredths = round(share * 100)
            picked.append(at(F.expr(f"_size * {hundredths} div 100")).alias(name))
        else:
            place = (F.col("_size") - 1) * F.lit(share)
            low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
            picked.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*picked)


#: Size of a quantile sketch: its rank error stays below about 0.2 per cent.
SKETCH_K = 2000


def quantile_states(values: DataFrame, by: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """A mergeable quantile sketch (KLL) of a column for each group, of a few ten kB at most whatever the group's size."""
    return values.where(F.col(column).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias("sketch"))


def merged_states(states: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches merged into larger groups: of nodes into a cluster, of hours into a day."""
    return states.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(states: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Estimated quantiles of sketches; the sketch goes."""
    return states.select("*", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(n) for n, q in shares.items()]).drop("sketch")
