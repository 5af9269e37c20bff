"""Per-group ranks, prefixes and numbering that hold up when one group is huge.

A window over a group runs in one task. Four devices keep that task small:

* ``top_rows`` – ``row_number() <= k`` lets Spark cut every map task to k rows
  per group before the shuffle;
* ``competition_ranks`` – only groups larger than ``MANY`` rows are ranked from counts;
* ``running_sum`` and ``dense_index`` – block totals first (partial
  aggregation), then windows inside blocks only;
* ``sum_before`` – the order is cut into stretches by a range shuffle, which are
  even however values crowd; windows run inside stretches and over their totals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.stages import materialize

MANY = 100_000  # rows of a group that one task may put in order


def top_rows(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "position") -> DataFrame:
    """First ``k`` rows of every group with their 1-based position."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def first_rows(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the first in the given total order."""
    return top_rows(df, group, order, 1, "_first").drop("_first")


def sum_before(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Total of ``value`` over the rows of the group that come earlier in the order.

    A range shuffle deals each group's order into stretches of even size; rows with
    equal keys share one, so feed distinct keys with counts. Totals of stretches are
    at most as many as partitions and groups together.
    """
    placed = materialize(
        df.repartitionByRange(*[F.asc(g) for g in group], *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "stretches",
    ).withColumn("_stretch", F.shiftrightunsigned("_at", 33))
    earlier = W.partitionBy(*group).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*group, "_stretch")
        .agg(F.sum(value).alias("_total"))
        .select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_stretch").alias("_s"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)], F.col("_stretch") == F.col("_s"))
    inside = W.partitionBy(*group, "_stretch").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(totals, same).withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out)


@dataclass(frozen=True)
class RankList:
    """One rank list: ``(column, descending)`` keys. Rows whose first key is NULL are
    not in the list."""

    out: str
    keys: tuple[tuple[str, bool], ...]

    def order(self) -> list[Column]:
        return [
            F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last()
            for k, down in self.keys
        ]

    def present(self) -> Column:
        return F.col(self.keys[0][0]).isNotNull()


def _places(ranks: RankList) -> list[Column]:
    """The list's keys as numbers that ascend, best first; what is NULL comes last."""
    last = F.lit(float("inf"))
    keys = [F.coalesce((-F.col(k) if down else F.col(k)).cast("double"), last) for k, down in ranks.keys]
    return [*keys, *[F.lit(0.0)] * (2 - len(keys))]


def competition_ranks(df: DataFrame, group: list[str], lists: list[RankList]) -> DataFrame:
    """Add 1, 2, 2, 4 ranks for every list of one or two numeric keys; NULL where a row is not in the list.

    Groups of up to ``MANY`` rows are ranked by windows after one shuffle. Larger ones, of which there
    are at most a row for every ``MANY`` rows, are looked up first and ranked from counts of their keys.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > MANY)
    large = materialize(sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]), "large-groups")
    if large.isEmpty():
        return _ranks_by_windows(df, group, lists)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)])
    small = df.join(F.broadcast(large), same, "left_anti")
    counted = _ranks_from_counts(df.join(F.broadcast(large), same, "left_semi"), group, lists)
    return _ranks_by_windows(small, group, lists).unionByName(counted)


def _ranks_by_windows(df: DataFrame, group: list[str], lists: list[RankList]) -> DataFrame:
    """Ranks inside groups that a task can sort. Rows that are not in a list come after all that are."""
    for ranks in lists:
        order = W.partitionBy(*group).orderBy(F.desc(ranks.present()), *_places(ranks))
        df = df.withColumn(ranks.out, F.when(ranks.present(), F.rank().over(order)))
    return df


def _ranks_from_counts(df: DataFrame, group: list[str], lists: list[RankList]) -> DataFrame:
    """Ranks inside groups of any size.

    A rank is one more than the rows of better keys, so only distinct keys with
    their counts are put in order, those of all lists by one range shuffle into even
    stretches (``sum_before``). However many rows a group or a key has, they meet a table
    that has their key once.
    """
    entries = F.array(*[
        F.struct(F.lit(i).alias("_list"), *[p.alias(f"_p{j}") for j, p in enumerate(_places(r))], r.present().alias("_in")) for i, r in enumerate(lists)
    ])
    listed = df.select(*group, F.explode(entries).alias("_e")).select(*group, "_e.*").where("_in")
    keys = [*group, "_list", "_p0", "_p1"]
    counts = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    better = sum_before(counts, [*group, "_list"], [F.asc("_p0"), F.asc("_p1")], "_n", "_better")
    ranked = df
    for i, ranks in enumerate(lists):
        mine = better.where(F.col("_list") == i).select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_p0"), F.col("_p1"), (1 + F.col("_better")).cast("int").alias("_rank"))
        first, second = _places(ranks)
        same = ranks.present() & (first == F.col("_p0")) & (second == F.col("_p1"))
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
        ranked = ranked.join(mine, same, "left").withColumn(ranks.out, F.col("_rank")).drop("_p0", "_p1", "_rank", *[f"_g{k}" for k in range(len(group))])
    return ranked


def running_sum(
    df: DataFrame,
    group: list[str],
    block: list[str],
    order: list[Column],
    value: str,
    out: str,
    ceiling: int | None = None,
) -> DataFrame:
    """Running total of ``value`` in (block, order) order.

    ``block`` columns are a coarse prefix of the order. With ``ceiling`` only
    rows up to that total are returned; later blocks are cut before their rows
    are shuffled. Values must not be negative then.
    """
    before = W.partitionBy(*group).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, *block)
        .agg(F.sum(value).alias("_total"))
        .select(*group, *block, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    if ceiling is not None:
        offsets = offsets.where(F.col("_before") <= ceiling)
    inside = W.partitionBy(*group, *block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = (
        df.join(offsets, [*group, *block])
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_before")
    )
    return summed if ceiling is None else summed.where(F.col(out) <= ceiling)


def dense_index(df: DataFrame, keys: list[str], group: list[str] | None = None, out: str = "idx") -> DataFrame:
    """Distinct keys numbered 0..n-1 inside each group, with the group's ``n``.

    Keys are ordered by the first three hex digits of their md5 and then by
    value: 4,096 even blocks, so no task numbers more than a sliver of them.
    """
    group = group or []
    distinct = df.select(*group, *keys).distinct().withColumn(
        "_block", F.left(F.md5(F.concat_ws("\n", *[F.col(k).cast("string") for k in keys])), F.lit(3))
    )
    upto = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = (
        distinct.groupBy(*group, "_block")
        .agg(F.count(F.lit(1)).alias("_m"))
        .select(
            *group,
            "_block",
            F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"),
            F.sum("_m").over(whole).alias("n_keys"),
        )
    )
    inside = W.partitionBy(*group, "_block").orderBy(*keys)
    return (
        distinct.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*group, "_block"])
        .withColumn(out, F.col("_before") + F.col("_at") - 1)
        .select(*group, *keys, out, "n_keys")
    )


def strict_join(left: DataFrame, right: DataFrame, keys: list[str], missing: str) -> DataFrame:
    """Inner join that fails where a left row has no partner, instead of losing it."""
    joined = left.join(right.withColumn("_partner", F.lit(True)), keys, "left")
    named = F.concat_ws(" ", F.lit(f"{missing}:"), *[F.col(k).cast("string") for k in keys])
    whole = F.when(F.col("_partner").isNull(), F.raise_error(named)).otherwise(F.lit(True))
    return joined.where(whole).drop("_partner")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns one side lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
