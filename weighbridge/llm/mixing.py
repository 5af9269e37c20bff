"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.common import WORD, ordered_positions
from weighbridge.stages import materialize

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
BUDGET = 1.5  # times all sizes
MOST = 2.0  # times a source's size
SEED = 20


def words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn. The budget is
    shared by weight; a target stops at ``most`` times its source's size and the
    excess is shared again until none is above. Each round is one aggregation of
    the source table: the level (target per weight) rises until no further source
    reaches its stop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_positions(totals.withColumn("_all", F.lit(0)), ["_all"], [F.asc_nulls_last("source")], "_rank", "sources")
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")]
    table = materialize(
        ranked.select("source", "source_size", weight.alias("_weight"), (F.lit(most) * F.col("source_size")).alias("_stop")),
        "weights",
    )
    total = budget * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("_stop") <= F.lit(level) * F.col("_weight")
        taken, open_weight, now = table.agg(
            F.sum(F.when(full, F.col("_stop"))), F.sum(F.when(~full, F.col("_weight"))), F.count(F.when(full, 1))
        ).first()
        if not open_weight or now == stopped:
            break
        level, stopped = (total - (taken or 0.0)) / open_weight, now
    target = F.least(F.col("_stop"), F.lit(level) * F.col("_weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all, unless given) with ``size, source_size, target, copies, taken``.

    Every document of a source expects target / source size copies. Expected
    copies are summed up along the source, one random offset per source is added,
    and a document is taken once per integer its stretch crosses, so it gets the
    expected number rounded down or up. Half of the documents (by hash) stand in rising, then the other
    half in falling order of size (then by hash of the id and of the text). Neighbours are alike and
    both ends are small, so that whatever the offset, what is taken too much of one is taken too little of the
    next, and the words taken come near the target.

    Columns needed: doc_id, text, source; others pass through, and a column with
    the name of a new one is replaced. Null text has size 0 and is taken as
    empty; a null source is a source of its own; repeated rows are documents of
    their own. An empty table gives an empty one. Where a source has no words its
    target is 0 and nothing is taken.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new] if keep is None else keep
    needed = list(dict.fromkeys([*kept, "doc_id", "source"]))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.drop("size", "_digest").withColumn("size", words("text")).withColumn("_digest", digest).select(*needed, "size", "_digest")
    targets = source_targets(docs.select("source", words("text").alias("size")), weights, budget, most)
    spread = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    falling = spread >= F.lit("8")  # half of the documents, by hash
    order = [falling, F.when(falling, -F.col("size")).otherwise(F.col("size")), spread, F.col("_digest")]
    placed = ordered_positions(rows, ["source"], order, "_place", "placed")
    name = F.concat(F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), "-").otherwise("+"))
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary"))
    each = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_each"),
        (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") / F.lit(1 << 32)).alias("_offset"),
    )
    each = materialize(each, "offsets")
    joined = placed.join(each, F.col("source").eqNullSafe(F.col("_source")))
    upto = lambda place: F.floor(F.col("_offset") + F.col("_each") * place)
    copies = (upto(F.col("_place")) - upto(F.col("_place") - 1)).cast("long")
    mixed = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select(*kept, *new)


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every document as often as the mix takes it."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where(F.col("copies") > 0).select(*columns, times.alias("_copy")).select(*columns)
