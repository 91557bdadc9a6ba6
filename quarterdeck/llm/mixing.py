"""Mixing sources to target token counts by nested hash thresholds, without sorting rows.

Every row has a fixed hash. Tokens are summed by source and by the hash's leading digit; a
running total over these few digits names the digit in which a source's budget runs out. Only
rows with that digit are summed again by their next digit, and so on. The digits found are the
threshold: a row is taken if its hash lies below it. Running totals run over digits, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.session import cut_lineage

_DIGIT_BITS = 10
_LEVELS = 4


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target): shares of all sizes by weight, none above ``most`` times its size.

    Weights repeat over the sources in code point order, null last. A source's target is
    min(most * size, weight * level); the level at which the targets add up is found by going
    through the sources in the order in which they reach their limit. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    index = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (index + 1).cast("int")).cast("double")
    limit = (F.col("source_size") * most).cast("double")
    weighed = sizes.withColumns({"_weight": weight, "_limit": limit}).withColumn(
        "_reach", F.col("_limit") / F.col("_weight")
    )
    by_reach = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    earlier = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    # The level if exactly the sources before this one are at their limit.
    level = (
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    ) / (F.sum("_weight").over(by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    found = weighed.withColumn("_try", level)
    open_ = F.min(F.when(F.col("_try") <= F.col("_reach"), F.struct("_reach", "_try"))).over(everything)
    target = F.when(open_.isNull() | (F.col("_reach") < open_["_reach"]), F.col("_limit")).otherwise(
        F.least("_limit", F.col("_weight") * open_["_try"])
    )
    return found.select("source", "source_size", target.alias("target"))


def row_hash(id_column: str, text_column: str, seed: int) -> Column:
    """Fixed hash of a row, of as many bits as there are digits."""
    value = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column).cast("string"))
    return F.shiftrightunsigned(value, 64 - _DIGIT_BITS * _LEVELS)


def mixing_plan(
    rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3
) -> DataFrame:
    """(source, source_size, target, times, cut) per source of rows (source, size, hash).

    A row is used ``times`` times, and once more if its hash is below ``cut``. The cut is the
    prefix of the rows in hash order that comes nearest to the rest of the budget.
    """
    targets = source_targets(rows, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = cut_lineage(
        targets.withColumn("times", whole).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    )
    cuts = thresholds(rows, budgets.select("source", "rest"))
    return cut_lineage(
        budgets.join(cuts, budgets["source"].eqNullSafe(cuts["source"]), "left").select(
            budgets["source"], "source_size", "target", "times",
            F.when(budgets["rest"] < 0.5, 0).otherwise(F.coalesce("cut", F.lit(0))).alias("cut"),
        )
    )


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: int) -> DataFrame:
    """(doc_id, source, size, hash) of every row, stored."""
    return cut_lineage(
        docs.select(
            F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
            word_count(F.col(text_column)).alias("size"), row_hash(id_column, text_column, seed).alias("hash"),
        )
    )


def mix_to_targets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row; taken / size says how often a row is used.

    The hash is of the id and the text, so reruns agree; rows equal in both share their fate.
    Null texts and blank texts have size 0. A null source is a source. Null ids are ids like others.
    """
    rows = sized(docs, id_column, text_column, source_column, seed)
    plan = mixing_plan(rows, weights, share, most)
    return rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("times") + (F.col("hash") < F.col("cut")).cast("long"))).alias("taken"),
    )


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7,
) -> DataFrame:
    """``docs`` as the mix takes them: rows left out, once or several times, with all their columns.

    Only the plan, one row per source, meets the texts; they are not shuffled.
    """
    plan = mixing_plan(sized(docs, id_column, text_column, source_column, seed), weights, share, most)
    # The row goes through whole, in one column, so that its columns may have any names.
    plan = plan.select(F.col("source").alias("_source"), F.col("times").alias("_times"), F.col("cut").alias("_cut"))
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(source_column).cast("string").alias("_own"),
        row_hash(id_column, text_column, seed).alias("_hash"),
    )
    joined = whole.join(plan, F.col("_own").eqNullSafe(F.col("_source")))
    times = F.col("_times") + (F.col("_hash") < F.col("_cut")).cast("long")
    return joined.select("_doc", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_copy")).select("_doc.*")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): the hash below which a source's sizes add up to about its ``rest``."""
    open_ = budgets.select(
        F.col("source"), F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left")
    )
    for level in range(1, _LEVELS + 1):
        shift = _DIGIT_BITS * (_LEVELS - level)
        digit = F.shiftright("hash", shift)
        parent = F.shiftright("hash", shift + _DIGIT_BITS)
        candidates = rows if level == 1 else rows.alias("r").join(
            open_.alias("o"),
            F.col("r.source").eqNullSafe(F.col("o.source")) & (F.shiftright("r.hash", shift + _DIGIT_BITS) == F.col("o.prefix")),
            "left_semi",
        )
        sums = candidates.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("digit"))  # 1,024 digits at most
        sums = sums.withColumn("upto", upto)
        joined = open_.alias("o").join(sums.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")), "left").select(
            F.col("o.source").alias("source"), "prefix", "left", "digit", "size", "upto"
        )
        last = level == _LEVELS
        # The first digit at which the budget is used up; on the last level, rounded to the nearer side.
        over = F.col("upto") - F.col("size") / 2 > F.col("left") if last else F.col("upto") > F.col("left")
        grouped = joined.groupBy("source", "prefix", "left").agg(
            F.min(F.when(over, F.struct("digit", (F.col("upto") - F.col("size")).alias("used")))).alias("first"),
        )
        # None: every row below the parent's end fits.
        end = F.shiftleft(F.col("prefix") + 1, _DIGIT_BITS)
        open_ = grouped.select(
            "source", F.coalesce("first.digit", end).alias("prefix"),
            (F.col("left") - F.coalesce("first.used", F.lit(0))).alias("left"),
        )
        open_ = cut_lineage(open_)
    return open_.select("source", F.col("prefix").alias("cut"))
