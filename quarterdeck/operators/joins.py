"""Joins: checked, as-of, interval, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions.dates import filing_deadline, month_index
from quarterdeck.session import cut_lineage

#: Days whose filing deadlines are kept in a table.
_DEADLINE_DAYS = ("1900-01-01", "2100-12-31")


def cardinality_audit(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row telling whether ``left`` and ``right`` pair one to one on the keys."""
    sides = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = sides.groupBy(*on).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count(F.when((F.col("l") > 0) & (F.col("r") > 0), F.lit(1))).alias("matched_keys"),
        F.count(F.when(F.col("l") > 1, F.lit(1))).alias("repeated_left_keys"),
        F.count(F.when(F.col("r") > 1, F.lit(1))).alias("repeated_right_keys"),
        F.count(F.when((F.col("l") == 0) | (F.col("r") == 0), F.lit(1))).alias("one_sided_keys"),
    )


def one_to_one_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], check: bool = True
) -> DataFrame:
    """Inner join that refuses repeated or one-sided keys."""
    if check:
        row = cardinality_audit(left, right, on).first()
        if row["repeated_left_keys"] or row["repeated_right_keys"] or row["one_sided_keys"]:
            raise ValueError(f"Not a one-to-one join on {list(on)}: {row.asDict()}")
    return left.join(right, list(on), "inner")


def left_lookup(
    left: DataFrame, right: DataFrame, on: Sequence[str], indicator: str = "has_match"
) -> DataFrame:
    """Many-to-one left join with a boolean telling whether a match was found."""
    marked = right.withColumn(indicator, F.lit(True))
    return left.join(marked, list(on), "left").withColumn(
        indicator, F.coalesce(F.col(indicator), F.lit(False))
    )


def market_calendar(source: DataFrame, day: str = "day", number: str = "market_day") -> DataFrame:
    """Distinct dates numbered from one.

    The numbering runs in one task over distinct dates only, whose number is bounded by the
    days on the calendar and does not grow with the rows of the source.
    """
    dates = source.select(F.col(day)).where(F.col(day).isNotNull()).distinct()
    everything = Window.partitionBy(F.lit(1)).orderBy(day)
    return dates.withColumn(number, F.row_number().over(everything))


def asof_calendar(
    dates: DataFrame,
    calendar: DataFrame,
    date: str,
    direction: str,
    day: str = "day",
    number: str = "market_day",
) -> DataFrame:
    """Match each distinct date to the last earlier or first later calendar day (strict).

    Dates and calendar days are merged and swept once, so no pair of dates is ever compared;
    both sides hold distinct dates only.
    """
    if direction not in {"backward", "forward"}:
        raise ValueError("direction is 'backward' or 'forward'.")
    marks = dates.select(
        F.col(date).alias("_at"), F.lit(None).cast("date").alias("_day"),
        F.lit(None).cast("int").alias("_number"), F.lit(True).alias("_asked"),
    ).distinct().unionByName(
        calendar.select(
            F.col(day).alias("_at"), F.col(day).alias("_day"),
            F.col(number).cast("int").alias("_number"), F.lit(False).alias("_asked"),
        )
    )
    if direction == "backward":
        # The question comes before an equal calendar day, so an equal day is not used.
        sweep = Window.partitionBy(F.lit(1)).orderBy(F.col("_at"), F.col("_asked").desc())
    else:
        sweep = Window.partitionBy(F.lit(1)).orderBy(F.col("_at").desc(), F.col("_asked").desc())
    sweep = sweep.rowsBetween(Window.unboundedPreceding, 0)
    found = marks.select(
        "_at", "_asked",
        F.last("_day", ignorenulls=True).over(sweep).alias(day),
        F.last("_number", ignorenulls=True).over(sweep).alias(number),
    )
    return found.where("_asked").select(F.col("_at").alias(date), day, number)


def calendar_windows(
    events: DataFrame,
    calendar: DataFrame,
    date: str,
    direction: str,
    length: int | Column,
    start: str,
    end: str,
    number: str = "window_market_day",
) -> DataFrame:
    """Attach the window of ``length`` calendar days that ends before or starts after ``date``.

    ``length`` may be a column of ``events``. The anchor's day number is returned as ``number``.
    The anchor is kept when the other edge falls outside the calendar, which is then null.
    """
    size = length if isinstance(length, Column) else F.lit(length)
    anchors = asof_calendar(events.select(date), calendar, date, direction)
    anchor, other = (end, start) if direction == "backward" else (start, end)
    step = -(size - 1) if direction == "backward" else size - 1
    placed = events.join(
        anchors.select(date, F.col("day").alias(anchor), F.col("market_day").alias(number)),
        date,
        "left",
    ).withColumn("_edge", F.col(number) + step)
    edges = calendar.select(F.col("market_day").alias("_edge"), F.col("day").alias(other))
    return placed.join(edges, "_edge", "left").drop("_edge")


def interval_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    point: str,
) -> DataFrame:
    """Pair every interval with the points of the same key inside ``[start, end]``.

    Intervals are laid out over the months they touch and the month joins the key, so a key
    with a long history is spread over many small groups and a point is only compared with
    intervals that touch its month. Intervals must be bounded (no open-ended dates).
    """
    months = F.sequence(month_index(F.col(start)), month_index(F.col(end)))
    laid_out = intervals.where(F.col(start) <= F.col(end)).withColumn("_month", F.explode(months))
    located = points.withColumn("_month", month_index(F.col(point)))
    return (
        laid_out.join(located, [*keys, "_month"])
        .where(F.col(point).between(F.col(start), F.col(end)))
        .drop("_month")
    )


def validity_join(
    facts: DataFrame,
    history: DataFrame,
    fact_key: str,
    history_key: str,
    at: str,
    start: str,
    end: str,
) -> DataFrame:
    """Facts joined to the history rows that are valid at the fact's date (both ends included)."""
    return facts.join(
        history,
        (facts[fact_key] == history[history_key])
        & facts[at].between(history[start], history[end]),
    )


def reconcile(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    values: Sequence[str],
    tolerance: float = 1e-12,
) -> DataFrame:
    """Full outer comparison of two tables: one-sided rows and differing values, in one row."""
    a = left.select(*on, *[F.col(v).alias(f"_l_{v}") for v in values], F.lit(True).alias("_in_l"))
    b = right.select(*on, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_in_r"))
    joined = a.join(b, list(on), "full")
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()

    def unequal(name: str) -> Column:
        x, y = F.col(f"_l_{name}"), F.col(f"_r_{name}")
        far = F.abs(x - y) > tolerance
        return both & ((x.isNull() != y.isNull()) | F.coalesce(far, F.lit(False)))

    return joined.agg(
        F.count(F.when(both, F.lit(1))).alias("matched_rows"),
        F.count(F.when(F.col("_in_r").isNull(), F.lit(1))).alias("left_only_rows"),
        F.count(F.when(F.col("_in_l").isNull(), F.lit(1))).alias("right_only_rows"),
        *[F.count(F.when(unequal(v), F.lit(1))).alias(f"{v}_differences") for v in values],
    )


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(*on), list(on), "left_anti")


def orphan_counts(
    parent: DataFrame, children: Mapping[str, DataFrame], on: Sequence[str]
) -> DataFrame:
    """Orphan rows per child table."""
    parts = [
        orphans(child.select(*on), parent, on)
        .agg(F.count(F.lit(1)).alias("orphan_rows"))
        .select(F.lit(name).alias("child_table"), "orphan_rows")
        for name, child in children.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def restrict_to_members(facts: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Facts whose key is in the member list; the adaptive planner broadcasts a small list."""
    return facts.join(members.select(*on).distinct(), list(on), "left_semi")


def membership_sides(
    left: DataFrame, right: DataFrame, on: Sequence[str], side: str = "side"
) -> DataFrame:
    """Distinct keys of either table with the side they appear on."""
    a = left.select(*on).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
    b = right.select(*on).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    seen = a.unionByName(b).groupBy(*on).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    label = (
        F.when((F.col("_l") == 1) & (F.col("_r") == 1), "both")
        .when(F.col("_l") == 1, "left_only")
        .otherwise("right_only")
    )
    return seen.select(*on, label.alias(side))


def symmetric_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys present on exactly one side; empty when the key sets agree."""
    return membership_sides(left, right, on).where(F.col("side") != "both")


def rows_around_dates(
    rows: DataFrame, day: str, dates: DataFrame, date: str
) -> DataFrame:
    """Distinct days of ``rows`` strictly before and strictly after each date."""
    calendar = market_calendar(rows, day).withColumnRenamed(day, "_cal")
    size = calendar.agg(F.count(F.lit(1)))
    asked = dates.select(date).distinct()
    before = asof_calendar(asked, calendar, date, "backward", day="_cal").select(
        date, F.coalesce(F.col("market_day"), F.lit(0)).alias("days_before")
    )
    after = asof_calendar(asked, calendar, date, "forward", day="_cal").select(
        date, F.col("market_day").alias("_next")
    )
    return before.join(after, date).select(
        date,
        F.col("days_before").cast("bigint").alias("days_before"),
        F.coalesce(size.scalar() - F.col("_next") + 1, F.lit(0)).cast("bigint").alias("days_after"),
    )


def linked_pairs(
    edges: DataFrame,
    holdings: DataFrame,
    period: str,
    first: str,
    second: str,
    manager: str,
    security: str,
    weight: str,
) -> DataFrame:
    """Sum of edge weights per security over the edges whose two ends both hold it.

    ``holdings`` has a row per manager and security. A portfolio is one row with an array, so an
    edge is moved with the array of its smaller portfolio, meets the larger one and lists the common
    securities in place: only sums per security are moved after that.
    """
    portfolios = cut_lineage(
        holdings.where(F.col(security).isNotNull()).groupBy(period, manager).agg(F.collect_list(security).alias("_held"))
        .withColumn("_size", F.size("_held"))
    )
    sizes = portfolios.select(period, manager, "_size")
    sized = (
        edges.select(period, first, second, weight)
        .join(sizes.select(period, F.col(manager).alias(first), F.col("_size").alias("_na")), [period, first])
        .join(sizes.select(period, F.col(manager).alias(second), F.col("_size").alias("_nb")), [period, second])
    )
    small_first = F.col("_na") <= F.col("_nb")
    turned = sized.select(
        period,
        F.when(small_first, F.col(first)).otherwise(F.col(second)).alias("_small"),
        F.when(small_first, F.col(second)).otherwise(F.col(first)).alias("_large"),
        weight,
    )
    sent = turned.join(
        portfolios.select(period, F.col(manager).alias("_small"), F.col("_held").alias("_of_small")), [period, "_small"]
    ).select(period, "_large", weight, "_of_small")
    met = sent.join(
        portfolios.select(period, F.col(manager).alias("_large"), F.col("_held").alias("_of_large")), [period, "_large"]
    )
    return (
        met.select(period, weight, F.explode(F.array_intersect("_of_small", "_of_large")).alias(security))
        .groupBy(period, security)
        .agg(F.sum(weight).alias("linked_weight"), F.count(F.lit(1)).alias("linked_pairs"))
    )


def with_filing_deadline(
    frame: DataFrame, period: str = "report_period", output: str = "information_date", lag_days: int = 45
) -> DataFrame:
    """Add the filing deadline of each row's period.

    The holiday rules are worked out once for every day of ``_DEADLINE_DAYS``, a table of fixed
    size: on each row they cost more than the grouping before them, and a table of the distinct
    periods would cost a further pass over the input. Days outside of it follow the rules by row.
    """
    first, last = (date.fromisoformat(d) for d in _DEADLINE_DAYS)
    days = frame.sparkSession.range((last - first).days + 1).select(
        F.date_add(F.lit(_DEADLINE_DAYS[0]).cast("date"), F.col("id").cast("int")).alias("_deadline_of")
    )
    known = days.withColumn("_deadline", filing_deadline(F.col("_deadline_of"), lag_days))
    return (
        frame.join(known, F.col(period).cast("date") == F.col("_deadline_of"), "left")
        .withColumn(output, F.coalesce("_deadline", filing_deadline(F.col(period), lag_days)))
        .drop("_deadline_of", "_deadline")
    )
