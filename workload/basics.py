"""Scans, projections, joins, aggregations, windows, sets and audits on the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarterdeck.functions import dates, order, paths, scalars
from quarterdeck.functions import aggregates as ag
from quarterdeck.operators import aggregates as oa
from quarterdeck.operators import contracts as ct
from quarterdeck.operators import joins as jn
from quarterdeck.plans import network as nw
from quarterdeck.session import cut_lineage, scratch_path
from quarterdeck.sources import archives
from quarterdeck.sources import tables as src
from workload import recipes as R
from workload.composites import predictions
from workload.registry import case


# ------------------------------------------------------------------ scans and sinks
@case(
    "f1_all_string_scan",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def _(spark, sf):
    path = scratch_path(spark, "tsv")
    o = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    o.write.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)
    return src.read_text_columns(spark, path, ["o_orderkey", "o_orderstatus"])


def packed(groups):
    """(path, content) of zip archives with one tab-separated member per group."""
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        lines = "".join(f'{k}\t"{p}\t""x"""\t{s}\n' for k, p, s in zip(groups["o_orderkey"], groups["priority"], groups["status"], strict=True))
        archive.writestr("data/ORDERS.tsv", "ORDERKEY\tNOTE\tSTATUS\n" + lines)
        archive.writestr("readme.txt", "other")
    return pd.DataFrame({"path": [f"mem:/A{groups['archive'].iloc[0]}.zip"], "content": [buffer.getvalue()]})


@case(
    "f2_archive_members",
    """SELECT 'A' || (o_orderkey // 5000) AS source_archive_id, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders, CAST(sum(length(o_orderpriority) + 4) AS BIGINT) AS note_length
    FROM orders GROUP BY 1""",
)
def _(spark, sf):
    orders = R.table(spark, sf, "orders").select(
        F.expr("o_orderkey div 5000").alias("archive"), "o_orderkey", F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    # Archives of bounded size, whose number grows with the table.
    zipped = cut_lineage(orders.groupBy("archive").applyInPandas(packed, "path string, content binary"))
    records = archives.archive_records(zipped, ["ORDERS.tsv"])
    rows = archives.member_table(records, "ORDERS.tsv", ["ORDERKEY", "NOTE", "STATUS"])
    return rows.groupBy("source_archive_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("ORDERKEY").cast("long")).alias("key_sum"),
        F.count(F.when(F.col("STATUS") == "O", F.lit(1))).alias("open_orders"), F.sum(F.length("NOTE").cast("long")).alias("note_length"),
    )


@case(
    "q5_schema_drift",
    """WITH c AS (SELECT table_name AS source, column_name, column_index FROM duckdb_columns() WHERE table_name IN ('orders', 'lineitem', 'events')),
    s AS (SELECT source, string_agg(column_name, ',' ORDER BY column_index) AS signature FROM c GROUP BY 1)
    SELECT 'facts' AS table_name, (SELECT count(*) FROM s) AS sources, (SELECT count(DISTINCT signature) FROM s) AS distinct_signatures,
        (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (SELECT column_name FROM c GROUP BY 1 HAVING count(*) < 3)) AS partial_columns""",
)
def _(spark, sf):
    schemas = {(name, "facts"): R.table(spark, sf, name).columns for name in ("orders", "lineitem", "events")}
    drift = ct.schema_drift(ct.schema_signatures(schemas, spark))
    return drift.withColumn("partial_columns", F.array_join("partial_columns", ","))


@case(
    "f5_tagged_files",
    "SELECT 'A' || (o_orderkey % 3) AS source_archive_id, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1",
)
def _(spark, sf):
    base = scratch_path(spark, "tagged")
    R.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("part")).write.partitionBy("part").parquet(base)
    sources = {f"A{i}": f"{base}/part={i}" for i in range(3)}
    return src.read_tagged_parquet(spark, sources, ["o_orderkey"]).groupBy("source_archive_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("key_sum")
    )


@case(
    "f7_typed_csv_to_parquet",
    "SELECT permno, day, volume, ret FROM daily",
    uses="daily", doubles="volume ret",
)
def _(spark, sf):
    text, table = scratch_path(spark, "csv"), scratch_path(spark, "typed")
    R.daily(spark, sf).select("permno", "day", "volume", "ret").write.option("header", True).csv(text)
    schema = T.StructType(
        [T.StructField("permno", T.IntegerType()), T.StructField("day", T.DateType()),
         T.StructField("volume", T.DoubleType()), T.StructField("ret", T.DoubleType())]
    )
    src.write_sorted(src.read_typed_csv(spark, text, schema), table, ["permno", "day"])
    return spark.read.parquet(table)


@case(
    "f8_factor_text",
    """SELECT day AS date, smb / 100 AS smb, momentum / 100 AS momentum FROM factors WHERE day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
    uses="factors", doubles="smb momentum", digits=8,
)
def _(spark, sf):
    base = R.factors(spark, sf)
    day = F.date_format("day", "yyyyMMdd")
    files = {}
    for name in ("smb", "momentum"):
        files[name] = scratch_path(spark, name)
        body = base.select(F.concat_ws(",", day, F.col(name).cast("string")).alias("value"))
        preamble = body.limit(1).select(F.explode(F.array(F.lit("Created from data"), F.lit(f",{name}"), F.lit("Annual 1999,1"))).alias("value"))
        preamble.unionByName(body).write.text(files[name])
    first = src.read_factor_text(spark, files["smb"], ["smb"])
    second = src.read_factor_text(spark, files["momentum"], ["momentum"])
    return src.combine_factors(first, second, "1996-01-01", "1999-12-31", ["smb", "momentum"])


@case(
    "f9_sorted_sink", "SELECT report_period, manager, permno, position_value FROM holdings", uses="holdings"
)
def _(spark, sf):
    path = scratch_path(spark, "sorted")
    rows = R.positions(spark, sf).select("report_period", "manager", "permno", "position_value")
    src.write_sorted(rows, path, ["report_period", "manager", "permno"])
    return spark.read.parquet(path)


@case(
    "f10_partitioned_sink",
    "SELECT report_period, count(*) AS rows, CAST(sum(position_value) AS BIGINT) AS value FROM holdings GROUP BY 1",
    uses="holdings",
)
def _(spark, sf):
    path = scratch_path(spark, "quarters")
    rows = R.positions(spark, sf).select("report_period", "manager", "permno", "position_value")
    src.write_sorted(rows, path, ["report_period", "manager", "permno"], partition_by=["report_period"])
    stored = spark.read.parquet(path)
    return stored.groupBy("report_period").agg(F.count(F.lit(1)).alias("rows"), F.sum("position_value").alias("value"))


@case(
    "f11_small_csv_sink",
    "SELECT CAST(report_period AS VARCHAR) AS report_period, CAST(count(*) AS VARCHAR) AS rows FROM holdings GROUP BY 1",
    uses="holdings",
)
def _(spark, sf):
    path = scratch_path(spark, "report")
    counts = R.positions(spark, sf).groupBy("report_period").agg(F.count(F.lit(1)).alias("rows"))
    src.write_small_csv(counts, path)
    return spark.read.option("header", True).csv(path)


@case(
    "f12_manifest_check",
    "SELECT state, 1::BIGINT AS files, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS folders FROM (VALUES ('changed'), ('missing'), ('unexpected')) s(state)",
)
def _(spark, sf):
    path = scratch_path(spark, "landed")
    R.table(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(path)
    digests = src.file_digests(spark, path).where(F.col("file_name").endswith(".parquet"))
    digests = cut_lineage(digests)
    # A manifest in which one file has another digest, one is not listed and one is listed that is not there.
    names = digests.agg(F.min("file_name").alias("first"), F.max("file_name").alias("last"))
    marked = digests.join(names)
    manifest = marked.where("file_name != last").select(
        "file_name", F.when(F.col("file_name") == F.col("first"), "altered").otherwise(F.col("digest")).alias("digest")
    ).unionByName(names.select(F.lit("nowhere.parquet").alias("file_name"), F.lit("none").alias("digest")))
    folders = spark.read.parquet(path).agg(F.count_distinct("o_orderstatus").alias("n")).scalar()
    return src.manifest_differences(digests, manifest).groupBy("state").agg(F.count(F.lit(1)).alias("files")).select(
        "state", "files", folders.alias("folders")
    )


@case(
    "f13_universe_fingerprint",
    """SELECT CAST(sum(n) AS BIGINT) AS entities, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest FROM (
        SELECT substring(sha256(id), 1, 2) AS part, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest
        FROM (SELECT DISTINCT CAST(permno AS VARCHAR) AS id FROM lines) GROUP BY 1)""",
    uses="lines",
)
def _(spark, sf):
    return ct.universe_fingerprint(R.lines(spark, sf), "permno")


@case(
    "f14_pruned_scan",
    "SELECT l_suppkey, count(*) AS rows FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-04-01' GROUP BY 1",
)
def _(spark, sf):
    item = R.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate")
    one = item.where((F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1999-04-01").cast("timestamp_ntz")))
    return one.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------ projections
@case(
    "p10_quarter_distance",
    "SELECT l_orderkey, date_diff('quarter', DATE '1995-02-15', l_shipdate) AS quarters, count(*) AS rows FROM lineitem GROUP BY ALL",
)
def _(spark, sf):
    gap = dates.quarters_between(F.lit("1995-02-15").cast("date"), F.to_date("l_shipdate")).cast("bigint")
    return R.table(spark, sf, "lineitem").groupBy("l_orderkey", gap.alias("quarters")).agg(F.count(F.lit(1)).alias("rows"))


@case(
    "p11_clamp",
    "SELECT permno, day, least(ret, 0.0) AS negative_part, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.02), 0.02) END AS clipped FROM daily",
    uses="daily", doubles="negative_part clipped",
)
def _(spark, sf):
    return R.daily(spark, sf).select(
        "permno", "day", F.least("ret", F.lit(0.0)).alias("negative_part"), scalars.clip(F.col("ret"), -0.02, 0.02).alias("clipped")
    )


@case(
    "p12_math",
    "SELECT permno, day, pow(price, 2) AS squared, sqrt(volume) AS root, ln(cap) AS log_cap, ln(1 + volume) AS log1p_volume, abs(ret) AS absolute, floor(price) AS low, ceil(price) AS high FROM daily",
    uses="daily", doubles="squared root log_cap log1p_volume absolute low high", digits=4,
)
def _(spark, sf):
    return R.daily(spark, sf).select(
        "permno", "day", F.pow("price", F.lit(2.0)).alias("squared"), F.sqrt("volume").alias("root"), F.ln("cap").alias("log_cap"),
        F.log1p("volume").alias("log1p_volume"), F.abs("ret").alias("absolute"), F.floor("price").alias("low"), F.ceil("price").alias("high"),
    )


@case(
    "p13_null_safe_difference",
    "SELECT count(*) FILTER (WHERE ret IS DISTINCT FROM pr) AS changes, count(*) AS rows FROM (SELECT ret, lag(ret) OVER (PARTITION BY permno ORDER BY day) AS pr FROM daily)",
    uses="daily",
)
def _(spark, sf):
    history = Window.partitionBy("permno").orderBy("day")
    rows = R.daily(spark, sf).select("ret", F.lag("ret").over(history).alias("pr"))
    return rows.agg(ag.count_where(scalars.differs(F.col("ret"), F.col("pr"))).alias("changes"), F.count(F.lit(1)).alias("rows"))


@case(
    "p14_finite_values",
    "SELECT count(*) FILTER (WHERE isfinite(v)) AS finite_rows, count(*) AS rows FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN l_partkey % 7 = 1 THEN CAST('inf' AS DOUBLE) WHEN l_partkey % 7 = 2 THEN NULL ELSE l_extendedprice END AS v FROM lineitem)",
)
def _(spark, sf):
    k = F.col("l_partkey") % 7
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, None).otherwise(F.col("l_extendedprice"))
    return R.table(spark, sf, "lineitem").select(v.alias("v")).agg(
        ag.count_where(scalars.is_finite(F.col("v"))).alias("finite_rows"), F.count(F.lit(1)).alias("rows")
    )


BANDS = ("up to 10", "10 to 25", "25 to 45", "45 to 60", "above 60")


@case(
    "p15_labelled_bands",
    """SELECT label, count(l_quantity) AS rows FROM (VALUES ('up to 10'), ('10 to 25'), ('25 to 45'), ('45 to 60'), ('above 60')) b(label)
    LEFT JOIN lineitem ON label = CASE WHEN l_quantity <= 10 THEN 'up to 10' WHEN l_quantity <= 25 THEN '10 to 25' WHEN l_quantity <= 45 THEN '25 to 45' WHEN l_quantity <= 60 THEN '45 to 60' ELSE 'above 60' END GROUP BY label""",
)
def _(spark, sf):
    item = R.table(spark, sf, "lineitem")
    counts = item.groupBy(scalars.band_label(F.col("l_quantity"), (10, 25, 45, 60), BANDS).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labels = spark.createDataFrame([(b,) for b in BANDS], "label string")
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("rows"))


@case("p16_loss_magnitude", "SELECT permno, day, CASE WHEN ret IS NOT NULL THEN greatest(0.0, -ret) END AS loss FROM daily", uses="daily", doubles="loss")
def _(spark, sf):
    return R.daily(spark, sf).select("permno", "day", scalars.loss_magnitude(F.col("ret")).alias("loss"))


@case(
    "p18_text_labels",
    "SELECT year(report_period) || ' Q' || quarter(report_period) AS quarter_text, 'security ' || permno || ' held' AS label, count(*) AS holders FROM holdings GROUP BY ALL",
    uses="holdings",
)
def _(spark, sf):
    return R.positions(spark, sf).groupBy(
        dates.quarter_label(F.col("report_period")).alias("quarter_text"),
        scalars.label_with_number("security ", F.col("permno"), " held").alias("label"),
    ).agg(F.count(F.lit(1)).alias("holders"))


# ------------------------------------------------------------------ joins
@case(
    "j1_one_to_one_join",
    "SELECT report_period, permno, institutional_holder_count, return_observations_252d FROM securities JOIN features USING (report_period, permno)",
    uses="securities features",
)
def _(spark, sf):
    from workload.composites import features

    nodes = cut_lineage(R.positions(spark, sf).groupBy("report_period", "permno").agg(F.count_distinct("manager").alias("institutional_holder_count")))
    feats = cut_lineage(features(spark, sf).select("report_period", "permno", "return_observations_252d"))
    return jn.one_to_one_join(nodes, feats, ["report_period", "permno"])


@case(
    "j5_asof_backward",
    "SELECT q.information_date, max(c.day) AS day FROM (SELECT DISTINCT information_date FROM holdings) q LEFT JOIN calendar c ON c.day < q.information_date GROUP BY 1",
    uses="holdings calendar",
)
def _(spark, sf):
    asked = R.positions(spark, sf).select("information_date")
    return jn.asof_calendar(asked, jn.market_calendar(R.market(spark, sf)), "information_date", "backward").drop("market_day")


@case(
    "j6_asof_forward",
    "SELECT q.information_date, min(c.day) AS day FROM (SELECT DISTINCT information_date FROM holdings) q LEFT JOIN calendar c ON c.day > q.information_date GROUP BY 1",
    uses="holdings calendar",
)
def _(spark, sf):
    asked = R.positions(spark, sf).select("information_date")
    return jn.asof_calendar(asked, jn.market_calendar(R.market(spark, sf)), "information_date", "forward").drop("market_day")


@case(
    "j7_calendar_offset",
    "SELECT information_date, min(feature_window_start) AS feature_window_start, min(feature_window_end) AS feature_window_end FROM fwindows GROUP BY 1",
    uses="fwindows",
)
def _(spark, sf):
    from quarterdeck.plans.market import feature_windows

    asked = R.positions(spark, sf).select("information_date").distinct()
    return feature_windows(asked, R.market(spark, sf)).drop("feature_window_end_index")


@case(
    "j8_window_expansion",
    "SELECT w.report_period, w.permno, count(*) AS days, min(d.day) AS first_day, max(d.day) AS last_day FROM fwindows w JOIN daily d ON d.permno = w.permno AND d.day BETWEEN w.feature_window_start AND w.feature_window_end GROUP BY ALL",
    uses="fwindows daily",
)
def _(spark, sf):
    from quarterdeck.plans.market import feature_windows

    windows = feature_windows(predictions(spark, sf), R.market(spark, sf))
    rows = jn.interval_join(windows, R.daily(spark, sf).select("permno", "day"), ["permno"], "feature_window_start", "feature_window_end", "day")
    return rows.groupBy("report_period", "permno").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@case(
    "j9_horizon_fan_out",
    "SELECT information_date, horizon_market_days, count(*) AS rows, min(target_window_start) AS target_window_start, min(target_window_end) AS target_window_end FROM alt_targets GROUP BY ALL",
    uses="alt_targets",
)
def _(spark, sf):
    from quarterdeck.plans.market import target_windows

    windows = target_windows(predictions(spark, sf), R.market(spark, sf), ((21, 2), (126, 10)))
    return windows.groupBy("information_date", "horizon_market_days").agg(
        F.count(F.lit(1)).alias("rows"), F.min("target_window_start").alias("target_window_start"), F.min("target_window_end").alias("target_window_end")
    )


@case(
    "j10_composite_key_joins",
    "SELECT s.report_period, s.permno, s.institutional_holder_count, d.managers, m.n AS lines FROM securities s JOIN density d USING (report_period) JOIN (SELECT report_period, permno, count(*) AS n FROM lines GROUP BY ALL) m USING (report_period, permno)",
    uses="securities density lines",
)
def _(spark, sf):
    h = R.positions(spark, sf)
    nodes = h.groupBy("report_period", "permno").agg(F.count_distinct("manager").alias("institutional_holder_count"))
    lines = R.lines(spark, sf).groupBy("report_period", "permno").agg(F.count(F.lit(1)).alias("lines"))
    return nodes.join(nw.network_density(h).select("report_period", "managers"), "report_period").join(lines, ["report_period", "permno"])


@case(
    "j11_reconciliation",
    """SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matched_rows, count(*) FILTER (WHERE b.k IS NULL) AS left_only_rows, count(*) FILTER (WHERE a.k IS NULL) AS right_only_rows,
        count(*) FILTER (WHERE abs(a.v - b.v) > 0.5) AS v_differences
    FROM (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) b USING (k)""",
)
def _(spark, sf):
    o = R.table(spark, sf, "orders")

    def side(test):
        return o.where(test).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))

    return jn.reconcile(side("o_orderstatus <> 'P'"), side("o_orderpriority <> '5-LOW'"), ["k"], ["v"], 0.5)


@case("j12_anti_join", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def _(spark, sf):
    parents = R.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return jn.orphans(R.table(spark, sf, "customer").select("c_custkey"), parents, ["c_custkey"])


@case("j13_semi_join", "SELECT permno, count(*) AS days, sum(volume) AS volume FROM daily WHERE permno IN (SELECT permno FROM lines WHERE qty >= 50 AND disc = 10 AND tax = 8) GROUP BY 1", uses="daily lines")
def _(spark, sf):
    members = R.lines(spark, sf).where((F.col("qty") >= 50) & (F.col("disc") == 10) & (F.col("tax") == 8))
    return jn.restrict_to_members(R.daily(spark, sf), members, ["permno"]).groupBy("permno").agg(
        F.count(F.lit(1)).alias("days"), F.sum("volume").alias("volume")
    )


@case(
    "j15_membership_sides",
    "SELECT coalesce(a.partkey, b.partkey) AS partkey, CASE WHEN a.partkey IS NULL THEN 'right_only' WHEN b.partkey IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT partkey FROM lines WHERE disc >= 10) a FULL JOIN (SELECT DISTINCT partkey FROM lines WHERE qty >= 48) b ON a.partkey = b.partkey",
    uses="lines",
)
def _(spark, sf):
    x = R.lines(spark, sf)
    return jn.membership_sides(x.where("disc >= 10"), x.where("qty >= 48"), ["partkey"])


@case(
    "j16_rows_around_dates",
    "SELECT information_date, (SELECT count(*) FROM calendar c WHERE c.day < q.information_date) AS days_before, (SELECT count(*) FROM calendar c WHERE c.day > q.information_date) AS days_after FROM (SELECT DISTINCT information_date FROM holdings) q",
    uses="holdings calendar",
)
def _(spark, sf):
    return jn.rows_around_dates(R.market(spark, sf), "day", R.positions(spark, sf), "information_date")


# ------------------------------------------------------------------ aggregations
@case("g1_group_sum_count", "SELECT report_period, manager, permno, CAST(sum(cents) AS BIGINT) AS value, count(*) AS rows FROM lines GROUP BY ALL", uses="lines")
def _(spark, sf):
    return R.lines(spark, sf).groupBy("report_period", "manager", "permno").agg(F.sum("cents").alias("value"), F.count(F.lit(1)).alias("rows"))


@case(
    "g4_largest_row_labels",
    "SELECT report_period, permno, first(manager ORDER BY position_value DESC, manager) AS manager, first(CASE WHEN manager % 3 <> 0 THEN manager END ORDER BY position_value DESC, manager) FILTER (WHERE manager % 3 <> 0) AS other FROM holdings GROUP BY ALL",
    uses="holdings",
)
def _(spark, sf):
    h = R.positions(spark, sf).withColumn("other", F.when(F.col("manager") % 3 != 0, F.col("manager")))
    rows = h.withColumn("m", F.col("manager"))
    return rows.groupBy("report_period", "permno").agg(*ag.largest_row(["manager", "other"], F.col("position_value"), F.col("m")))


@case("g6_distinct_tuples", "SELECT report_period, count(DISTINCT manager) AS managers, count(DISTINCT (manager, permno)) AS pairs, count(DISTINCT permno) FILTER (WHERE flag = 'R') AS returned FROM lines GROUP BY 1", uses="lines")
def _(spark, sf):
    return R.lines(spark, sf).groupBy("report_period").agg(
        F.count_distinct("manager").alias("managers"), F.count_distinct(F.struct("manager", "permno")).alias("pairs"),
        ag.distinct_where(F.col("flag") == "R", F.col("permno")).alias("returned"),
    )


@case("g8_concentration", "SELECT report_period, manager, sum(portfolio_weight * portfolio_weight) AS hhi, max(portfolio_weight) AS largest_share FROM holdings GROUP BY ALL", uses="holdings", doubles="hhi largest_share")
def _(spark, sf):
    return oa.concentration(R.holdings(spark, sf), ["report_period", "manager"], "portfolio_weight")


@case("g9_top_five_share", "SELECT report_period, manager, sum(portfolio_weight) AS top_share FROM (SELECT *, row_number() OVER (PARTITION BY report_period, manager ORDER BY portfolio_weight DESC, permno) AS rk FROM holdings) WHERE rk <= 5 GROUP BY ALL", uses="holdings", doubles="top_share")
def _(spark, sf):
    return oa.top_share(R.holdings(spark, sf), ["report_period", "manager"], "portfolio_weight", "permno", 5)


@case("g10_compounded_returns", "SELECT permno, product(1.0 + ret) - 1.0 AS all_days, product(1.0 + ret) FILTER (WHERE volume > 30) - 1.0 AS busy_days FROM daily GROUP BY 1", uses="daily", doubles="all_days busy_days")
def _(spark, sf):
    return R.daily(spark, sf).groupBy("permno").agg(
        ag.compounded(F.col("ret")).alias("all_days"), ag.compounded(F.when(F.col("volume") > 30, F.col("ret"))).alias("busy_days")
    )


@case(
    "g11_trailing_statistics",
    "SELECT report_period, permno, return_observations_21d, return_observations_63d, return_21d, momentum_252_21d, average_daily_dollar_volume_63d FROM features",
    uses="features", doubles="return_21d momentum_252_21d average_daily_dollar_volume_63d",
)
def _(spark, sf):
    from workload.composites import features

    return features(spark, sf).select(
        "report_period", "permno", "return_observations_21d", "return_observations_63d", "return_21d", "momentum_252_21d", "average_daily_dollar_volume_63d"
    )


@case("g12_market_beta", "SELECT permno, CASE WHEN isnan(b) THEN NULL ELSE b END AS beta FROM (SELECT permno, regr_slope(ret, market_return) AS b FROM daily JOIN market USING (day) GROUP BY 1)", uses="daily market", doubles="beta")
def _(spark, sf):
    return R.daily(spark, sf).join(R.market(spark, sf), "day").groupBy("permno").agg(F.regr_slope("ret", "market_return").alias("beta"))


@case("g13_deviations", "SELECT permno, stddev_samp(ret) * sqrt(252.0) AS sample_deviation, stddev_pop(ret) AS population_deviation FROM daily GROUP BY 1", uses="daily", doubles="sample_deviation population_deviation")
def _(spark, sf):
    return R.daily(spark, sf).groupBy("permno").agg(
        ag.annualized_deviation(F.col("ret")).alias("sample_deviation"), F.stddev_pop("ret").alias("population_deviation")
    )


@case("g14_exact_quantiles", "SELECT flag, median(cents) AS median_value, quantile_cont(cents, 0.01) AS p01, quantile_cont(cents, 0.9) AS p90 FROM lines GROUP BY 1", uses="lines", doubles="median_value p01 p90", digits=4)
def _(spark, sf):
    return order.exact_quantiles(R.lines(spark, sf), ["flag"], "cents", {"median_value": 0.5, "p01": 0.01, "p90": 0.9})


PROFILE = "missing_share mean deviation minimum maximum skewness p01 p25 median p75 p99"


@case(
    "g21_numeric_profile",
    "\nUNION ALL ".join(
        f"SELECT sample_split, '{c}' AS feature, count(*) AS rows, count({c}) AS observations, avg(CAST({c} IS NULL AS DOUBLE)) AS missing_share, avg({c}) AS mean, stddev_samp({c}) AS deviation, min({c}) AS minimum, max({c}) AS maximum, skewness({c}) AS skewness, "
        f"quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.25) AS p25, median({c}) AS median, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.99) AS p99, count(DISTINCT {c}) AS distinct_values FROM sample GROUP BY 1"
        for c in ("f_size", "f_tax", "f_sparse")
    ),
    uses="sample", doubles=PROFILE,
)
def _(spark, sf):
    return oa.numeric_profile(R.sample(spark, sf), ["f_size", "f_tax", "f_sparse"], ["sample_split"])


@case(
    "g22_missing_share_pivot",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + ", ".join(f"avg(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE sample_split = '{s}') AS {s}" for s in ("train", "validation", "test")) + f", avg(CAST({c} IS NULL AS DOUBLE)) AS all_rows FROM sample"
        for c in ("f_sparse", "f_tax")
    ),
    uses="sample", doubles="train validation test all_rows",
)
def _(spark, sf):
    return oa.missing_share_pivot(R.sample(spark, sf), ["f_sparse", "f_tax"], "sample_split", ["train", "validation", "test"])


@case(
    "g23_flag_crosstab",
    "SELECT coalesce(event_type, 'missing') AS event_type, CASE WHEN user_id % 10 = 0 THEN 'missing' ELSE CAST(user_id % 3 AS VARCHAR) END AS segment, count(*) AS rows FROM events GROUP BY ALL",
)
def _(spark, sf):
    segment = F.when(F.col("user_id") % 10 != 0, (F.col("user_id") % 3).cast("string"))
    rows = R.table(spark, sf, "events").select("event_type", segment.alias("segment"))
    return rows.groupBy(F.coalesce("event_type", F.lit("missing")).alias("event_type"), F.coalesce("segment", F.lit("missing")).alias("segment")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@case(
    "g25_variation_across_periods",
    "SELECT quantile_cont(q3 - q1, 0.5) AS median_iqr, min(q3 - q1) AS minimum_iqr, min(n) AS smallest_period FROM (SELECT report_period, quantile_cont(target, 0.75) AS q3, quantile_cont(target, 0.25) AS q1, count(*) AS n FROM sample GROUP BY 1)",
    uses="sample", doubles="median_iqr minimum_iqr",
)
def _(spark, sf):
    sample = R.sample(spark, sf).select("report_period", "target")
    spread = order.exact_quantiles(sample, ["report_period"], "target", {"q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    middle = order.exact_quantiles(spread, [], "iqr", {"m": 0.5}).scalar()
    smallest = sample.groupBy("report_period").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).scalar()
    return spread.agg(F.min("iqr").alias("minimum_iqr")).select("minimum_iqr", middle.alias("median_iqr"), smallest.alias("smallest_period"))


@case(
    "g26_outcome_distributions",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS observations, avg({c}) AS mean, stddev_samp({c}) AS deviation, quantile_cont({c}, 0.01) AS p01, median({c}) AS median, quantile_cont({c}, 0.99) AS p99, skewness({c}) AS skewness FROM sample"
        for c in ("target", "outcome_volatility", "outcome_return")
    ),
    uses="sample", doubles="mean deviation p01 median p99 skewness",
)
def _(spark, sf):
    profile = oa.numeric_profile(R.sample(spark, sf), ["target", "outcome_volatility", "outcome_return"])
    return profile.select("feature", "observations", "mean", "deviation", "p01", "median", "p99", "skewness")


@case("g27_histogram", "SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(c.rows, 0) AS rows, coalesce(c.rows, 0) / CAST(sum(c.rows) OVER () AS DOUBLE) AS weight FROM range(17) r(bin) LEFT JOIN (SELECT CAST(least(floor((l_quantity - 0) / (51.0 / 17)), 16) AS INTEGER) AS bin, count(*) AS rows FROM lineitem WHERE l_quantity BETWEEN 0 AND 51 GROUP BY 1) c ON c.bin = r.bin", doubles="weight")
def _(spark, sf):
    return oa.histogram(R.table(spark, sf, "lineitem"), "l_quantity", 17, 0.0, 51.0)


@case("g27_geometric_histogram", "SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(c.rows, 0) AS rows, coalesce(c.rows, 0) / CAST(sum(c.rows) OVER () AS DOUBLE) AS weight FROM range(20) r(bin) LEFT JOIN (SELECT CAST(least(floor((ln(l_extendedprice) - ln(100.0)) / ((ln(200000.0) - ln(100.0)) / 20)), 19) AS INTEGER) AS bin, count(*) AS rows FROM lineitem WHERE l_extendedprice BETWEEN 100 AND 200000 GROUP BY 1) c ON c.bin = r.bin", doubles="weight")
def _(spark, sf):
    return oa.histogram(R.table(spark, sf, "lineitem"), "l_extendedprice", 20, 100.0, 200000.0, geometric=True)


@case(
    "g28_pivot_difference",
    "SELECT report_period, avg(disc) FILTER (WHERE flag = 'A') AS a, avg(disc) FILTER (WHERE flag = 'R') AS r, avg(disc) FILTER (WHERE flag = 'A') - avg(disc) FILTER (WHERE flag = 'R') AS effect FROM lines GROUP BY 1",
    uses="lines", doubles="a r effect",
)
def _(spark, sf):
    wide = R.lines(spark, sf).groupBy("report_period").pivot("flag", ["A", "R"]).agg(F.avg("disc"))
    return wide.select("report_period", F.col("A").alias("a"), F.col("R").alias("r"), (F.col("A") - F.col("R")).alias("effect"))


@case("g29_mean_of_group_means", "SELECT flag, count(*) AS groups, avg(d) AS mean_disc, avg(q) AS mean_qty FROM (SELECT flag, report_period, avg(disc) AS d, avg(qty) AS q FROM lines GROUP BY ALL) GROUP BY flag", uses="lines", doubles="mean_disc mean_qty")
def _(spark, sf):
    return oa.mean_of_group_means(R.lines(spark, sf), ["flag"], ["report_period"], ["disc", "qty"])


# ------------------------------------------------------------------ windows
@case("w4_calendar_numbers", "SELECT day, CAST(market_day AS INTEGER) AS market_day FROM calendar", uses="calendar")
def _(spark, sf):
    return jn.market_calendar(R.market(spark, sf))


@case(
    "w5_w6_wealth_and_drawdown",
    """SELECT permno, day, wealth, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY permno ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS drawdown FROM (
        SELECT permno, day, product(1.0 + ret) OVER (PARTITION BY permno ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM daily)""",
    uses="daily", doubles="wealth drawdown",
)
def _(spark, sf):
    window = Window.partitionBy("permno").orderBy("day")
    rows = R.daily(spark, sf).select("permno", "day", paths.wealth(F.col("ret"), window).alias("wealth"))
    return rows.withColumn("drawdown", paths.drawdown(F.col("wealth"), window))


@case(
    "w7_rolling_five_rows",
    "SELECT permno, min(r5) FILTER (WHERE n >= 5) AS worst FROM (SELECT permno, row_number() OVER w AS n, product(1.0 + ret) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1.0 AS r5 FROM daily WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY permno ORDER BY day)) GROUP BY 1",
    uses="daily", doubles="worst",
)
def _(spark, sf):
    window = Window.partitionBy("permno").orderBy("day")
    rows = R.daily(spark, sf).where(F.col("ret").isNotNull()).select(
        "permno", F.row_number().over(window).alias("n"), paths.rolling_return(F.col("ret"), window, 5).alias("r5")
    )
    return rows.groupBy("permno").agg(F.min(F.when(F.col("n") >= 5, F.col("r5"))).alias("worst"))


@case("w8_lagged_measures", "SELECT report_period, permno, lag(n) OVER w AS previous_holders, lag(v) OVER w AS previous_value FROM (SELECT report_period, permno, count(*) AS n, CAST(sum(position_value) AS BIGINT) AS v FROM holdings GROUP BY ALL) WINDOW w AS (PARTITION BY permno ORDER BY report_period)", uses="holdings")
def _(spark, sf):
    history = Window.partitionBy("permno").orderBy("report_period")
    nodes = R.positions(spark, sf).groupBy("report_period", "permno").agg(F.count(F.lit(1)).alias("n"), F.sum("position_value").alias("v"))
    return nodes.select("report_period", "permno", F.lag("n").over(history).alias("previous_holders"), F.lag("v").over(history).alias("previous_value"))


# ------------------------------------------------------------------ sorts, samples, sets
@case("t1_total_order", "SELECT report_period, permno, count(*) AS holders FROM holdings GROUP BY ALL ORDER BY report_period, permno", uses="holdings")
def _(spark, sf):
    return R.positions(spark, sf).groupBy("report_period", "permno").agg(F.count(F.lit(1)).alias("holders")).orderBy("report_period", "permno")


@case("t2_top_n", "SELECT report_period, manager, permno, position_value FROM holdings ORDER BY position_value DESC, report_period, manager, permno LIMIT 12", uses="holdings")
def _(spark, sf):
    return R.positions(spark, sf).select("report_period", "manager", "permno", "position_value").orderBy(
        F.col("position_value").desc(), "report_period", "manager", "permno"
    ).limit(12)


@case(
    "t3_embedding_neighbors",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS i FROM embeddings),
    n AS (SELECT vec_id, sqrt(sum(w * w)) AS n FROM e GROUP BY 1),
    s AS (SELECT a.vec_id AS source, b.vec_id AS target, least(round(sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)), 9), 1.0) AS sim
          FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id JOIN n na ON na.vec_id = a.vec_id JOIN n nb ON nb.vec_id = b.vec_id GROUP BY 1, 2)
    SELECT source, target, CAST(rk AS INTEGER) AS neighbor_rank, sim AS cosine_similarity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rk FROM s WHERE sim > 0) WHERE rk <= 10""",
    doubles="cosine_similarity",
)
def _(spark, sf):
    from quarterdeck.operators.graph import cosine_neighbors

    long = R.table(spark, sf, "embeddings").select(F.lit(1).alias("g"), "vec_id", F.posexplode("embedding").alias("i", "w"))
    return cosine_neighbors(long, "g", "vec_id", "i", "w", 10, digits=9).drop("g")


@case(
    "t4_stratified_sample",
    "SELECT report_period, CAST(least(count(*), 5) AS BIGINT) AS rows FROM sample GROUP BY 1",
    uses="sample",
)
def _(spark, sf):
    from quarterdeck.operators.sampling import stratified_sample

    drawn = stratified_sample(R.sample(spark, sf), ["report_period"], ["permno"], 5, seed=13)
    return drawn.groupBy("report_period").agg(F.count(F.lit(1)).alias("rows"))


@case(
    "u1_union_with_labels",
    "SELECT 'orders' AS stage, count(*) AS rows FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'customers', count(*) FROM customer",
)
def _(spark, sf):
    parts = [
        R.table(spark, sf, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(label).alias("stage"), "rows")
        for label, t in (("orders", "orders"), ("lines", "lineitem"), ("customers", "customer"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("u2_endpoint_union", "SELECT report_period, manager AS node FROM holdings UNION SELECT report_period, CAST(permno AS BIGINT) FROM holdings", uses="holdings")
def _(spark, sf):
    from quarterdeck.operators.graph import endpoints

    rows = R.positions(spark, sf).select("report_period", "manager", F.col("permno").cast("bigint").alias("permno"))
    return endpoints(rows, ["report_period"], "manager", "permno").distinct()


@case("u3_distinct_keys", "SELECT DISTINCT report_period, information_date, permno FROM holdings", uses="holdings")
def _(spark, sf):
    return predictions(spark, sf)


@case("u4_symmetric_difference", "SELECT partkey, CASE WHEN a THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT partkey, bool_or(disc >= 10) AS a, bool_or(qty >= 48) AS b FROM lines GROUP BY 1) WHERE a <> b", uses="lines")
def _(spark, sf):
    x = R.lines(spark, sf)
    return jn.symmetric_difference(x.where("disc >= 10"), x.where("qty >= 48"), ["partkey"])


@case(
    "u5_consecutive_intersection",
    "SELECT a.report_period, a.manager FROM (SELECT DISTINCT report_period, manager FROM holdings) a SEMI JOIN (SELECT DISTINCT CAST(last_day(report_period + INTERVAL 3 MONTH) AS DATE) AS report_period, manager FROM holdings) b ON a.report_period = b.report_period AND a.manager = b.manager",
    uses="holdings",
)
def _(spark, sf):
    members = R.positions(spark, sf).select("report_period", "manager").distinct()
    earlier = members.select(F.last_day(F.add_months("report_period", 3)).alias("report_period"), "manager")
    return members.intersect(earlier)


# ------------------------------------------------------------------ audits
@case(
    "q1_key_audit",
    "SELECT count(*) AS rows, 0::BIGINT AS null_key_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem",
)
def _(spark, sf):
    return ct.key_audit(R.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@case(
    "q2_orphan_counts",
    "SELECT 'lineitem' AS child_table, count(*) AS orphan_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
)
def _(spark, sf):
    parents = R.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    item = R.table(spark, sf, "lineitem")
    return jn.orphan_counts(parents, {"lineitem": item, "returned": item.where("l_returnflag = 'R'")}, ["l_orderkey"])


@case(
    "q3_duplicate_audit",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT (o, l)) AS distinct_candidate_keys, CAST(sum(n) AS BIGINT) - count(DISTINCT (o, l)) AS candidate_key_repeats, CAST(sum(n - 1) AS BIGINT) AS exact_row_repeats FROM (SELECT l_orderkey AS o, l_linenumber AS l, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def _(spark, sf):
    rows = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return ct.duplicate_audit(rows, ["l_orderkey", "l_linenumber"])


@case("q4_required_nulls", "SELECT 'f_sparse' AS field, count(*) AS rows, count(*) - count(f_sparse) AS null_rows FROM sample UNION ALL SELECT 'f_tax', count(*), count(*) - count(f_tax) FROM sample", uses="sample")
def _(spark, sf):
    return ct.null_counts(R.sample(spark, sf), ["f_sparse", "f_tax"])


@case(
    "q6_table_inventory",
    "SELECT 'daily' AS table_name, count(*) AS rows, count(DISTINCT permno) AS identifiers, count(DISTINCT day) AS dates, min(day) AS first_day, max(day) AS last_day FROM daily UNION ALL SELECT 'market', count(*), NULL, count(DISTINCT day), min(day), max(day) FROM market",
    uses="daily market",
)
def _(spark, sf):
    return ct.inventory({"daily": (R.daily(spark, sf), "permno", "day"), "market": (R.market(spark, sf), None, "day")})


@case(
    "q7_domain_checks",
    "SELECT unnest(['missing_return', 'return_below_minus_one', 'negative_volume', 'halted', 'delisted', 'no_price']) AS rule, unnest([count(*) FILTER (WHERE ret IS NULL), count(*) FILTER (WHERE ret < -1), count(*) FILTER (WHERE volume < 0), count(*) FILTER (WHERE trading_status = 'H'), count(*) FILTER (WHERE delisting_flag = 'Y'), count(*) FILTER (WHERE price IS NULL)]) AS rows FROM daily",
    uses="daily",
)
def _(spark, sf):
    return ct.rule_counts(
        R.daily(spark, sf),
        {
            "missing_return": F.col("ret").isNull(), "return_below_minus_one": F.col("ret") < -1, "negative_volume": F.col("volume") < 0,
            "halted": F.col("trading_status") == "H", "delisted": F.col("delisting_flag") == "Y", "no_price": F.col("price").isNull(),
        },
    )


@case(
    "q8_calendar_agreement",
    "SELECT count(*) FILTER (WHERE a.day IS NOT NULL AND b.day IS NOT NULL) AS matched_rows, count(*) FILTER (WHERE b.day IS NULL) AS left_only_rows, count(*) FILTER (WHERE a.day IS NULL) AS right_only_rows FROM (SELECT DISTINCT day FROM daily WHERE volume >= 100) a FULL JOIN (SELECT DISTINCT day FROM market) b ON a.day = b.day",
    uses="daily market",
)
def _(spark, sf):
    days = R.daily(spark, sf).where("volume >= 100").select("day").distinct()
    return jn.reconcile(days, R.market(spark, sf).select("day").distinct(), ["day"], [])
