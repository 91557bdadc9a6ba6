"""Contiguous shards of near-equal byte size from global prefix sums.

Rows are range-partitioned by id and stored with the number of their range. Each range's byte
total gives the range's offset (a running total over ranges, not rows); a running sum inside a
range then gives each row's place in the whole, and equal cuts of the grand total give shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.session import cut_lineage

ROW_OVERHEAD = 16


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, size in bytes and checksum of each text; a null text counts as empty."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def byte_shards(rows: DataFrame, shards: int = 40) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (place in the shard) to rows with a ``size``.

    Shards are contiguous in ``doc_id`` order (null ids first); a row goes where the middle of
    its bytes falls, so a shard misses its target by less than the largest row. Repeated ids
    and repeated rows keep one place each, in an order fixed when the rows are stored. If a
    single row is larger than a target, the shards it covers stay empty. Sizes must be positive.
    """
    # The row goes through whole, in one column, so that its columns may have any names.
    numbered = rows.select(F.struct(*rows.columns).alias("_doc"), "doc_id", "size", F.monotonically_increasing_id().alias("_tie"))
    ranged = numbered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_tie"))
    stored = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    totals = stored.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # One row per range: as many as there are shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = totals.select(
        "_range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"), F.sum("bytes").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "_tie")
    placed = stored.withColumns(
        {
            "_upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_place": F.row_number().over(inside) - 1,
        }
    ).join(offsets, "_range")
    # Twice the middle of the row's bytes, against twice the total: whole numbers only.
    twice = 2 * (F.col("_bytes") + F.col("_upto")) - F.col("size")
    scaled = F.expr(f"CAST(CAST(_twice AS DECIMAL(38,0)) * {shards} div (2 * _total) AS INT)")
    sharded = placed.withColumn("_twice", twice).withColumn("shard", F.least(scaled, F.lit(shards - 1))).withColumn(
        "_row", F.col("_rows") + F.col("_place")
    )
    sharded = cut_lineage(sharded.select("_doc", "shard", "_row"))
    starts = sharded.groupBy("shard").agg(F.min("_row").alias("_first"))
    return sharded.join(F.broadcast(starts), "shard").select(  # one row per shard
        "_doc.*", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
