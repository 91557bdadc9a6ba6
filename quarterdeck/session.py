"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_STORED_AT = "_quarterdeck_stored_at"
#: Spark's own setting that deletes the shuffle files of a statement when it ends.
_DROP_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "quarterdeck", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session with adaptive execution and UTC dates."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from the session's checkpoint setting.

    A machine-local folder is created only for a local master, where the single machine is
    the whole cluster; anywhere else the setting must be present.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or context.getConf().get(_CHECKPOINT_KEY)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a shared folder on a cluster.")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set(_CHECKPOINT_KEY, configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame, codec: str | None = None) -> DataFrame:
    """Store a frame as a table in the shared folder and continue from the stored files.

    A stored table survives the loss of executors, is computed once, can be pruned by column
    and has file sizes the planner can rely on. Unlike a checkpointed plan it also carries no
    inferred constraints forward, which grow without bound over the rounds of a loop. Tables are
    written with zstd, whatever the session's compression, or with ``codec``.

    Nothing reads the shuffle files of the write again, so they are deleted when it ends: a chain
    of stored tables holds the shuffles of one step on disk, not of all.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, "stage")
    writer = frame.write.mode("errorifexists")
    before = spark.conf.get(_DROP_SHUFFLES_KEY, None)
    spark.conf.set(_DROP_SHUFFLES_KEY, "true")
    try:
        writer.option("compression", codec or "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES_KEY)
        else:
            spark.conf.set(_DROP_SHUFFLES_KEY, before)
    table = spark.read.schema(frame.schema).parquet(path)
    table.__dict__[_STORED_AT] = path
    return table


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a stored table: itself if it is one already, else stored now.

    An operator that reads its input more than once calls this first, so that the input is
    computed once, however many operators are chained.
    """
    return frame if frame.__dict__.get(_STORED_AT) else cut_lineage(frame)


def is_stored(frame: DataFrame) -> bool:
    """Whether the frame is a stored table or counts as one."""
    return bool(frame.__dict__.get(_STORED_AT))


def as_stored(frame: DataFrame, table: DataFrame) -> DataFrame:
    """``frame``, made of one cheap pass over the stored ``table``, counts as stored itself."""
    frame.__dict__[_STORED_AT] = table.__dict__.get(_STORED_AT)
    return frame


def stored_columns(frame: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a stored table, or of a frame of which only they are stored now."""
    narrow = frame.select(*dict.fromkeys(columns))
    return narrow if frame.__dict__.get(_STORED_AT) else cut_lineage(narrow)


def release(frame: DataFrame | None) -> None:
    """Delete the files of a stored table that nothing will read again."""
    path = frame.__dict__.get(_STORED_AT) if frame is not None else None
    if path:
        delete_path(frame.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
