"""Session helpers: a builder for local use and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are deleted when it has run.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lacquer", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the cluster's shared one if it names one.

    Only a local session (as in tests) is given a temporary folder; on a cluster a folder
    of one machine would lose every cut, so there the setting is asked for.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    alone = spark.sparkContext.master.split("[")[0] == "local"
    if not shared and not alone:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = shared or tempfile.mkdtemp(prefix="lacquer-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, cut its lineage and delete the shuffle files that led to it.

    Spark would keep those as long as the driver knows the query, which is to its end.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FREE, "false")
    conf.set(FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query has the setting from when it is put together
    finally:
        conf.set(FREE, before)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """:func:`cut` of ``df`` partitioned by ``key``, so that later joins on it move the other side only.

    Adaptive plans do not tell how their result is partitioned, so they are off meanwhile.
    """
    conf = df.sparkSession.conf
    adaptive, parts = conf.get("spark.sql.adaptive.enabled"), int(conf.get("spark.sql.shuffle.partitions"))
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(parts, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
