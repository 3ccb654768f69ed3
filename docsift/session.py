"""Session settings and the size checks that guard every broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a side may have before it is no longer sent to every executor.
BROADCAST_ROWS = 200_000


def build_session(app: str = "docsift", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; in local mode one of our own where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    target = named or tempfile.mkdtemp(prefix="docsift-ckpt-")
    sc.setCheckpointDir(target)
    return target


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast a side whose size was checked; otherwise leave the join to shuffle."""
    return F.broadcast(df) if fits else df


def localized(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A checked small table as a local relation, computed once and broadcast where joined.

    Meant for what comes from queries. A larger table is returned as it is, with False.
    """
    head = df.limit(rows + 1).toArrow()
    if head.num_rows > rows:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema)), True
