"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir, which all executors share.

    Only where that is unset and the master is local (tests, bench) a folder of this machine is used;
    on a cluster without the setting this fails rather than write where other executors can't read.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(named)
    return named


_written: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a compressed table into the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and, unlike a checkpoint, is columnar:
    later reads take only the columns they need and know their size. The tables are removed when the
    session's program ends, or earlier by sweep().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Remove every table that cut_lineage wrote; results that still need one must be read before."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S110  the session may have ended before
            pass


atexit.register(sweep)
