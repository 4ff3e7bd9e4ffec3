"""Session helpers: building a session, and tables that cut lineage in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int = 8, app: str = "stridemap", **conf: str) -> SparkSession:
    """A local session with settings that suit small inputs; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Only where it is unset, and only in local mode, where one machine holds everything, a
    temporary folder is set instead.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="stridemap-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


class Scratch:
    """Tables that materialize() writes within a scratch() block."""

    def __init__(self) -> None:
        self.written: list[DataFrame] = []

    def keep(self, *frames: DataFrame) -> None:
        """Let these tables outlive the block."""
        paths = {getattr(df, "_stridemap_path", None) for df in frames}
        self.written = [df for df in self.written if df._stridemap_path not in paths]


_open: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Delete at the end all tables that were written within, but those that are kept."""
    own = Scratch()
    before = _open.set((*_open.get(), own))
    try:
        yield own
    finally:
        _open.reset(before)
        discard(*own.written)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and the
    result survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stridemap_path = path
    for own in _open.get():
        own.written.append(out)
    return out


def materialize_counted(df: DataFrame, flag: str, name: str = "t") -> tuple[DataFrame, int]:
    """materialize(), and how many rows have the flag: counted while they are written, without a job of its own."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(flag).alias("n")), name)
    return out, seen.get["n"]


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stridemap_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are written."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
