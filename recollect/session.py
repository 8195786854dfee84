"""Sessions and the shared folder in which lineage is cut."""
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The tables written in the innermost open scratch() block, by thread.
_open = threading.local()


def local_session(app: str = "recollect", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECOLLECT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of this machine's, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a lost executor costs no recomputation beyond it.

    release: let Spark remove the shuffle files of plans that nothing refers to any more, which it does when the
    driver's garbage is collected; for steps after large shuffles. What was still in use when the last step ended goes
    before this one begins.
    """
    spark = df.sparkSession
    if release:
        _collect_garbage(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if release:
        del df
        _collect_garbage(spark)
    return table


def _collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread of the driver writes within the block are deleted at its end, but for the one passed to the function it gives.

    >>> with scratch(spark) as keep:
    ...     result = keep(materialize(several_steps(df), "result"))
    """
    mine: list[str] = []
    outer = getattr(_open, "paths", None)
    _open.paths = mine
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.update(p for p in mine if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in table.inputFiles()))
        return table

    try:
        yield keep
    finally:
        _open.paths = outer
        for p in mine:
            if p not in kept:
                path = spark._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            elif outer is not None:
                outer.append(p)
