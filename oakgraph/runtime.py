"""Session helpers: the folder that driver and executors share, and written intermediate tables.

Intermediate results that cut lineage are written as Parquet below ``spark.checkpoint.dir`` and read
again, so that a lost executor costs a re-read and never a recomputation of the whole chain.
"""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="oakgraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_DIRS[app] = path
    return "file://" + _LOCAL_DIRS[app]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they start; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    if root.is_dir():
        folder = tempfile.mkdtemp(prefix="oakgraph-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(app)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _SCRATCH:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all that is written below work_path() within; for steps whose result is written by then."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hold batches for Python workers to ``size`` bytes, unless the session allows less; the setting stays in the session, since plans read
    it when they run.

    Texts differ in length by orders of magnitude, and a batch is held by the JVM and by its worker at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(name).strip().lower())  # anything else, as -1, is no bound
    if told is None or int(told[1]) << 10 * " kmgtp".index(told[2] or " ") > size:
        spark.conf.set(name, str(size))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that needs no Python worker."""
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))))


#: Rows of a written file where their number is known beforehand, at least.
FILE_ROWS = 100_000


def materialize(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    most_rows: a bound on the number of rows; small tables then come in few files.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    small_batches(spark)
    (df if most_rows is None else df.coalesce(1 + most_rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that make() gives, written as materialize() does it; what make() wrote on its way is deleted then."""
    path = work_path(spark, label)
    small_batches(spark)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
