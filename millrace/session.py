"""Sessions, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is designed for.

    On a cluster the session comes from the launcher; nothing in the library depends on the
    values set here except the UTC time zone, which only matters for comparisons with an oracle.
    """
    cores = os.environ.get("BENCH_CPUS", cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: bytes of input, by the optimizer's estimate, that a partition is meant to hold
PARTITION_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimizer estimates it from file sizes, at most where it filters."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame) -> int:
    """Partitions for an operator that holds one of them at a time: as the session says, or more for large inputs."""
    size = estimated_bytes(df)
    # without an estimate the optimizer assumes the largest size there is
    needed = size // PARTITION_BYTES + 1 if size < 1 << 60 else 1
    return max(shuffle_width(df.sparkSession), min(needed, 1 << 20))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(_driver_folder()) / f"{package.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, f"{package.name}/{source.relative_to(package)}")
    context.addPyFile(str(archive))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)``, with this package within the executors' reach."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file the driver reads to the executors; the name ``SparkFiles.get`` finds it by there."""
    context = spark.sparkContext
    if (context.applicationId + path) not in _shipped:
        context.addFile(path)
        _shipped.add(context.applicationId + path)
    return path.rstrip("/").rpartition("/")[2]


def _driver_folder() -> str:
    """A folder of this process, removed when it ends."""
    if not _own_folders:
        _own_folders.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own_folders[0], True)
    return _own_folders[0]


_own_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where the executors are threads of this process may a session name none; it then gets a
    temporary folder that goes with the process. Any other session without one is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file://{_driver_folder()}"


class Scope:
    """What was written to the shared folder while it was open; ``close`` removes it.

    Results of operators are read from these files, so a scope is closed once they have been used::

        with Scope(spark):
            mixture(documents, targets).write.parquet(path)

    What is written outside of any scope is removed by ``sweep``.
    """

    _open: list[Scope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scope:
        Scope._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scope._open.remove(self)
        self.close()

    def close(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        for df in self.kept:
            df.unpersist()
        self.paths.clear()
        self.kept.clear()


_outside: dict[str, list[str]] = {}


def _wrote(spark: SparkSession, path: str) -> None:
    (Scope._open[-1].paths if Scope._open else _outside.setdefault(spark.sparkContext.applicationId, [])).append(path)


def keep(df: DataFrame) -> DataFrame:
    """``df`` kept by the executors, in memory as far as it fits and else on disk, until its scope closes."""
    if Scope._open:
        Scope._open[-1].kept.append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Remove what this application wrote to the shared folder outside of any scope; results read from it are gone."""
    paths = _outside.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    The written copy keeps the partitions of ``df`` and their order, survives the loss of executors,
    and is never computed again. See ``shared_folder`` and ``Scope`` for where it lies and how long.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    _wrote(spark, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def write_out(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compact, read with pushdown, computed once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _wrote(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
