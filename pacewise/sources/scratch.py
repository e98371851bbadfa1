"""Tables in the folder that driver and executors share, results kept between queries, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
_KEPT: dict[tuple, tuple[str, object]] = {}
#: Results kept at most; the oldest goes first.
MOST_KEPT = 12


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder on a single machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="pacewise-core-")
        atexit.register(shutil.rmtree, _FALLBACK["dir"], True)
    return "file://" + _FALLBACK["dir"]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/pacewise/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/pacewise/" in folder:
                delete(df.sparkSession, folder)


def signature(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and time of change of the files, so that a result is told from one of other data."""
    out = []
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        out.append((path, status.getLen(), status.getModificationTime()))
    return tuple(out)


def kept(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` built from the files ``paths``: written at first use and read again while they stay as they are."""
    key = (spark.sparkContext.applicationId, name, signature(spark, paths))
    if key not in _KEPT:
        while len(_KEPT) >= MOST_KEPT:
            old, (path, _) = next(iter(_KEPT.items()))
            del _KEPT[old]
            if old[0] == spark.sparkContext.applicationId:
                delete(spark, path)
        path = f"{shared_dir(spark)}/pacewise/kept-{name}-{uuid.uuid4().hex[:12]}"
        df = build()
        df.write.parquet(path)
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or spark.sparkContext.master.startswith("local"):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="pacewise-pkg-"), "pacewise_core.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
