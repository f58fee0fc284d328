"""Session factory and the few settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; ``conf`` overrides single settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return settle(builder.getOrCreate())


def settle(spark: SparkSession) -> SparkSession:
    """Settings every plan here relies on, on a session made elsewhere.

    Spark 4.1 lets a union keep the partitioning its branches share; with windows in the branches
    rows then came out wrong (seen in 4.1.2: one branch's ranks under another's label), so this is off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: their Python need not find it by itself."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tessella-code-")) / "tessella.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tessella_shipped = True


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one, removed at exit, only on a local master.

    Raises on a cluster that names none: a folder of the driver's machine would lose the work of the others.
    """
    if shared := _named_folder(spark):
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(context, "_tessella_folder", None):
        context._tessella_folder = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, context._tessella_folder, ignore_errors=True)
    return context._tessella_folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoint into the shared folder unless the context has one already."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as the cluster has cores.

    A small file is one split; CPU-bound Python work on it would keep one core busy.
    Inputs with enough splits, that is all large ones, pass through without a shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
