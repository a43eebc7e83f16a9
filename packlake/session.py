"""Session construction and the few settings every job of the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "packlake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, benches and the command line; a cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    session = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship_package(spark: SparkSession) -> None:
    """Make sure the Python workers can import this package, wherever the driver was started; once per session."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    known = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]}
    if root in known or getattr(context, "_packlake_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="packlake-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "packlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "packlake").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    context._packlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores where the scan alone would leave some idle; large inputs keep their scan splits, so nothing is shuffled there."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, 2)
    if df.rdd.getNumPartitions() >= 2 * wanted:
        return df
    return df.repartition(2 * wanted, *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a local session that names none gets a folder of its own, which ends with it.

    A cluster without one is an error: a folder of one machine cannot hold what other machines write and read.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY, None)
    if held.isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all machines share")
        if not named:
            named = tempfile.mkdtemp(prefix="packlake-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        held = context._jsc.sc().getCheckpointDir()
    return named or held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
