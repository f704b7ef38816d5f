"""Session helpers: where shared intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder, the same for the whole application
    and deleted at its end; any other master is an error, as no folder is known to be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="forge-")
            atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
        folder = f"file://{_OWN_FOLDERS[app]}"
    return folder.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/forge/{spark.sparkContext.applicationId}"


def clear_settled(spark: SparkSession) -> None:
    """Delete all that this application has settled; frames that still read it can't be used any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and reread it, so that several consumers share one computation."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """settled, with aggregates over the rows taken in the pass that writes them: no scan of their own.

    They are observed on top of the plan, in the tasks that write, each of which counts once however often it is retried."""
    seen = Observation()
    done = settled(df.observe(seen, *[fact.alias(k) for k, fact in facts.items()]), name)
    return done, seen.get
