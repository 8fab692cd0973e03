"""Session helpers: a local session for tests, and tables staged in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "siteloom", **conf: str) -> SparkSession:
    """A ``local[cores]`` session in UTC, for tests and single-machine use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``. Only where that is unset (a local run, as in
    tests) is a folder of this machine made, and remembered in the session.
    """
    given = spark.conf.get(CHECKPOINT_KEY, None)
    if given:
        return given.rstrip("/")
    own = spark.conf.get("siteloom.local.shared", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="siteloom-")
        spark.conf.set("siteloom.local.shared", own)
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of it.

    This cuts lineage like ``checkpoint()`` but computes the plan a single time, and a lost
    executor loses nothing, as the files aren't kept on executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteloom-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders this process has staged.
_STAGED: list[str] = []


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables this process has staged; frames that read them can't be used afterwards. Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def ship(spark: SparkSession) -> str:
    """Send this package to the executors of a cluster whose workers don't have it, once per session. Returns the archive's path."""
    import shutil

    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="siteloom-"), "siteloom"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)
    return archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
