"""Session settings and the durable tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that are already marked for deletion.
_MARKED: set[str] = set()


def local_session(cores: int = 8, partitions: int = 8, app: str = "keepstream") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in the one all executors share, as the session names it; it is deleted when the driver ends.

    Only a local session without the setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        own = f"{found.rstrip('/')}/keepstream-{sc.applicationId}"
        if own not in _MARKED:
            _MARKED.add(own)
            path = sc._jvm.org.apache.hadoop.fs.Path(own)
            fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        return own
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="keepstream-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The table survives a lost executor, cuts the lineage, and brings Spark exact
    sizes for its join choices. It lasts as long as the application.
    """
    path = f"{shared_dir(df.sparkSession)}/keepstream-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
