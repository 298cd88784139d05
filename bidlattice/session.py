"""Session helpers: builder defaults, Python path of the workers, shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults the engine is tuned for; ``conf`` overrides them."""
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


#: Rows of one Arrow batch unless the session says otherwise: whole texts of documents are some kilobytes each, and a
#: batch is held by the JVM and by the Python worker at once.
ARROW_ROWS = "2000"
#: Python workers live on from stage to stage. With these, arrays of some megabytes go back to the system once they are
#: freed, where an allocator left to itself keeps the most that any stage before took. Values already set are kept.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started, and bounds their batches and memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, os.environ.get(name, value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all
    executors are in this process. On a cluster without the setting there is no such folder, which is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="bidlattice-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/bidlattice-{name}-{uuid.uuid4().hex}"


_COLLECTED = [0.0]


def _collect(spark: SparkSession) -> None:
    """Collects the garbage of both sides, every other second at most."""
    if time.monotonic() - _COLLECTED[0] > 2:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()


def stored(df, name: str):
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    What only earlier steps needed, their shuffle files above all, goes as soon as the JVM has collected its garbage."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.parquet(path)
    del df  # else its shuffle files stay until the next step
    _collect(spark)
    return spark.read.schema(schema).parquet(path)


def dropped(df) -> None:
    """Deletes the files of a ``stored`` DataFrame that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/bidlattice-" in folder:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)
