"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "tidesift", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on.

    AQE coalesces small partitions and splits skewed ones at run time, so the
    shuffle partition number is an upper bound rather than a tuned value.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # small stages keep one task per core; large ones are sized by the advisory size
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # label files come in old code pages, too
        "spark.sql.legacy.javaCharsets": "true",
        **{key: str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder: on a cluster a machine-local folder would
    be lost together with its executor.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


class Workspace:
    """Intermediate tables of one iterative job.

    ``keep(df)`` writes the table once and reads it back: the plan restarts
    from files, so a lost executor re-reads instead of recomputing earlier
    rounds, and AQE sees true table sizes. ``free(df)`` deletes a kept table no
    later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: dict[int, tuple[DataFrame, str]] = {}
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(kept)] = (kept, path)
        return kept

    def free(self, *kept: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in kept:
            _, path = self.kept.pop(id(df), (None, None))
            if path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)
