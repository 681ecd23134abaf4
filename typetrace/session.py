"""Session defaults and lineage handling shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Sizes are left to AQE: it coalesces small shuffle
# partitions, splits skewed ones, and turns a join into a broadcast only after it has
# measured the side.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Crop rows carry whole images, so an Arrow batch is kept at a few dozen megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "typetrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over as many partitions as the session asks for in ``spark.typetrace.spread``.

    For heavy work on tables of a few small files. Unset, as on a cluster whose tables have files
    enough, it does nothing.
    """
    parts = df.sparkSession.conf.get("spark.typetrace.spread", "")
    return df.repartition(int(parts)) if parts else df


def cut_lineage(df: DataFrame, name: str = "shared") -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and return the stored copy.

    Later reads take only the columns they need, and the copy outlives lost executors.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A new folder for intermediate tables, stream checkpoints and sinks of one run.

    It lies in ``base``, or in the folder the cluster names in ``spark.checkpoint.dir``. Only a
    local session that names none gets a temporary folder. It is deleted when the driver ends.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="typetrace-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
