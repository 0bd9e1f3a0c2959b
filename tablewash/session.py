"""Session defaults and reliable materialisation."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "tablewash", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """This session's folder below the shared one that ``spark.checkpoint.dir`` names; it goes when
    the session's JVM ends. Without the setting a session of one machine uses its warehouse, any
    other session refuses."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    folder = f"{folder.rstrip('/')}/tablewash-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a columnar cut of the lineage
    that outlives any executor. Used where several later jobs start from the same table."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
