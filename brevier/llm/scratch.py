"""Intermediate tables in the folder all executors share.

A written table cuts lineage: an executor that is lost later costs a re-read, never a
recomputation of the stages before it.  The folder comes from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a local master without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="brevier-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


#: Spark removes a write's shuffle files when the write has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch; by default 64 MB, which each task holds in the JVM and, more than once, in its Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = 1 << 22


def save(df: DataFrame, label: str, batch_bytes: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back; Arrow
    batches end after ``batch_bytes`` where it is given."""
    spark = df.sparkSession
    path = f"{folder(spark)}/brevier/{label}-{uuid.uuid4().hex}"
    wanted = {CLEAN: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {CLEAN: spark.conf.get(CLEAN, "false")} | {k: spark.conf.get(k) for k in wanted if k != CLEAN}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by :func:`save`; anything else is left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
