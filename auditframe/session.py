"""Session settings the library relies on."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Call-site capture costs a round trip per column expression while plans are built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "auditframe", **extra: str) -> SparkSession:
    """A local session for tests and measurements; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting falls back to a new scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="auditframe-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame) -> DataFrame:
    """Write a result that several jobs reuse to the shared folder and read it back.

    The files outlive any executor, and the plan of what follows starts at them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """``materialise`` with all rows of a key in one file of as many as a shuffle has partitions, which Spark knows when it reads them.

    Windows, aggregations and joins by these keys, or by more, then move nothing, and neither does storing what comes of them
    by the same keys. The rows of a key meet in one task, so it is for keys with a bounded number of rows.
    """
    spark = df.sparkSession
    # Joins by more than these keys take such rows as they lie; the registry sets it back for the next query.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    count, name = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    files = df.repartition(count, *keys).write.bucketBy(count, *keys).option("compression", "zstd")
    files.option("path", f"{shared_dir(spark)}/auditframe/{name}").format("parquet").saveAsTable(f"auditframe_{name}")
    # The files' relation itself: columns that carry the table's name as qualifier make unions of them lose the layout.
    relation = spark.table(f"auditframe_{name}")._jdf.queryExecution().analyzed().child().relation()
    found = DataFrame(spark._jsparkSession.baseRelationToDataFrame(relation), spark)
    # The catalog's entry only served to carry the layout; the files are not the catalog's and stay.
    spark.sql(f"DROP TABLE auditframe_{name}")
    return found
