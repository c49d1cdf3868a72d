"""Session settings and the shared scratch folder every job writes its intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Runtime settings the operators rely on.  Skewed joins are split by AQE, also
# where that costs one more shuffle; timestamps are compared in UTC; a batch of
# rows on its way to or from Python is bounded by bytes, as texts can be long.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app: str = "quillmesh", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its
    own: on a cluster such a folder would be invisible to the executors.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="quillmesh-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """Size of the files ``df`` reads."""
    spark = df.sparkSession
    total = 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage of iterative jobs with a table that outlives any
    executor, and gives the next plan exact sizes to choose joins from.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again.

    Whatever was made from them must have been written itself by then, as a
    lost executor would otherwise send Spark back to files that are gone.
    """
    for table in tables:
        spark = table.sparkSession
        root = scratch_root(spark).removeprefix("file:").rstrip("/")
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if root not in folder:
                raise ValueError(f"{folder} is no table of the scratch folder")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition and sort ``df`` by ``keys`` once, and checkpoint it that way.

    Later joins on the keys neither shuffle nor sort this side again.  The
    checkpoint keeps its partitioning only when AQE is off while it is written.
    No key may be hot, since such a join cannot be split any more.
    """
    spark = df.sparkSession
    folder = scratch_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(parts, *keys).sortWithinPartitions(*keys).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
