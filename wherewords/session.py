"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on. AQE splits hot join partitions and sizes the
# reducers at run time; UTC makes seconds-of-day independent of the machine. A
# generated method above 8000 bytes is never compiled by HotSpot, so such a stage
# is better run operator by operator.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_local_folders: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def build_session(app: str = "wherewords", master: str | None = None, **conf: str) -> SparkSession:
    """Session with :data:`SETTINGS`; ``conf`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir`` or set
    with ``setCheckpointDir``.

    Only a local session may go without; it gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="wherewords-")
    return _local_folders[context.applicationId]


def staged_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Removes all tables staged in this application; results that read them must be
    written by then."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and gives
    Catalyst the true size of the table: a staged side is broadcast only if it
    is really below ``spark.sql.autoBroadcastJoinThreshold``, and is joined by
    shuffle (with AQE skew splitting) above it. No broadcast hint is needed.
    """
    path = staged_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer tasks than there are cores.

    For heavy text work on a table in one or two files; a table in many files is
    returned as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows known to the driver as a table whose size the optimizer knows.

    From an Arrow table it becomes a local relation, which Catalyst broadcasts in
    a join; from a list it would count as unboundedly large.
    """
    fields = [part.split() for part in schema.split(", ")]
    kinds = {
        "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
        "array<double>": pa.list_(pa.float64()),
    }
    columns = {
        name: pa.array([row[i] for row in rows], kinds[kind])
        for i, (name, kind) in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns), schema)
