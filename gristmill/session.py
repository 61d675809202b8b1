"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "gristmill", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults this library is written for; ``conf`` overrides by full key. The number of shuffle partitions is the cluster's unless given."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = DEFAULTS | {"spark.ui.enabled": "false"} | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, columns pruned and filters pushed by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where none is set, a local session gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gristmill-shared-"))
    return context.getCheckpointDir()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is already gone, and with it its folder
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and go on from there.

    The table outlives any executor. ``release_tables`` removes it, at the latest the end of the driver process does.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/gristmill-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _written.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


_written: list[str] = []


def forget_later(folder: str) -> None:
    """Has ``release_tables`` remove a folder as well."""
    _written.append(folder)


def release_tables(spark: SparkSession | None = None) -> None:
    """Removes all tables that ``cut_lineage`` wrote so far, for a long session between queries whose results are no longer read."""
    spark = spark or SparkSession.getActiveSession()
    while _written and spark is not None:
        _remove(spark, _written.pop())


atexit.register(release_tables)


MOST_BROADCAST_BYTES = 32 << 20


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row a key, a null key being one, where rows that share a key differ in nothing that is wanted.

    Of a file scan only keys and places of rows are shuffled. The keys that stand in several rows are written and meet the rows again to pick one,
    in a broadcast join up to ``MOST_BROADCAST_BYTES`` (a quarter of it as compressed files), so that wide columns such as texts stay where they are. Any other input is made distinct as it is.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "Repartition", "RepartitionByExpression", "SubqueryAlias"):
        node = node.children().head()
    if not node.nodeName().startswith(("LogicalRelation", "Relation")):
        return df.dropDuplicates([key])  # rows of other plans have no places of their own
    try:
        placed = df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("_place"))
    except AnalysisException:
        return df.dropDuplicates([key])
    repeated = placed.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")).filter("_n > 1").select("_key", "_first")
    repeated = cut_lineage(repeated)
    met = placed.join(F.broadcast(repeated) if estimated_bytes(repeated) <= MOST_BROADCAST_BYTES // 4 else repeated, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.filter(F.col("_first").isNull() | (F.col("_first") == F.col("_place"))).select(*df.columns)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, for deciding whether a side may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores, for work that costs far more than moving the rows.

    An input of a few files would otherwise be a task or two, with most cores idle. From ``SPREAD_BYTES`` on the files themselves are many enough, and nothing is moved.
    """
    if estimated_bytes(df) >= SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() >= cores else df.repartition(cores)
