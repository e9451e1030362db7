"""Session defaults, the shared scratch folder and lineage cutting."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Settings every job assumes. Shuffle partitions are left to the caller:
#: 2-3x the total cores on a cluster (AQE coalesces), 8 in the local tests.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # weeks of ids remembered by a stream do not fit in the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "lakeops", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with :data:`DEFAULTS`; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Where it is unset, a folder below the session's warehouse, which all executors share as well.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if sc.getCheckpointDir() is not None:
            return sc.getCheckpointDir()
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local") and urlsplit(warehouse).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is a local one")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


#: Scratch paths handed out to each application, until they are released.
_handed_out: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, never reused path below :func:`shared_root`; :func:`release_scratch` removes it."""
    path = f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete what this application wrote to scratch paths, and return how many paths there were.

    Results that are still to be computed read from there: call it once they have been consumed. ``since`` keeps the
    first so many paths, as :func:`scratch_mark` counted them.
    """
    paths = _handed_out.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths[since:]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    released = len(paths) - since
    del paths[since:]
    return released


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch paths there are now."""
    return len(_handed_out.get(spark.sparkContext.applicationId, []))


def cut_lineage(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative plans stay short and survive lost executors, and Catalyst knows
    the written size: a later join broadcasts this side only if it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    return cut_lineage_counted(df, tag)[0]


def cut_lineage_counted(df: DataFrame, tag: str = "cut", which: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut_lineage` with the number of rows (those where ``which`` holds), observed while they are written."""
    path, seen = scratch_path(df.sparkSession, tag), Observation()
    df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Configuration-sized rows as a frame held in the plan, without a Python job."""
    kind = T.StructType.fromDDL(schema)
    columns = {f.name: pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kind.fields)}
    return spark.createDataFrame(pa.table(columns), schema=kind)
