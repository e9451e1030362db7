"""A table stored in buckets of its keys, so that an upsert rewrites only the buckets it changes.

``root/data/<write>/_bucket=<n>`` holds the rows whose keys hash to bucket n; ``root/manifest`` says for every version
which folder each bucket has. A version exists once its manifest file is there, and that file is written last and by one
task: readers see the old version or the new one, and a writer that dies in between leaves folders nobody names.
One writer at a time; folders of older versions stay for readers of those.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.governance import merge_rows, upsert_diff
from lakeops.session import cut_lineage, small_frame

_MANIFEST = "version bigint, buckets int, keys array<string>, schema string, bucket int, folder string"


@dataclass(frozen=True)
class Version:
    """What the newest manifest says: one folder per bucket that has rows."""

    number: int
    buckets: int
    keys: tuple[str, ...]
    schema: T.StructType
    folders: dict[int, str]


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def current(spark: SparkSession, root: str) -> Version:
    """The newest version; as many rows as there are buckets come to the driver."""
    log = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    rows = log.where(F.col("version") == log.agg(F.max("version")).scalar()).collect()
    head = rows[0]
    return Version(head.version, head.buckets, tuple(head["keys"]), T.StructType.fromJson(json.loads(head.schema)), {r.bucket: r.folder for r in rows if r.folder is not None})


def _write(df: DataFrame, root: str, keys: Sequence[str], buckets: int) -> str:
    """``df`` in one folder per bucket below a new folder."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    return folder


def _publish(spark: SparkSession, root: str, v: Version) -> None:
    own = (v.number, v.buckets, list(v.keys), v.schema.json())
    rows = [(*own, b, f) for b, f in sorted(v.folders.items())] or [(*own, None, None)]
    small_frame(spark, rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _filled(spark: SparkSession, folder: str, schema: T.StructType) -> dict[int, str]:
    written = spark.read.schema(T.StructType([*schema, T.StructField("_bucket", T.IntegerType())])).parquet(folder).select("_bucket").distinct().collect()
    return {r["_bucket"]: f"{folder}/_bucket={r['_bucket']}" for r in written}


def create(df: DataFrame, root: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store ``df`` as the first version. Buckets of a few hundred MB suit; their number never changes."""
    spark = df.sparkSession
    folder = _write(df, root, keys, buckets)
    _publish(spark, root, Version(0, buckets, tuple(keys), df.schema, _filled(spark, folder, df.schema)))


def _rows(spark: SparkSession, v: Version, only: Sequence[int] | None = None) -> DataFrame:
    paths = [f for b, f in sorted(v.folders.items()) if only is None or b in only]
    return spark.read.schema(v.schema).parquet(*paths) if paths else spark.createDataFrame([], v.schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, current(spark, root))


def diff(spark: SparkSession, root: str, desired: DataFrame) -> DataFrame:
    """Desired rows with CREATE, UPDATE or NOOP; buckets that no desired row falls into are not read."""
    return _diff(spark, current(spark, root), cut_lineage(desired, "desired"))


def _diff(spark: SparkSession, v: Version, desired: DataFrame) -> DataFrame:
    asked = {r.b for r in desired.select(_bucket(v.keys, v.buckets).alias("b")).distinct().collect()}
    values = [c for c in v.schema.names if c not in v.keys]
    return upsert_diff(_rows(spark, v, asked), desired, list(v.keys), values)


def upsert(spark: SparkSession, root: str, desired: DataFrame) -> list[int]:
    """Bring ``desired`` in; returns the buckets that were rewritten.

    Of desired rows with one key the one with the largest values counts, as in :func:`merge_rows`. Nothing is written
    where every row is stored already, so a repeated upsert ends at once.
    """
    v = current(spark, root)
    values = [c for c in v.schema.names if c not in v.keys]
    one = desired.groupBy(*v.keys).agg(F.max(F.struct(*values)).alias("_row")).select(*v.keys, "_row.*") if values else desired.select(*v.keys).distinct()
    one = cut_lineage(one.select(*v.schema.names), "desired")
    at = _bucket(v.keys, v.buckets)
    changed = sorted(r.b for r in _diff(spark, v, one).where(F.col("action") != "NOOP").select(at.alias("b")).distinct().collect())
    if not changed:
        return []
    merged = merge_rows(_rows(spark, v, changed), one.where(at.isin(changed)), list(v.keys))
    folder = _write(merged, root, v.keys, v.buckets)
    folders = v.folders | {b: f"{folder}/_bucket={b}" for b in changed}
    _publish(spark, root, Version(v.number + 1, v.buckets, v.keys, v.schema, folders))
    return changed
