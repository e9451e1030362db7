"""Writers: table overwrite, report export, resumable ingest, merge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.governance import merge_rows
from lakeops.session import cut_lineage


def write_table_overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Replace the table at ``path``."""
    df.write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)
    return path


def project_existing(df: DataFrame, columns: Sequence[str] | dict[str, str]) -> DataFrame:
    """The named columns that exist, in the given order; a dict also renames them."""
    names = columns if isinstance(columns, dict) else {c: c for c in columns}
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`").alias(new) for c, new in names.items() if c in have])


def export_frame(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Report columns as CSV can hold them: instants as ISO text, nested values as JSON."""
    picked = project_existing(df, cols or df.columns)
    out = []
    for f in picked.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return picked.select(*out)


def write_csv_export(df: DataFrame, base: str, name: str, cols: Sequence[str] | None = None, at: dt.datetime | None = None) -> str:
    """Write a report below ``base`` under a time-stamped name; every task writes its own part."""
    path = f"{base.rstrip('/')}/{name}_{(at or dt.datetime.now(dt.UTC)):%Y%m%d_%H%M%S}"
    export_frame(df, cols).write.option("header", True).option("escape", '"').csv(path)
    return path


def _done(spark: SparkSession, state: str, key: str, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(key, kind)])
    try:
        return spark.read.schema(schema).parquet(state)
    except AnalysisException:
        return spark.range(0).select(F.lit(None).cast(kind).alias(key))


def ingest_resumable(source: DataFrame, target: str, state: str, key: str, force: bool = False) -> None:
    """Write the partitions (values of ``key``) not marked done in ``state``, then mark them.

    Data is written before the marks and replaces whole key partitions, so a run
    that dies in between is simply repeated. ``force`` rescans everything and
    replaces the whole target. A hot key is split over several tasks and files by the rebalance.
    """
    spark = source.sparkSession
    done = _done(spark, state, key, source.schema[key].dataType)

    def same(left: str, right: str) -> Column:
        return F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))

    keys = source.select(key).distinct()
    if not force:
        keys = keys.alias("k").join(done.alias("d"), same("k", "d"), "left_anti")
    # fixed before the data is read: a partition that appears meanwhile waits for the next run
    keys = cut_lineage(keys, "pending")
    pending = source.alias("s").join(keys.alias("k"), same("s", "k"), "left_semi").select(*[F.col(f"s.`{c}`") for c in source.columns])
    # a folder name of its own for the empty text and for NULL
    part = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    placed = pending.withColumn("_part", part).hint("rebalance", F.col("_part"))
    if force:
        # no mark may outlive the data it stands for
        keys.limit(0).write.mode("overwrite").parquet(state)
    replace = "static" if force else "dynamic"
    placed.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy("_part").parquet(target)
    keys.write.mode("append").parquet(state)


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("_part")


def merge_apply(spark: SparkSession, current: str, new: str, desired: DataFrame, keys: Sequence[str], fmt: str = "parquet") -> str:
    """Upsert ``desired`` into the table at ``current``.

    Files cannot be replaced while they are read, so the result goes to ``new`` for the caller to switch to.
    """
    return write_table_overwrite(merge_rows(spark.read.format(fmt).load(current), desired, keys), new, fmt)
