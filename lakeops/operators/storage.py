"""Reports over file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import scalars as S

ITEM = ["item_type", "item_name"]


def _size() -> Column:
    """A missing size counts as 0 bytes."""
    return F.coalesce(F.col("size_bytes"), F.lit(0))


def filter_item_types(files: DataFrame, types: tuple[str, ...] = ("Lakehouse", "Warehouse")) -> DataFrame:
    return files.where(F.col("item_type").isin(*types))


def storage_by_item(files: DataFrame) -> DataFrame:
    totals = files.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("files"), F.sum(_size()).alias("bytes"))
    return totals.withColumns({"gb": S.bytes_to_gb("bytes"), "tb": S.bytes_to_tb("bytes")}).orderBy(F.desc("bytes"), *ITEM)


def _directory_sizes(files: DataFrame, prefix_with_item: bool) -> DataFrame:
    path = F.concat_ws("/", *ITEM, "file_path") if prefix_with_item else F.col("file_path")
    return files.groupBy(S.directory_of(path).alias("_dir")).agg(F.sum(_size()).alias("_bytes"))


def storage_by_directory(files: DataFrame, max_depth: int | None = None, prefix_with_item: bool = True) -> DataFrame:
    """Cumulative bytes of every directory, root shown as ``/``.

    Files shrink to one row per directory before ancestors are generated, so the
    expansion grows with the number of directories, not of files. Directories
    below ``max_depth`` are left out; their bytes still count for their ancestors.
    """
    expanded = _directory_sizes(files, prefix_with_item).select(
        F.explode(S.ancestors("_dir", max_depth)).alias("_d"), "_bytes")
    totals = expanded.groupBy("_d").agg(F.sum("_bytes").alias("bytes"))
    shown = F.when(F.col("_d") == "", "/").otherwise(F.col("_d"))
    return totals.select(shown.alias("directory"), "bytes", S.bytes_to_gb("bytes").alias("gb"), S.bytes_to_tb("bytes").alias("tb"))


def top_folders(files: DataFrame, n: int = 20, max_depth: int | None = None) -> DataFrame:
    largest = storage_by_directory(files, max_depth).orderBy(F.desc("bytes"), "directory").limit(n)
    return largest.withColumn("size", S.format_bytes("bytes", "A"))


def storage_summary(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row: items, files, bytes and directories tracked."""
    totals = storage_by_item(files).agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    dirs = storage_by_directory(files, max_depth).agg(F.count(F.lit(1)).alias("dirs_tracked"))
    both = totals.unionByName(dirs, allowMissingColumns=True).agg(*[
        F.max(c).alias(c) for c in ("items", "files", "total_bytes", "dirs_tracked")])
    return both.withColumns({"total_gb": S.bytes_to_gb("total_bytes"), "total_tb": S.bytes_to_tb("total_bytes")})


# -- soft-deleted files ----------------------------------------------------------

def soft_deleted_files(files: DataFrame) -> DataFrame:
    """Files either deletion flag marks; time falls back to the deletion id, then to ``Unknown``."""
    have = set(files.columns)

    def opt(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    gone = F.coalesce(opt("is_deleted", "boolean"), F.lit(False)) | F.coalesce(opt("deleted", "boolean"), F.lit(False))
    when = F.coalesce(opt("deleted_time", "string").cast("string"), opt("deletion_id", "string").cast("string"), F.lit("Unknown"))
    return files.where(gone).select(
        *ITEM, "file_path", _size().alias("size_bytes"), (_size() / F.lit(1048576.0)).alias("size_mb"),
        when.alias("deleted_time"), opt("remaining_days", "int").alias("remaining_days"))


def soft_delete_by_item(files: DataFrame) -> DataFrame:
    return soft_deleted_files(files).groupBy(*ITEM).agg(
        F.count("file_path").alias("file_count"), F.sum("size_bytes").alias("total_size_bytes")).withColumn(
        "total_size", S.format_bytes("total_size_bytes", "B"))


def soft_delete_by_ext(files: DataFrame) -> DataFrame:
    return soft_deleted_files(files).groupBy(S.file_extension("file_path").alias("file_ext")).agg(
        F.count("file_path").alias("files"), F.sum("size_bytes").alias("size_bytes")).orderBy(F.desc("size_bytes"), "file_ext")


def expiring_files(files: DataFrame, days: int = 2) -> DataFrame:
    """Deleted files with at most ``days`` left; a value that is no number counts as unknown."""
    left = F.col("remaining_days").try_cast("double")
    return soft_deleted_files(files).withColumn("remaining_days", left).where(F.col("remaining_days") <= days)


def head_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows of a sorted report (a per-task top-n, then a merge; never a full sort)."""
    return df.orderBy(*order).limit(n)
