"""Column profiles: of a frame in two scans, or merged from what is stored per file, so that a new file is read alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import scalars as S
from lakeops.sources.readers import read_file_listing

#: Digits behind the point of a floating value's text.
DIGITS = 6
#: Longer values are told apart by their SHA-256.
KEPT_WHOLE = 64
#: Floating values below this have a text of digits only, which never gets shorter away from zero.
PLAIN = 1e31
#: Instants whose year has four digits in any time zone.
YEARS = ("0001-01-03T00:00:00Z", "9999-12-29T00:00:00Z")
#: What a value is told apart by: one of the three is set.
KEY = ["whole", "real", "text"]

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.DoubleType, T.FloatType)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def value_text(value: Column, kind: T.DataType) -> Column:
    """A value as the profile shows it: floating ones with six digits, nested ones not at all."""
    if _nested(kind):
        return F.lit(None).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(value.try_cast(f"decimal(38,{DIGITS})").cast("string"), value.cast("string"))
    return value.cast("string")


def value_length(value: Column, kind: T.DataType) -> Column:
    """Characters of the text; elements of an array or map."""
    return F.nullif(F.size(value), F.lit(-1)) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(value_text(value, kind))


def length_range(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Least and greatest :func:`value_length` as aggregates. Numbers become text only at the ends of their range, as a
    number further from zero has no shorter text; instants are as long as their fraction."""
    if isinstance(kind, _WHOLE + _REAL):
        plain = F.abs(value) < PLAIN if isinstance(kind, _REAL) else F.lit(True)
        up, down = F.when(plain & (value >= 0), value), F.when(plain & (value < 0), value)
        shown = [value_length(end, kind) for end in (F.min(up), F.max(down), F.max(up), F.min(down))]
        if isinstance(kind, _WHOLE):
            return F.least(*shown[:2]), F.greatest(*shown[2:])
        other = F.when(~plain, value_length(value, kind))
        return F.least(*shown[:2], F.min(other)), F.greatest(*shown[2:], F.max(other))
    length = value_length(value, kind)
    if isinstance(kind, T.TimestampType):
        micros, fraction = F.unix_micros(value), F.lit(26)
        for digits in range(5, 0, -1):
            fraction = F.when(micros % 10 ** (6 - digits) == 0, 20 + digits).otherwise(fraction)
        first, last = (F.lit(t).cast(kind) for t in YEARS)
        length = F.when(value.between(first, last), F.when(micros % 1_000_000 == 0, 19).otherwise(fraction)).otherwise(length)
    return F.min(length), F.max(length)


def value_key(value: Column, kind: T.DataType) -> dict[str, Column]:
    """``KEY`` of a value, equal only for equal values; 0.0 and -0.0 are one, and so are all NaN (grouping sees to that)."""
    key = {"whole": F.lit(None).cast("bigint"), "real": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    if isinstance(kind, _WHOLE):
        return key | {"whole": value.cast("bigint")}
    if isinstance(kind, T.TimestampType):
        return key | {"whole": F.unix_micros(value)}
    if isinstance(kind, _REAL):
        return key | {"real": F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))}
    text = F.to_json(F.struct(value.alias("v"))) if isinstance(kind, (T.MapType, T.StructType)) else value.cast("string")
    short = F.length(text) <= KEPT_WHOLE
    return key | {"text": F.when(value.isNotNull(), F.when(short, F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("#"), F.sha2(text, 256))))}


def partial_stats(schema: T.StructType, fields: Sequence[int] | None = None) -> list[Column]:
    """Aggregates of one part of a table (of some fields), in the columns' own types, that :func:`merged_stats` adds up."""
    out = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(schema.fields):
        if fields is not None and i not in fields:
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType
        least, most = length_range(c, kind)
        value = F.lit(None).cast("string") if _nested(kind) else c
        out += [F.count(c).alias(f"_n{i}"), least.alias(f"_lo{i}"), most.alias(f"_hi{i}"), F.min(value).alias(f"_min{i}"), F.max(value).alias(f"_max{i}")]
    return out


def merged_stats(parts: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column from the aggregates of any number of parts."""
    fold = {"_n": F.sum, "_lo": F.min, "_hi": F.max, "_min": F.min, "_max": F.max}
    one = parts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_rows"), *[
        fn(f"{k}{i}").alias(f"{k}{i}") for i in range(len(schema.fields)) for k, fn in fold.items()])
    rows = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal"), F.col("_rows").alias("row_count"),
        (F.col("_rows") - F.coalesce(f"_n{i}", F.lit(0))).alias("null_count"), F.col(f"_lo{i}").alias("min_length"), F.col(f"_hi{i}").alias("max_length"),
        value_text(F.col(f"_min{i}"), f.dataType).alias("min_value"), value_text(F.col(f"_max{i}"), f.dataType).alias("max_value")) for i, f in enumerate(schema.fields)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def value_keys(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (``by``, ordinal, ``KEY``) of all columns in one scan; tasks keep each value once before the shuffle."""
    fields = [f for f in df.schema.fields if f.name not in by]
    keys = [c for i, f in enumerate(fields, 1) for c in (F.lit(i), *value_key(F.col(f"`{f.name}`"), f.dataType).values())]
    return df.select(*by, F.stack(F.lit(len(fields)), *keys).alias("ordinal", *KEY)).where(" or ".join(f"{k} is not null" for k in KEY)).distinct()


def _profile(name: str, stats: DataFrame, keys: DataFrame) -> DataFrame:
    distinct = keys.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
    return stats.join(distinct, "ordinal", "left").fillna(0, ["distinct_count"]).withColumns({
        "table_name": F.lit(name), "null_pct": S.pct("null_count", "row_count")})


def column_profile(name: str, df: DataFrame) -> DataFrame:
    """Rows, NULLs, distinct values, length range and value range of every column.

    One aggregate and one scan for the distinct values of all columns; a very common value costs nothing.
    """
    return _profile(name, merged_stats(df.agg(*partial_stats(df.schema)), df.schema), value_keys(df))


# -- stored profiles ---------------------------------------------------------------------

_FILE = ["_path", "_size", "_modified"]
#: 128 bits that stand for a file next to its values, where its path would be longer than they are.
_MARK = ["_mark", "_mark2"]


def _listing(spark: SparkSession, path: str) -> DataFrame:
    files = read_file_listing(spark, path)
    return files.select(
        _plain(F.col("file_path")).alias("_path"), F.col("size_bytes").alias("_size"), F.unix_millis("modified").alias("_modified"))


def _plain(uri: Column) -> Column:
    """One spelling for a local file, whoever lists it."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def refresh(spark: SparkSession, path: str, store: str, schema: T.StructType) -> int:
    """Profile the files below ``path`` that ``store`` does not know in their present size and time; returns how many.

    The values and aggregates of a file are written before it is marked; a run that dies in between is repeated, and
    marks without a file, or of an older state of it, count for nothing.
    """
    files, known = _listing(spark, path), _stored(spark, f"{store}/files")
    new = files if known is None else files.join(known, _FILE, "left_anti")
    paths = [r["_path"] for r in new.select("_path").collect()]  # what a read of these files holds on the driver anyway
    if not paths:
        return 0
    source = F.col("_metadata")
    raw = [source["file_path"].alias("_raw"), source["file_size"].alias("_size"), source["file_modification_time"].alias("_time")]
    marks = {"_mark": F.xxhash64("_raw", "_size", "_time"), "_mark2": F.xxhash64(F.lit("_"), "_raw", "_size", "_time")}
    df = spark.read.schema(schema).parquet(*paths).select("*", *raw)
    value_keys(df.withColumns(marks).select(*_MARK, *[f"`{f.name}`" for f in schema.fields]), _MARK).write.mode("append").parquet(f"{store}/values")
    # extremes of texts make Spark sort the rows by file, so they are taken from narrow rows of their own
    loose = [i for i, f in enumerate(schema.fields) if _nested(f.dataType) or isinstance(f.dataType, (T.StringType, T.BinaryType))]
    stats = df.groupBy("_raw", "_size", "_time").agg(*partial_stats(schema, [i for i in range(len(schema.fields)) if i not in loose])).withColumns(marks)
    if loose:
        stats = stats.join(df.withColumns(marks).groupBy(*_MARK).agg(*partial_stats(schema, loose)).drop("_rows"), _MARK)
    named = _plain(F.url_decode(F.replace("_raw", F.lit("+"), F.lit("%2B"))))
    stats.withColumns({"_path": named, "_modified": F.unix_millis("_time")}).drop("_raw", "_time").write.mode("append").parquet(f"{store}/stats")
    new.where(F.col("_path").isin(paths)).write.mode("append").parquet(f"{store}/files")
    return len(paths)


def stored_profile(spark: SparkSession, name: str, path: str, store: str, schema: T.StructType) -> DataFrame:
    """:func:`column_profile` of the table as :func:`refresh` last saw it; files that are gone do not count."""
    now = _listing(spark, path)
    # a file that was profiled twice (a run died before its mark) has equal rows twice
    stats = spark.read.parquet(f"{store}/stats").join(now, _FILE, "left_semi")
    keys = spark.read.parquet(f"{store}/values").join(stats.select(*_MARK), _MARK, "left_semi").select("ordinal", *KEY).distinct()
    stats = stats.dropDuplicates(_FILE)
    return _profile(name, merged_stats(stats, schema), keys)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
