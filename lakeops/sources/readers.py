"""Readers for landed API pages, SQL endpoints, file listings and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.session import small_frame
from lakeops.sources.listing import list_files


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_paged_json(spark: SparkSession, path: str, element: str | T.StructType, id_col: str,
                    array_cols: Sequence[str] = ("value",), multi_line: bool = False) -> DataFrame:
    """Elements of all landed pages, one row each; of versions of an id the one whose JSON text sorts last, rows without id all.

    ``array_cols`` are the names the page may keep its elements under. Pages are
    one JSON document per line unless ``multi_line``.
    """
    item = T.ArrayType(_struct(element))
    page = T.StructType([T.StructField(c, item) for c in array_cols])
    pages = spark.read.schema(page).option("multiLine", multi_line).json(path)
    rows = pages.select(F.inline(F.coalesce(*array_cols)))
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    newest = Window.partitionBy(id_col).orderBy(F.desc("_text"))
    one = rows.where(F.col(id_col).isNotNull()).withColumn("_text", text).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    return one.drop("_text", "_rank").unionByName(rows.where(F.col(id_col).isNull()))


def jdbc_options(url: str, sql: str, partition: tuple[str, object, object, int] | None = None, **options: str) -> dict[str, str]:
    """Reader options that push ``sql`` to the endpoint, read in parallel ranges when ``partition`` is given.

    ``partition`` is (column, lower bound, upper bound, partitions); rows outside the bounds are still read.
    """
    out = {"url": url, "fetchsize": "10000", **options}
    if partition is None:
        return {**out, "query": sql}
    column, low, high, n = partition
    return {**out, "dbtable": f"({sql}) pushed", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(n)}


def read_jdbc_query(spark: SparkSession, url: str, sql: str, partition=None, **options: str) -> DataFrame:
    """Rows of a query that the SQL endpoint itself filters, sorts and cuts."""
    return spark.read.format("jdbc").options(**jdbc_options(url, sql, partition, **options)).load()


def read_first_available(candidates: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, str]:
    """First candidate Spark can analyse, with its name; all errors together if none can."""
    errors = []
    for name, make in candidates:
        try:
            df = make()
            _ = df.schema
            return df, name
        except PySparkException as e:
            errors.append(f"{name}: {str(e).splitlines()[0]}")
    raise ValueError("no source is available\n" + "\n".join(errors))


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All frames below each other with their name in ``tag``; columns a frame lacks are NULL."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_tolerant(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], tag: str = "source") -> tuple[DataFrame, DataFrame]:
    """Union of the sources that can be read, and a status row (name, rows, error) for each one."""
    good, errors = {}, {}
    for name, make in sources.items():
        try:
            df = make()
            _ = df.schema
            good[name] = df
        except PySparkException as e:
            errors[name] = (e.getCondition() if hasattr(e, "getCondition") else None) or type(e).__name__
    if not good:
        raise ValueError(f"no source could be read: {errors}")
    data = union_tagged(good, tag)
    status = small_frame(spark, [(n, errors.get(n)) for n in sources], "name string, error string")
    counts = data.groupBy(F.col(tag).alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return data, status.join(counts, "name", "left").fillna(0, ["rows"])


#: Stores whose folders tasks can list themselves.
LISTED_BY_TASKS = ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")


def read_file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with size and time; no file is opened.

    Tasks list the folders. A store that only Spark's own readers reach is listed by its reader, which holds the names
    on the driver.
    """
    if root.partition(":")[0] in LISTED_BY_TASKS or ":" not in root:
        return list_files(spark, root)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def read_csv_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without ``schema`` Spark reads the data twice to infer one."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
