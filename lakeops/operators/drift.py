"""Contract drift file by file: footers are read in tasks, no row is."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from lakeops.operators.quality import Contract
from lakeops.sources.listing import list_files

_FOOTER = "file_path string, rows bigint, column_name string, actual string"


def _type_name(kind: pa.DataType) -> str:
    try:
        return from_arrow_type(kind, prefer_timestamp_ntz=True).simpleString()
    except Exception:  # a type Spark does not know is named as the file names it
        return str(kind)


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, rows, column_name, actual): columns of every Parquet file below ``path`` as its own footer has them.

    Tasks list the folders and open the footers; a file that is no Parquet file has one row without a column.
    """
    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            out = []
            for uri in batch.column("file_path").to_pylist():
                parts = urlsplit(uri)
                store, at = (fs.LocalFileSystem(), uri.removeprefix("file:")) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(
                    f"{parts.scheme}://{parts.netloc}{quote(parts.path)}")
                try:
                    found = pq.ParquetFile(store.open_input_file(at))
                except pa.ArrowInvalid:
                    out.append((uri, None, None, None))
                    continue
                out += [(uri, found.metadata.num_rows, f.name, _type_name(f.type)) for f in found.schema_arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))],
                names=["file_path", "rows", "column_name", "actual"])

    files = list_files(spark, path).select("file_path").repartition("file_path")
    return files.mapInArrow(footers, _FOOTER)


def _base(kind):
    """Base type: without precision, and with or without a zone alike."""
    return F.regexp_replace(F.lower(kind), r"(_ntz)?(\(.*)?$", "")


def drift_by_file(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """``file_path, rows, column_name, kind, expected, actual``: what each file has otherwise than the contract says.

    ``missing column``, ``type drift``, ``unknown column`` and ``unreadable file``. The contract is a short list next to
    each file's columns, so nothing is joined.
    """
    wanted = F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.lit(c.type).alias("expected")) for c in contract.columns])
    files = file_schemas(spark, path).groupBy("file_path").agg(
        F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.when(F.col("column_name").isNotNull(), F.struct("column_name", "actual")))).alias("have"))
    none, names = F.lit(None).cast("string"), F.array(*[F.lit(c.name) for c in contract.columns])

    def row(column, kind, expected, actual):
        return F.struct(column.alias("column_name"), F.lit(kind).alias("kind"), expected.alias("expected"), actual.alias("actual"))

    declared = F.transform(wanted, lambda w: F.when(
        F.col("have")[w["column_name"]].isNull(), row(w["column_name"], "missing column", w["expected"], none)).when(
        _base(F.col("have")[w["column_name"]]) != _base(w["expected"]), row(w["column_name"], "type drift", w["expected"], F.col("have")[w["column_name"]])))
    extra = F.transform(F.array_except(F.map_keys("have"), names), lambda c: row(c, "unknown column", none, F.col("have")[c]))
    found = F.when(F.col("rows").isNull(), F.array(row(none, "unreadable file", none, none))).otherwise(F.concat(declared, extra))
    return files.select("file_path", "rows", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("file_path", "rows", "r.*")


def drift_summary(drift: DataFrame) -> DataFrame:
    """How many files and rows drift in which way, with one file as an example."""
    return drift.groupBy("column_name", "kind", "expected", "actual").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("file_path").alias("example"))


