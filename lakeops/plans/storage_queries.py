"""Storage sizing and soft-delete reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions import scalars as S
from lakeops.operators import storage as O
from lakeops.plans.registry import query


def fmt_bytes(x: str, style: str) -> str:
    """SQL twin of the byte formatter."""
    units, cut = (("B", "KB", "MB", "GB", "TB", "PB", "EB"), 3) if style == "A" else (("B", "KB", "MB", "GB", "TB"), 2)
    out = "case"
    for i, u in enumerate(units):
        spec = "{:,.2f}" if i >= cut else "{:,.0f}"
        cond = f"when cast({x} as double) < {1024.0 ** (i + 1)!r}::double then" if i < len(units) - 1 else "else"
        out += f" {cond} format('{spec} {u}', cast({x} as double) / {float(1024 ** i)!r}::double)"
    return out + " end"


GB, TB = "1073741824.0::double", "1099511627776.0::double"
DELETED = "deleted as (select * from fx_files where is_deleted)"
#: every ancestor of a file's directory, '' being the root
DIRS = """
parts as (select string_split(concat(item_type, '/', item_name, '/', file_path), '/') as p, size_bytes from fx_files),
expanded as (select p, size_bytes, unnest(range(0, len(p))) as k from parts),
dirs as (select case when k = 0 then '/' else array_to_string(p[1:k], '/') end as directory, k, cast(sum(size_bytes) as bigint) as bytes
 from expanded group by all)"""


@query("filter_item_types", "select item_type, item_name, file_path from fx_files where item_type in ('Warehouse')")
def _(lake):
    return O.filter_item_types(lake.fx("files"), ("Warehouse",)).select("item_type", "item_name", "file_path")


@query("storage_by_item", f"""
select item_type, item_name, count(*) as files, cast(sum(size_bytes) as bigint) as bytes, cast(sum(size_bytes) as bigint) / {GB} as gb,
 cast(sum(size_bytes) as bigint) / {TB} as tb from fx_files group by item_type, item_name""")
def _(lake):
    return O.storage_by_item(lake.fx("files"))


@query("storage_by_directory", f"""
with {DIRS} select directory, bytes, bytes / {GB} as gb, bytes / {TB} as tb from dirs""")
def _(lake):
    return O.storage_by_directory(lake.fx("files"))


@query("parent_dirs", f"with {DIRS} select directory, bytes from dirs")
def _(lake):
    return O.storage_by_directory(lake.fx("files"), max_depth=None).select("directory", "bytes")


@query("top_folders", f"""
with {DIRS} select directory, bytes, bytes / {GB} as gb, bytes / {TB} as tb, {fmt_bytes('bytes', 'A')} as size from dirs
order by bytes desc, directory limit 20""")
def _(lake):
    return O.top_folders(lake.fx("files"))


@query("storage_summary", f"""
with {DIRS}
select count(distinct (item_type, item_name)) as items, count(*) as files, cast(sum(size_bytes) as bigint) as total_bytes,
 (select count(*) from dirs) as dirs_tracked, cast(sum(size_bytes) as bigint) / {GB} as total_gb,
 cast(sum(size_bytes) as bigint) / {TB} as total_tb from fx_files""")
def _(lake):
    return O.storage_summary(lake.fx("files"))


@query("soft_deleted_files", """
select item_type, item_name, file_path, size_bytes, size_bytes / 1048576.0::double as size_mb, 'Unknown' as deleted_time,
 cast(remaining_days as double) as remaining_days from fx_files where is_deleted""")
def _(lake):
    return O.soft_deleted_files(lake.fx("files")).withColumn("remaining_days", F.col("remaining_days").cast("double"))


@query("soft_delete_by_item", f"""
select item_type, item_name, count(file_path) as file_count, cast(sum(size_bytes) as bigint) as total_size_bytes,
 {fmt_bytes('sum(size_bytes)', 'B')} as total_size from fx_files where is_deleted group by item_type, item_name""")
def _(lake):
    return O.soft_delete_by_item(lake.fx("files"))


EXT = "case when contains(file_path, '.') then lower(string_split(file_path, '.')[-1]) else 'unknown' end"


@query("soft_delete_by_ext", f"""
select {EXT} as file_ext, count(file_path) as files, cast(sum(size_bytes) as bigint) as size_bytes from fx_files where is_deleted group by all""")
def _(lake):
    return O.soft_delete_by_ext(lake.fx("files"))


@query("expiring_files", """
select item_type, item_name, file_path, size_bytes, size_bytes / 1048576.0::double as size_mb, 'Unknown' as deleted_time,
 cast(remaining_days as double) as remaining_days from fx_files where is_deleted and remaining_days <= 2""")
def _(lake):
    return O.expiring_files(lake.fx("files"))


@query("head_n", """
select item_type, item_name, file_path, size_bytes from fx_files order by size_bytes desc, file_id limit 50""")
def _(lake):
    return O.head_n(lake.fx("files"), [F.desc("size_bytes"), "file_id"], 50).select("item_type", "item_name", "file_path", "size_bytes")


SCALED = "size_bytes * cast(power(1024, file_id % 5) as bigint)"


@query("format_bytes", f"""
select file_id, {fmt_bytes('n', 'A')} as style_a, {fmt_bytes('n', 'B')} as style_b from (select file_id, {SCALED} as n from fx_files)""")
def _(lake):
    n = lake.fx("files").select("file_id", (F.col("size_bytes") * F.pow(F.lit(1024), F.col("file_id") % 5).cast("bigint")).alias("n"))
    return n.select("file_id", S.format_bytes("n", "A").alias("style_a"), S.format_bytes("n", "B").alias("style_b"))


@query("bytes_to_gb_tb", f"select file_id, size_bytes / {GB} as gb, size_bytes / {TB} as tb from fx_files")
def _(lake):
    return lake.fx("files").select("file_id", S.bytes_to_gb("size_bytes").alias("gb"), S.bytes_to_tb("size_bytes").alias("tb"))


@query("file_extension", f"select file_id, {EXT} as file_ext from fx_files")
def _(lake):
    return lake.fx("files").select("file_id", S.file_extension("file_path").alias("file_ext"))


@query("relative_path", """
select file_id, case when file_id % 2 = 0 then file_path else concat('x', file_id, '/', file_path) end as rel from fx_files""")
def _(lake):
    name = F.when(F.col("file_id") % 2 == 0, F.concat_ws("/", "file_id", "file_path")).otherwise(
        F.concat(F.lit("x"), F.concat_ws("/", "file_id", "file_path")))
    return lake.fx("files").select("file_id", S.relative_path(name, "file_id").alias("rel"))


@query("iso_duration_days", """
select file_id, case when remaining_days is not null and file_id % 5 <> 0 then cast(remaining_days as double) end as days from fx_files""")
def _(lake):
    text = F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("PT"), F.col("remaining_days"), F.lit("H"))).otherwise(
        F.concat(F.lit("P"), F.col("remaining_days"), F.lit("D")))
    return lake.fx("files").select("file_id", S.iso_duration_days(text).cast("double").alias("days"))


@query("retention_label", """
select file_id, case when remaining_days is not null then concat(remaining_days, ' days') else 'N/A (Auto-managed)' end as retention from fx_files""")
def _(lake):
    return lake.fx("files").select("file_id", S.retention_label("remaining_days").alias("retention"))


@query("split_provider", """
select file_id, split_part(file_path, '/', 1) as service, substring(file_path, instr(file_path, '/') + 1) as resource_type from fx_files""")
def _(lake):
    return lake.fx("files").select("file_id", S.provider("file_path").alias("service"), S.provider_type("file_path").alias("resource_type"))
