"""Data contracts, profiles, schema rules and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators.skew import exact_sum, wide_sum
from lakeops.session import small_frame


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    nullable: bool = True
    pk: bool = False
    fk: tuple[str, str] | None = None  # (table, column)
    range: tuple[float, float] | None = None


@dataclass(frozen=True)
class Contract:
    """What a published table promises."""

    table: str
    columns: tuple[ColumnRule, ...]
    row_count_min: int = 0
    completeness_pct: float = 100.0
    freshness_hours: float | None = None
    freshness_column: str | None = None
    unique: tuple[tuple[str, ...], ...] = field(default=())


def catalog_rows(name: str, df: DataFrame) -> list[tuple[str, str, int, str]]:
    """(table, column, ordinal, type) of a frame, from its schema."""
    return [(name, f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]


DECLARED_COLUMNS = "table_name string, column_name string, data_type string, declared_length int, precision int, scale int"


def declared_columns(name: str, schema: T.StructType) -> list[tuple]:
    """(table, column, base type, declared length, precision, scale) of a declared schema; what a type lacks is None."""
    return [(name, f.name, f.dataType.simpleString().partition("(")[0], getattr(f.dataType, "length", None),
             getattr(f.dataType, "precision", None), getattr(f.dataType, "scale", None)) for f in schema.fields]


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column with its ordinal, declared type and the row count of its table.

    The schema part is as long as the number of columns; row counts are one aggregate per table.
    """
    rows = [r for name, df in tables.items() for r in catalog_rows(name, df)]
    columns = small_frame(spark, rows, "table_name string, column_name string, ordinal int, data_type string")
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("table_rows")).withColumn("table_name", F.lit(name)) for name, df in tables.items()])
    return columns.join(counts, "table_name").orderBy("table_name", "ordinal")


def _stack(one_row: DataFrame, parts: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Unpivot a one-row aggregate: ``parts`` are tuples of expressions, one output row each."""
    rows = F.array(*[F.struct(*[e.alias(n) for e, n in zip(p, names)]) for p in parts])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def schema_audit(columns: DataFrame, by: list[str], string_limit: int = K.STRING_LIMIT, char_limit: int = 20,
                 nullable_pct: float = 80) -> DataFrame:
    """Issues in a column frame (``data_type, max_length, precision, scale, is_nullable``).

    Oversized strings (``-1`` means unlimited), decimal(18,0), mostly nullable items, long fixed-length text.
    """
    kind = F.lower("data_type")

    def issue(name: str, severity: str) -> list[Column]:
        return [F.lit(name).alias("issue"), F.lit(severity).alias("severity")]

    oversized = kind.isin("varchar", "nvarchar", "string") & ((F.col("max_length") > string_limit) | (F.col("max_length") == -1))
    whole = kind.isin("decimal", "numeric") & (F.col("precision") == 18) & (F.col("scale") == 0)
    fixed = kind.isin("char", "nchar") & (F.col("max_length") > char_limit)
    per_column = columns.select(*by, "column_name", F.explode(F.filter(F.array(
        F.when(oversized, F.struct(*issue("oversized string", "High"))),
        F.when(whole, F.struct(*issue("decimal(18,0)", "Medium"))),
        F.when(fixed, F.struct(*issue("long fixed-length text", "Medium"))),
    ), lambda r: r.isNotNull())).alias("r")).select(*by, "column_name", "r.issue", "r.severity")
    nullable = columns.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.count_if("is_nullable").alias("_null"))
    wide = nullable.where(S.pct("_null", "_all") > nullable_pct).select(
        *by, F.lit("(multiple)").alias("column_name"), *issue("mostly nullable", "Medium"))
    return per_column.unionByName(wide)


def contract_schema_drift(df: DataFrame, contract: Contract) -> DataFrame:
    """Missing columns, base-type drift, and NULLs where the contract forbids them.

    A column file formats call nullable drifts only if it really holds a NULL. Timestamps with and without
    a zone are one base type. ``df`` must carry the table's own schema, not a declared one.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    required = [c for c in contract.columns if c.name in have and not c.nullable]
    nulls = {c.name: F.count_if(F.col(c.name).isNull()) for c in required}
    checked = df.agg(F.count(F.lit(1)).alias("_rows"), *[n.alias(f"_null_{c}") for c, n in nulls.items()])
    none = F.lit(None).cast("string")
    parts = []
    for c in contract.columns:
        actual = have.get(c.name)
        if actual is None:
            parts.append((F.lit(c.name), F.lit("missing column"), F.lit(c.type), none, F.lit(True)))
            continue
        if actual.split("(")[0].removesuffix("_ntz") != c.type.split("(")[0].lower():
            parts.append((F.lit(c.name), F.lit("type drift"), F.lit(c.type), F.lit(actual), F.lit(True)))
        if c.name in nulls:
            parts.append((F.lit(c.name), F.lit("nullability drift"), F.lit("NOT NULL"),
                          F.concat_ws(" ", F.col(f"_null_{c.name}").cast("string"), F.lit("NULLs")),
                          F.col(f"_null_{c.name}") > 0))
    names = ["column_name", "kind", "expected", "actual", "_fires"]
    if not parts:
        parts = [(none, none, none, none, F.lit(False))]
    return _stack(checked, parts, names).where("_fires").drop("_fires")


def contract_value_checks(df: DataFrame, contract: Contract, references: Mapping[str, DataFrame],
                          as_of: Column | None = None) -> DataFrame:
    """Every declared value rule: row count, completeness, ranges, freshness, uniqueness, foreign keys.

    ``check_name, violations, measure, passed``. Scalar rules share one
    aggregate; each key rule is a pre-aggregated count on that key.
    """
    n = F.count(F.lit(1))
    required = [c.name for c in contract.columns if not c.nullable]
    ranged = [c for c in contract.columns if c.range]
    aggs = [n.alias("_rows")]
    aggs += [F.count(c).alias(f"_have_{c}") for c in required]
    aggs += [F.count_if((F.col(c.name) < c.range[0]) | (F.col(c.name) > c.range[1])).alias(f"_range_{c.name}") for c in ranged]
    if contract.freshness_column:
        aggs.append(F.max(contract.freshness_column).alias("_newest"))
    rows = F.col("_rows")
    parts = [(F.lit("row_count_min"), F.greatest(F.lit(contract.row_count_min) - rows, F.lit(0)), rows.cast("double"))]
    for c in required:
        share = S.pct(f"_have_{c}", "_rows")
        bad = F.when(share < contract.completeness_pct, rows - F.col(f"_have_{c}")).otherwise(0)
        parts.append((F.lit(f"completeness:{c}"), bad, share))
    for c in ranged:
        bad = F.col(f"_range_{c.name}")
        parts.append((F.lit(f"range:{c.name}"), bad, bad.cast("double")))
    if contract.freshness_column and as_of is not None:
        age = (F.unix_micros(as_of) - F.unix_micros("_newest")) / F.lit(3.6e9)
        parts.append((F.lit("freshness"), (age > contract.freshness_hours).cast("int"), age))
    names = ["check_name", "violations", "measure"]
    out = _stack(df.agg(*aggs), [(a, b.cast("bigint"), m) for a, b, m in parts], names)
    keys = [(c.name,) for c in contract.columns if c.pk] + list(contract.unique)
    for key in dict.fromkeys(keys):
        per_key = df.groupBy(*key).agg(n.alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"), n.cast("double").alias("measure"))
        out = out.unionByName(per_key.withColumn("check_name", F.lit(f"unique:{','.join(key)}")))
    for c in contract.columns:
        if c.fk:
            out = out.unionByName(fk_orphans(df, c.name, references[c.fk[0]], c.fk[1]).select(
                F.lit(f"fk:{c.name}").alias("check_name"), F.col("orphan_rows").alias("violations"),
                F.col("orphan_keys").cast("double").alias("measure")))
    return out.withColumn("passed", F.col("violations") == 0)


def fk_orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows and distinct keys without a parent; rows are counted per key first, so a hot key joins once."""
    per_key = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    missing = F.col("_known").isNull()
    return per_key.join(known, "_k", "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(missing).alias("orphan_keys"))


def integrity_checks(orders: DataFrame, customers: DataFrame, classified: DataFrame, labelled: DataFrame,
                     pii_columns: Sequence[str], restricted: str) -> DataFrame:
    """The release gate: customers exist, orders find their customer, PII columns are classified,
    and columns whose classification is restricted carry the ``restricted`` label."""
    n = F.count(F.lit(1))
    rows = customers.agg(F.lit("customers row count > 0").alias("check_name"), n.cast("double").alias("measure"))
    fk = fk_orphans(orders, "customer_id", customers, "customer_id").select(
        F.lit("orders.customer_id integrity pct").alias("check_name"),
        S.pct(F.col("rows") - F.col("orphan_rows"), "rows").alias("measure"))
    pii = classified.where(F.col("column_name").isin(*pii_columns)).agg(
        F.lit("pii columns classified pct").alias("check_name"), S.pct(F.count_distinct("column_name"), F.lit(len(pii_columns))).alias("measure"))
    lab = labelled.where("is_restricted").agg(
        F.lit("restricted columns labelled pct").alias("check_name"),
        F.when(n == 0, F.lit(100.0)).otherwise(S.pct(F.count_if(F.col("label") == restricted), n)).alias("measure"))
    gate = F.when(F.col("check_name").endswith("> 0"), F.col("measure") > 0).otherwise(F.col("measure") >= 100)
    return reduce(DataFrame.unionByName, [rows, fk, pii, lab]).withColumn("passed", gate)


def apply_type_policy(bronze: DataFrame, types: Mapping[str, str], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cast bronze to its declared types: (silver, quarantine).

    A row goes to quarantine when a key is NULL or a present value does not fit its type; the reasons say which.
    """
    cast = {c: F.col(c).try_cast(t) for c, t in types.items()}
    bad = [F.when(F.col(c).isNotNull() & cast[c].isNull(), F.lit(f"type:{c}")) for c in types]
    bad += [F.when(F.col(c).isNull(), F.lit(f"null key:{c}")) for c in key]
    marked = bronze.withColumn("_reasons", F.filter(F.array(*bad), lambda r: r.isNotNull()))
    silver = marked.where(F.size("_reasons") == 0).select(*[cast[c].alias(c) if c in cast else F.col(c) for c in bronze.columns])
    quarantine = marked.where(F.size("_reasons") > 0).withColumn("reasons", F.array_join("_reasons", ", ")).drop("_reasons")
    return silver, quarantine


def dictionary_gap(metadata: DataFrame, id_col: str, required: Sequence[str]) -> DataFrame:
    """Entries that miss a required attribute: one row per entry and attribute."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull())
    return metadata.select(id_col, F.explode(missing).alias("missing_attribute"))


def cde_coverage(elements: DataFrame, dictionary: DataFrame, normalize_names: bool = False) -> DataFrame:
    """Bound columns of critical elements and whether the dictionary knows them.

    ``normalize_names`` compares names without case and separators.
    """

    def norm(c: str) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "") if normalize_names else F.col(c)

    bound = elements.select("element", F.explode("columns").alias("b")).select("element", "b.dataset", "b.column_name")
    left = bound.withColumns({"_d": norm("dataset"), "_c": norm("column_name")})
    right = dictionary.select(norm("table_name").alias("_d"), norm("column_name").alias("_c"), "null_pct")
    return left.join(right, ["_d", "_c"], "left").select(
        "element", "dataset", "column_name", F.col("null_pct").isNotNull().alias("covered"), "null_pct")


def health_control_score(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of passed checks: healthy from 0.8, fair from 0.6, else critical."""
    passed = F.sum(F.col("passed").cast("int")).cast("double") / F.count(F.lit(1)).cast("double")
    scored = checks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("checks"), passed.alias("score"))
    status = F.when(F.col("score") >= 0.8, "healthy").when(F.col("score") >= 0.6, "fair").otherwise("critical")
    return scored.withColumn("status", status)


def reconcile_tables(left: DataFrame, right: DataFrame, key: list[str], amounts: list[str]) -> DataFrame:
    """Row count, exact sums and content checksum per key on both sides, and whether they agree."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
        return df.groupBy(*key).agg(
            F.count(F.lit(1)).alias(f"rows_{tag}"),
            wide_sum(F.xxhash64(*cols)).alias(f"_hash_{tag}"),
            *[exact_sum(F.col(c), 4).alias(f"{c}_{tag}") for c in amounts])

    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    both = side(left, "left").alias("l").join(side(right, "right").alias("r"), on, "full_outer")
    zero = F.lit(0)
    measures = [c for a in amounts for c in (f"{a}_left", f"{a}_right")]
    return both.select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in key],
        F.coalesce("rows_left", zero).alias("rows_left"), F.coalesce("rows_right", zero).alias("rows_right"),
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in measures],
        (F.coalesce("rows_right", zero) - F.coalesce("rows_left", zero)).alias("row_delta"),
        F.col("_hash_left").eqNullSafe(F.col("_hash_right")).alias("matches"))


#: Ranges that a level of the checksum tree may follow; where more differ, little is equal and the rows are compared.
RANGES = 4096


def differing_ranges(left: DataFrame, right: DataFrame, key: str, fanout: int = 64, leaf: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges (first, last) of a whole-number ``key`` outside which both tables hold the same rows.

    A checksum tree: counts and row checksums are added up per key range on both sides, and only ranges that differ are
    cut ``fanout`` times finer, until they hold at most ``leaf`` rows together or single keys. Rows of equal ranges are
    read, not shuffled; the ranges are predicates that reach the scan, so a table stored by its key skips them.
    """
    columns = [F.col(f"`{c}`") for c in sorted(left.columns)]
    ends = left.select(key).unionByName(right.select(key)).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends.lo is None:
        return []
    lo, width = ends.lo, 1
    while width <= ends.hi - lo:
        width *= fanout
    ranges = [(0, 0)]  # first and last part, in units of the width
    while True:
        def sums(df: DataFrame, tag: str, parts=tuple(ranges), size=width) -> DataFrame:
            held = df.where(_within(F.col(key), [(lo + a * size, lo + (b + 1) * size - 1) for a, b in parts]))
            finer = max(size // fanout, 1)
            return held.groupBy(F.floor((F.col(key) - lo) / finer).cast("bigint").alias("_part")).agg(
                F.count(F.lit(1)).alias(f"_n_{tag}"), wide_sum(F.xxhash64(*columns)).alias(f"_sum_{tag}"))

        both = sums(left, "l").join(sums(right, "r"), "_part", "full_outer")
        same = F.col("_n_l").eqNullSafe(F.col("_n_r")) & F.col("_sum_l").eqNullSafe(F.col("_sum_r"))
        found = both.where(~same).select("_part", (F.coalesce("_n_l", F.lit(0)) + F.coalesce("_n_r", F.lit(0))).alias("n")).orderBy("_part").limit(RANGES + 1).collect()
        if len(found) > RANGES:
            return [(lo + a * width, lo + (b + 1) * width - 1) for a, b in ranges]
        width = max(width // fanout, 1)
        ranges = []
        for r in found:
            ranges = [*ranges[:-1], (ranges[-1][0], r["_part"])] if ranges and ranges[-1][1] == r["_part"] - 1 else [*ranges, (r["_part"], r["_part"])]
        if width == 1 or sum(r.n for r in found) <= leaf:
            return [(lo + a * width, lo + (b + 1) * width - 1) for a, b in ranges]


def _within(key: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Key inside one of the ranges: its outer bounds as a predicate for the scan, and a search among the ranges."""
    if not ranges:
        return F.lit(False)
    whole = key.between(ranges[0][0], ranges[-1][1])
    if len(ranges) <= 32:
        return reduce(lambda a, b: a | b, [key.between(a, b) for a, b in ranges])
    starts, ends = F.array(*[F.lit(a) for a, _ in ranges]), F.array(*[F.lit(b) for _, b in ranges])
    return whole & F.exists(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: (r["a"] <= key) & (key <= r["b"]))


def reconcile_rows(left: DataFrame, right: DataFrame, key: str, amounts: list[str], fanout: int = 64, leaf: int = 1 << 20) -> DataFrame:
    """:func:`reconcile_tables` of the keys that differ; only rows of ranges that differ are compared key by key.

    Rows without a key are one group, compared as well.
    """
    ranges = differing_ranges(left, right, key, fanout, leaf)
    picked = [df.where(_within(F.col(key), ranges) | F.col(key).isNull()) for df in (left, right)]
    return reconcile_tables(*picked, [key], amounts).where(~F.col("matches"))
