"""Scalar rules as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeops.functions import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(value: Column | str, table: Mapping, default=None) -> Column:
    """Literal map lookup; ``default`` (a value or Column) for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _col(value))
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def status_in(status: Column | str, names: Sequence[str]) -> Column:
    """Case-insensitive membership; a NULL status is in no set."""
    return F.coalesce(F.lower(_col(status)).isin(*names), F.lit(False))


def run_state(status: Column | str, failures: Sequence[str] = K.FAILURE_METRICS) -> Column:
    """success / failure / in_progress / other."""
    return (
        F.when(status_in(status, K.SUCCESS), "success")
        .when(status_in(status, failures), "failure")
        .when(status_in(status, K.IN_PROGRESS), "in_progress")
        .otherwise("other")
    )


def pct(part: Column | str, whole: Column | str) -> Column:
    """part / whole · 100, and 0 where whole is 0."""
    a, b = _col(part).cast("double"), _col(whole).cast("double")
    return F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, NULL where whole is 0."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def health_badge(rate: Column | str) -> Column:
    """Health of a success rate, judged at the one decimal the report shows."""
    r = F.round(_col(rate), 1)
    return F.when(r >= K.HEALTHY_PCT, "Healthy").when(r >= K.WARNING_PCT, "Warning").otherwise("Critical")


def frequency_bucket(gap_seconds: Column | str) -> Column:
    g = _col(gap_seconds)
    return (
        F.when(g <= 3600, "sub-hourly").when(g <= 86400, "daily").when(g <= 7 * 86400, "weekly")
        .when(g.isNotNull(), "infrequent")
    )


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """End minus start in seconds, NULL if either is missing."""
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(1e6)


def parse_utc(text: Column | str) -> Column:
    """ISO text to an instant: ``Z`` or no zone means UTC, bad text is NULL (UTC session)."""
    return F.try_to_timestamp(_col(text))


def iso_duration_days(text: Column | str) -> Column:
    """``P7D`` → 7, anything without a leading day part → NULL."""
    return F.nullif(F.regexp_extract(_col(text), r"^P(\d+)D", 1), F.lit("")).cast("int")


def retention_label(days: Column | str) -> Column:
    d = _col(days)
    return F.when(d.isNotNull(), F.concat(d.cast("int").cast("string"), F.lit(" days"))).otherwise("N/A (Auto-managed)")


def format_bytes(n: Column | str, style: str = "A") -> Column:
    """Human-readable size: A shows decimals from GB, B from MB and stops at TB."""
    units, decimals_from = (K.UNITS_A, 3) if style == "A" else (K.UNITS_B, 2)
    x = _col(n).cast("double")

    def shown(i: int) -> Column:
        return F.concat(F.format_number(x / F.lit(float(1024 ** i)), 2 if i >= decimals_from else 0), F.lit(f" {units[i]}"))

    out = F.when(x < 1024.0, shown(0))
    for i in range(1, len(units) - 1):
        out = out.when(x < float(1024 ** (i + 1)), shown(i))
    return out.when(x.isNotNull(), shown(len(units) - 1))


def bytes_to_gb(n: Column | str) -> Column:
    return _col(n) / F.lit(float(1024 ** 3))


def bytes_to_tb(n: Column | str) -> Column:
    return _col(n) / F.lit(float(1024 ** 4))


def file_extension(path: Column | str) -> Column:
    """Lower-case text after the last dot of the whole path, else ``unknown``."""
    p = _col(path)
    return F.when(p.contains("."), F.lower(F.substring_index(p, ".", -1))).otherwise("unknown")


def relative_path(name: Column | str, item_id: Column | str) -> Column:
    """Path below the item root: the item id prefix and leading slashes removed."""
    n, i = F.coalesce(_col(name), F.lit("")), _col(item_id).cast("string")
    return F.when(n.startswith(i), F.regexp_replace(F.substring(n, F.length(i) + 1, F.length(n)), "^/+", "")).otherwise(n)


def directory_of(path: Column | str) -> Column:
    """Directory part of a path, '' for a file at the root."""
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def ancestors(directory: Column | str, max_depth: int | None = None) -> Column:
    """Array of a directory and all its ancestors, root as ''; deeper than ``max_depth`` left out."""
    d = _col(directory)
    parts = F.filter(F.split(d, "/"), lambda s: s != "")
    depth = F.size(parts) if max_depth is None else F.least(F.size(parts), F.lit(max_depth))
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def parent_dirs(path: Column | str, max_depth: int | None = None) -> Column:
    return ancestors(directory_of(path), max_depth)


def flatten_tags(tags: Column | str) -> Column:
    """``k=v; k=v``, '' for a missing or empty map; NULL values print as empty."""
    t = _col(tags)
    pairs = F.transform(F.map_entries(t), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, "; "), F.lit(""))


def provider(type_name: Column | str) -> Column:
    """``a/b/c`` → ``a``."""
    return F.substring_index(_col(type_name), "/", 1)


def provider_type(type_name: Column | str) -> Column:
    """``a/b/c`` → ``b/c``; the whole text when there is no slash."""
    t = _col(type_name)
    return F.when(t.contains("/"), F.regexp_replace(t, "^[^/]*/", "")).otherwise(t)


def endpoint_host(connection: Column | str) -> Column:
    """Host of a connection string or URL: scheme removed, cut at the first ``;`` or ``/``."""
    return F.regexp_extract(_col(connection), "^(?:jdbc:)?(?:[a-z]+://)?([^;/]*)", 1)


def truncate_text(text: Column | str, n: int) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def normalize_data_type(type_name: Column | str, aliases: Mapping[str, str] = K.TYPE_ALIASES) -> Column:
    """Canonical type name; unknown names stay as they are, a missing one is Text."""
    t = F.trim(F.coalesce(_col(type_name), F.lit("Text")))
    return lookup(F.lower(t), aliases, t)


def is_movable(item_type: Column | str) -> Column:
    return F.coalesce(_col(item_type).isin(*K.MOVABLE_TYPES), F.lit(False))


def movability(item_type: Column | str) -> Column:
    return F.when(is_movable(item_type), "Movable").otherwise("Non-Movable")


def migration_wave(complexity: Column | str) -> Column:
    return lookup(complexity, K.WAVES, 3)


def severity_rank(label: Column | str) -> Column:
    return lookup(label, K.PRIORITIES, 99)


def revenue_tier(revenue: Column | str) -> Column:
    """Right-closed tiers; zero, negative and missing revenue have none."""
    r = _col(revenue)
    out = F.when(r.isNull() | (r <= 0), F.lit(None).cast("string"))
    for name, top in K.REVENUE_TIERS:
        out = out.when(r <= top, name)
    return out.otherwise("Strategic")


def tenure_years(hire: Column | str, as_of: Column) -> Column:
    return F.datediff(as_of, _col(hire)) / F.lit(365.25)


def quarter_label(day: Column | str) -> Column:
    d = _col(day)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def last_quarter(as_of: Column | str) -> Column:
    return quarter_label(F.add_months(F.trunc(_col(as_of), "quarter"), -3))


def env_domain_name(name: Column | str, env: Column | str, is_prod: Column | str) -> Column:
    n = _col(name)
    return F.when(_col(is_prod), n).otherwise(F.concat_ws("-", n, _col(env)))


def env_base_name(full: Column | str, env: Column | str, is_prod: Column | str) -> Column:
    """Undo :func:`env_domain_name`."""
    f, suffix = _col(full), F.concat(F.lit("-"), _col(env))
    cut = F.left(f, F.length(f) - F.length(suffix))
    return F.when(~_col(is_prod) & f.endswith(suffix), cut).otherwise(f)


def env_find_replace(text: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply literal (find, replace) pairs in order."""
    out = _col(text)
    for find, new in rules:
        out = F.replace(out, F.lit(find), F.lit(new))
    return out


def json_prop(text: Column | str, key: str) -> Column:
    return F.get_json_object(_col(text), f"$.{key}")


def contains_ignore_case(text: Column | str, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(_col(text)), F.lit(part.lower())), F.lit(False))
