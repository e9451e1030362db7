"""Secret scans: a trigram inverted index answers a Boolean query of each rule; only candidates are matched.

* ``trigram_query`` derives from a rule's pattern the trigrams that each of its matches must hold (lower case), as
  alternatives of required sets. A rule with an alternative that requires none is scanned in full.
* The index has postings (trigram, document key) of the trigrams that the rules ask for, over whole texts. Postings
  of one alternative are intersected by counting, keyed by document, so a trigram of every document is no hot group.
* Candidates are verified by the pattern itself; spans come from the pieces between matches.

DataFrame functions only. The key is a hash of id and text: rows that share one get each other's candidates at most,
and the pattern decides.

Cases: a null text is empty and has no spans; repeated rows and null ids are rows like others; a very long text is
scanned whole; other columns are ignored; tables without rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.session import small_frame


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches with fewer characters (of ``group``, or of the match) are dropped after matching.
    least: int = 0
    group: int = 0
    #: A pattern with the same matches of ``least`` characters or more, where the plain one matches everywhere.
    exact: str | None = None


#: The base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, exact=r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"(?:gho|ghp|ghr|ghs|ghu)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """Alternatives of required trigrams; one empty alternative means that the rule must be scanned in full.

    Literal runs are followed through the parsed pattern; whatever is no literal (classes, repeats that may be empty)
    ends a run. An alternation or an optional letter multiplies the runs, up to ``most`` alternatives.
    """
    # a branch: (trigrams so far, text of the open run)
    def close(branch):
        grams, run = branch
        return grams | {run[i:i + 3] for i in range(len(run) - 2)}, ""

    def walk(nodes, branches):
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL" and value < 128:
                branches = [(g, run + chr(value).lower()) for g, run in branches]
            elif name == "SUBPATTERN":
                branches = walk(value[-1], branches)
            elif name == "BRANCH":
                branches = [b for alternative in value[1] for b in walk(alternative, branches)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] == 0 and value[1] == 1:
                branches = branches + walk(value[2], branches)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                branches = [close(b) for b in walk(value[2], branches)]
            elif name == "AT":
                continue
            else:
                branches = [close(b) for b in branches]
            if len(branches) > most:
                branches = [(frozenset(), "")]
        return branches

    found = {frozenset(close(b)[0]) for b in walk(_parser.parse(pattern), [(frozenset(), "")])}
    return [frozenset()] if frozenset() in found else sorted((f for f in found if not any(o < f for o in found)), key=sorted)


def _key(text: Column) -> Column:
    return F.xxhash64("doc_id", text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(key, trigram): which documents hold which of the trigrams, in any case of their letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return docs.select(_key(text).alias("key"), low.alias("low")).select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, dict[str, list[frozenset[str]]]]:
    """(key, kinds): the rules that may match a document; and the queries of the rules that have any."""
    queries = {r.kind: q for r in rules if frozenset() not in (q := trigram_query(r.pattern))}
    asked = [(kind, n, len(grams), gram) for kind, q in queries.items() for n, grams in enumerate(q) for gram in sorted(grams)]
    if not asked:
        return None, queries
    grams = sorted({a[3] for a in asked})
    spark = docs.sparkSession
    wanted = F.broadcast(small_frame(spark, asked, "kind string, alternative int, needs int, trigram string"))  # as many rows as the rules have trigrams
    hits = (
        postings(docs, grams).distinct().join(wanted, "trigram")
        .groupBy("key", "kind", "alternative", "needs").count().where("count = needs")
    )
    return hits.groupBy("key").agg(F.collect_set("kind").alias("kinds")), queries


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine, start: Column, levels: int = 3, block: int = 32) -> Column:
    """``combine`` (associative, ``start`` neutral) of the values before each one.

    A state that grows by one value a step would copy itself each time; blocks are folded first, so the work is linear
    in the number of values up to some block ** levels of them and one level's square beyond.
    """

    def grown(part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda out, v: F.concat(out, F.array(combine(F.element_at(out, -1), v))))

    def body(all_values: Column) -> Column:
        if not levels:
            return F.slice(grown(all_values), 1, F.size(all_values))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / block).cast("int")), lambda b: F.slice(all_values, b * block + 1, block))
        return _let(parts, lambda p: _let(
            running(F.transform(p, lambda part: F.aggregate(part, start, combine)), combine, start, levels - 1, block),
            lambda before: F.flatten(F.transform(p, lambda part, k: F.transform(F.slice(grown(part), 1, F.size(part)), lambda v: combine(before[k], v))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, body(v)).otherwise(F.slice(v, 1, 0)))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of a rule's matches, end exclusive."""
    pattern = F.lit(rule.exact or rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, rule.exact or rule.pattern, -1)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    empty = F.array().cast("array<struct<start:int,end:int>>")
    sizes = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("whole"), kept.alias("part")),
        lambda m: F.struct(F.length(m["piece"]).alias("gap"), F.length(m["whole"]).alias("long"), (F.length(m["part"]) >= rule.least).alias("kept")))

    def placed(matches: Column) -> Column:
        before = running(F.transform(matches, lambda m: m["gap"] + m["long"]), lambda a, b: a + b, F.lit(0))
        spans = F.zip_with(matches, before, lambda m, at: F.struct(
            (at + m["gap"]).alias("start"), (at + m["gap"] + m["long"]).alias("end"), m["kept"].alias("kept")))
        return F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(F.regexp_like(text, pattern), _let(sizes, placed)).otherwise(empty)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, end, rank, kind), by start and order of the rules."""
    may, queries = candidates(docs, rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    with_kinds = docs.withColumn("__scan_key", _key(text))
    if may is None:
        with_kinds = with_kinds.withColumn("__scan_kinds", F.array().cast("array<string>"))
    else:
        with_kinds = with_kinds.join(may.select(F.col("key").alias("__scan_key"), F.col("kinds").alias("__scan_kinds")), "__scan_key", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        found = spans_of(text, rule)
        if rule.kind in queries:
            found = F.when(F.array_contains("__scan_kinds", rule.kind), found).otherwise(none)
        parts.append(_ranked(found, rank, rule.kind))
    return with_kinds.withColumn(out, F.array_sort(F.concat(*parts))).drop("__scan_key", "__scan_kinds")


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))


def _count(kind: str) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs.select("doc_id", "text"), rules).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[_count(r.kind) for r in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; n_chars follows where it is a column."""
    found = find_secrets(docs, rules, "__scan_spans")  # a column of the documents' own may be called secret_spans
    text, spans = F.col("text"), F.col("__scan_spans")
    before = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    pieces = F.zip_with(spans, before, lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(
        F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mask))))
    done = F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))
    changed = F.size("__scan_spans") > 0
    out = found.withColumn("text", F.when(changed, done).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
