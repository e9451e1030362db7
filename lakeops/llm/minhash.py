"""Document fingerprints: one-permutation MinHash of word shingles, densified, packed to low-order bits.

* Every shingle (``SIZE`` words, A-Z lower-cased, ended by white space) is hashed once; the top bits of the hash name
  its bin, and each of the ``BINS`` bins keeps its least hash. A text of fewer words is one shingle, also one without
  words, so every text has a fingerprint and equal texts have equal ones.
* An empty bin takes the value of another one: bin b asks the bins (A[b] + t * B[b]) mod BINS for t = 0, 1, 2, ... until
  one is filled. A and B (odd) come from a universal hash of b, so each empty bin follows an order of its own, the same
  in every text, and visits every bin. The first ``PROBES`` questions are asked one by one; where all fail (few
  shingles), the filled bin that the order reaches first is found among the filled ones.
* A bin keeps four low-order bits of its value, one hexadecimal digit: bin b those from bit 4 * (b mod 13), so that a
  value that many bins share does not agree with another by chance in all of them.
* The likeness of two fingerprints is the share of equal digits, less the share 1/16 that differing values agree in by
  chance, scaled to 0 .. 1. At a likeness of 1/3 its standard error is about 0.034 for texts of many shingles.

DataFrame functions only; texts lie in arrays of one row, never in groups.

Cases: a null text is empty; a null id comes after all others; rows of one id are ordered by the SHA-256 of their text,
equal rows follow each other; very long texts are fingerprinted whole; other columns are ignored; a table without rows
gives no rows, one row is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm import common

#: Words of a shingle, bins (a power of two), and questions an empty bin asks one by one.
SIZE, BINS, PROBES = 5, 256, 16
_BIN_BITS = BINS.bit_length() - 1


def _universal(k: int, a: int, b: int) -> int:
    """Universal hash of a bin: the high bits of (a k + b) modulo the prime 2^61 - 1."""
    return ((a * (k + 1) + b) % ((1 << 61) - 1)) >> 20


#: First bin that an empty one asks, and the step from one to the next.
FIRST = [_universal(k, 0x1D8E4E27C47D124F, 0x0B4E0EF37BC32127) % BINS for k in range(BINS)]
STEP = [_universal(k, 0x0A5A8F2C3B1E7D55, 0x12F6D3A98C7B4E61) % BINS | 1 for k in range(BINS)]
_BACK = [pow(s, -1, BINS) for s in STEP]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """One 64-bit hash per shingle, repeats included."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + j] for j in range(size)]))))


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - _BIN_BITS).cast("int")


def least_of_bins(hashes: Column) -> Column:
    """Array of ``BINS``: the least hash of each bin, null where it is empty."""

    def spread(least: Column) -> Column:
        before = lambda i: F.when(i == 0, -1).otherwise(_bin(least[F.greatest(i - 1, F.lit(0))]))
        none = F.lit(None).cast("bigint")
        filled = F.flatten(F.transform(least, lambda v, i: F.concat(F.array_repeat(none, _bin(v) - before(i) - 1), F.array(v))))
        return F.concat(filled, F.array_repeat(none, BINS - 1 - _bin(F.element_at(least, -1))))

    # in the order of (bin, rest), unsigned: the first of each bin is its least
    flip = F.lit(-(1 << 63)).cast("bigint")
    ordered = F.transform(F.sort_array(F.transform(hashes, lambda v: v.bitwiseXOR(flip))), lambda v: v.bitwiseXOR(flip))
    return _let(ordered, lambda h: _let(F.filter(h, lambda v, i: (i == 0) | (_bin(v) != _bin(h[F.greatest(i - 1, F.lit(0))]))), spread))


def packed(bins: Column) -> Column:
    """One digit per bin; an empty bin takes the value of the first filled one in its own order."""
    first, step, back = (F.array(*map(F.lit, values)) for values in (FIRST, STEP, _BACK))
    digits = F.array(*[F.lit(c) for c in "0123456789abcdef"])

    def fill(bins: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda e: bins[e].isNotNull())

        def digit(b: Column) -> Column:
            nearest = F.array_min(F.transform(places, lambda e: F.pmod((e - first[b]) * back[b], F.lit(BINS))))
            value = F.coalesce(
                bins[b], *[bins[F.pmod(first[b] + t * step[b], F.lit(BINS))] for t in range(PROBES)],
                bins[F.pmod(first[b] + nearest * step[b], F.lit(BINS))])
            return digits[_shifted(value, b).bitwiseAND(F.lit(15)).cast("int")]

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), digit), "")

    return _let(bins, fill)


def _shifted(value: Column, b: Column) -> Column:
    """The value without the low bits that earlier bins keep: bins that share a value keep different bits of it."""
    return F.call_function("shiftright", value, (b % F.lit((64 - _BIN_BITS) // 4 - 1)) * 4)


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """The packed fingerprint of a text (a null one is empty)."""
    return packed(least_of_bins(shingle_hashes(F.coalesce(text, F.lit("")), size)))


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, corrected for digits that agree by chance."""
    equal = F.size(F.filter(F.zip_with(F.split(one, ""), F.split(other, ""), lambda a, b: a == b), lambda same: same)) / F.lit(BINS)
    return F.greatest(F.lit(0.0), (equal - 1 / 16) / F.lit(1 - 1 / 16))


def with_fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``fingerprint``."""
    return docs.withColumn("fingerprint", fingerprint(F.col("text"), size))


def followers(rows: DataFrame) -> DataFrame:
    """Distinct (doc_id, digest, key) with ``next_key``: by descending id, then digest; the last is followed by the
    first. No task orders more than a range of them."""
    order = [F.desc_nulls_last("doc_id"), F.col("digest")]
    ranged = common.cut(rows.repartitionByRange(*order).select("doc_id", "digest", "key", F.spark_partition_id().alias("range")), "ranged-ids")
    inside = Window.partitionBy("range").orderBy(*order)
    linked = ranged.select("range", "key", F.lead("key").over(inside).alias("next"), F.row_number().over(inside).alias("n"))
    # one row per range, so as many as a shuffle has partitions: what follows the range's last row
    around = Window.orderBy("range")
    first = F.first("key").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = linked.where("n = 1").select("range", F.coalesce(F.lead("key").over(around), first).alias("after"))
    return linked.join(F.broadcast(after), "range").select("key", F.coalesce("next", "after").alias("next_key"))


def report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: its fingerprint, that of its text with the last half replaced by the next document's
    beginning, and the likeness of its fingerprint to this and to the next document's."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    known = F.concat(F.when(F.col("doc_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string"))), F.lit(" "), "digest")
    base = base.withColumn("key", F.coalesce(F.sha2(known, 256), F.lit("")))
    groups = base.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"))
    groups = common.cut(groups, "document-keys")
    half = F.floor(F.col("n") / 2).cast("int").alias("half")
    links = common.cut(followers(groups.select("doc_id", "digest", "key")).join(groups.select("key", "doc_id", "copies", half), "key"), "followers")
    # rows equal in id and text once; both joins read this shuffle of texts, and only beginnings move again
    once = with_fingerprints(base, size).groupBy("key").agg(*[F.first(c).alias(c) for c in ("text", "fingerprint")])
    heads = once.join(links.withColumnRenamed("key", "for_key"), F.col("key") == F.col("next_key")).select(
        F.col("for_key").alias("key"), "doc_id", "half", "copies", F.left("text", F.col("half")).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    # of equal rows all but one are followed by their like
    own = F.struct(F.left("text", F.col("half")).alias("head"), F.col("fingerprint").alias("next_fingerprint"), (F.col("copies") - 1).alias("times"))
    last = F.struct("head", "next_fingerprint", F.lit(1).cast("bigint").alias("times"))
    rows = once.join(heads, "key").select(
        "doc_id", "text", "half", "fingerprint", F.explode(F.when(F.col("copies") > 1, F.array(last, own)).otherwise(F.array(last))).alias("next"))
    edited = F.concat(F.left("text", F.length("text") - F.col("half")), F.col("next.head"))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "fingerprint", edited.alias("edited"), "next.next_fingerprint", "next.times")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), size).alias("edited_fingerprint"),
        "next_fingerprint", "times")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("col")
