"""Phrase collocation mining: SON partitioning, level by level.

Words (A-Z lower-cased, ended by spaces, tabs and the piece marks) are coded once, in blocks of one language, and
written; every later pass reads those blocks. Each block belongs to one of ``SHARDS`` shards of the corpus.

* A shard is mined completely at its proportionally lowered support: ``ceil(least * shard's words / all words)`` of the
  language. A phrase with ``least`` occurrences in all reaches that in at least one shard, so the union of the locally
  frequent phrases holds every frequent one. Their number of shards is fixed, so supports do not sink as the corpus
  grows; a shard spans many blocks and tasks.
* The candidates of the union are counted exactly over all shards. Counts of one phrase meet in one task, shard by
  shard, so local support and global count take one shuffle of counts a block has already added up.
* Lengths follow each other: a phrase of k words is only mined where both its parts of k - 1 words are frequent in all.
  Tasks ask a bitmap of ``BITS`` bits (16 MB, whatever the corpus holds); a false answer costs a row, never a result.

Scores come from joins on (language, phrase), in decimals.

Cases: a null text is empty; a null language is ``und``; repeated documents count again; a very long text is cut into
no parts; phrases are told apart by their words, hashes only steer the bitmap; other columns are ignored; tables
without rows, or without frequent phrases, give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.llm import common

#: Occurrences that make a phrase a candidate, and the most words it may have.
LEAST, WORDS = 30, 4
#: Longer candidates with this share (percent) of a candidate's occurrences replace it.
COVERED = 80
#: Reported phrases a language.
TOP = 2000
SHARDS = 10
#: Documents, and blocks, that one Arrow batch hands to Python: what JVM and worker hold of them at a time.
BATCH_DOCUMENTS, BATCH_BLOCKS = 1200, 2
#: Bits of the map of frequent phrases.
BITS = 1 << 27
#: Bytes of text coded in one block.
BLOCK_BYTES = 4 << 20
_CHUNK = 1 << 15

#: Bytes that end a piece; spaces and tabs end words within one.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_WORD = ~_MARK
_WORD[[0x20, 0x09]] = False


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Jobs run inside hand ``rows`` rows at a time to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def coded_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """Blocks of one language, written: lang, shard, n (words), dictionary (words) and codes (int32, -1 between pieces)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text", block_bytes):
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, k)) if len(langs.dictionary) > 1 else batch.column("text")
                data, offsets = common.bytes_of(texts)
                starts, ends, at = common.words_of(data, offsets, _WORD)
                if not len(starts):
                    continue
                words = common.joined_words(data, starts, ends)
                ids = _words_array(*words).dictionary_encode()
                # a mark between two words, or the border of two texts, ends a piece
                marks = np.concatenate(([0], np.cumsum(_MARK[data])))[starts]
                first = np.concatenate(([False], np.diff(marks) > 0))
                first[at[1:-1][at[1:-1] < len(starts)]] = True
                codes = np.insert(ids.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.flatnonzero(first), -1).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang], pa.string()), pa.array([zlib.crc32(codes) % shards], pa.int32()), pa.array([len(starts)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids.dictionary)], pa.int32()), ids.dictionary.cast(pa.string())), pa.array([codes], pa.binary())],
                    names=["lang", "shard", "n", "dictionary", "codes"])

    with small_batches(docs.sparkSession, BATCH_DOCUMENTS):
        return common.cut(docs.mapInArrow(code, "lang string, shard int, n bigint, dictionary array<string>, codes binary"), "phrase-blocks")


def _words_array(joined: bytes, begin: np.ndarray) -> pa.Array:
    """Words that lie in ``joined`` with one space after each, as an Arrow array."""
    with_space = pa.Array.from_buffers(pa.large_string(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(joined)])
    return pc.utf8_rtrim(with_space, " ")


def _word_keys(lang: str, dictionary: pa.Array) -> np.ndarray:
    data, offsets = common.raw_bytes_of(dictionary)
    return _keys_of(lang, common.fingerprints(data, offsets[:-1], offsets[1:]))


def _keys_of(lang: str, prints: np.ndarray) -> np.ndarray:
    return common.mix(prints ^ np.uint64(zlib.crc32(lang.encode())))


def _longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases with one more word at their end."""
    return common.mix(keys * np.uint64(0x9E3779B97F4A7C15) + words)


def _in_map(chunks: dict[int, bytes], keys: np.ndarray, bits: int) -> np.ndarray:
    flat = chunks.get("flat")
    if flat is None:
        flat = np.zeros(bits // 8, np.uint8)
        for k, chunk in chunks.items():
            flat[k * _CHUNK // 8:(k + 1) * _CHUNK // 8] = np.frombuffer(chunk, np.uint8)
        chunks.clear()
        chunks["flat"] = flat
    place = (keys % np.uint64(bits)).astype(np.int64)
    return (flat[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def block_counts(blocks: DataFrame, size: int, known, bits: int = BITS) -> DataFrame:
    """(lang, phrase, shard, c): phrases of ``size`` words in each block whose parts are in the map ``known``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, shard = batch.column("lang")[k].as_py(), batch.column("shard")[k].as_py()
                words = batch.column("dictionary")[k].values
                codes = np.frombuffer(batch.column("codes")[k].as_buffer(), np.int32)
                yield from _counted(lang, shard, words, codes, size, known.value if known else None, bits)

    return blocks.select("lang", "shard", "dictionary", "codes").mapInArrow(count, "lang string, phrase string, shard int, c bigint")


def _counted(lang, shard, words, codes, size, chunks, bits) -> Iterator[pa.RecordBatch]:
    if size == 1:
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        parts = [words]
    else:
        own = np.append(_word_keys(lang, words), np.uint64(0))  # the last one stands for -1
        # places where a phrase of size - 1 words lies in one piece and is frequent
        key, good = own[codes], codes >= 0
        for j in range(1, size - 1):
            key = _longer(key[:-1], own[codes[j:]])
            good = good[:-1] & (codes[j:] >= 0)
        good[good] = _in_map(chunks, key[good], bits)
        at = np.flatnonzero(good[:-1] & good[1:])
        if not len(at):
            return
        # equal phrases by their codes: one number for the words so far, then for those and the next
        number = codes[at].astype(np.int64)
        for j in range(1, size):
            distinct, number = np.unique(number * len(words) + codes[at + j], return_inverse=True)
        parts_at = np.empty(len(distinct), np.int64)
        parts_at[number] = at
        counts = np.bincount(number, minlength=len(distinct))
        parts = [words.take(pa.array(codes[parts_at + j])) for j in range(size)]
    phrases = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
    for a in range(0, len(counts), 1 << 16):
        b = min(a + (1 << 16), len(counts))
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * (b - a), pa.string()), phrases.slice(a, b - a).cast(pa.string()), pa.array(np.full(b - a, shard, np.int32)),
            pa.array(counts[a:b], pa.int64())], names=["lang", "phrase", "shard", "c"])


def frequent(counts: DataFrame, shares: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a), written: phrases at local support in some shard, and with ``least`` occurrences in all."""
    local = (
        counts.repartition("lang", "phrase").groupBy("lang", "phrase", "shard").agg(F.sum("c").alias("c"))
        .join(shares, ["lang", "shard"])
    )
    whole = local.groupBy("lang", "phrase").agg(
        F.sum("c").alias("a"), F.max(F.col("c") >= F.col("support")).alias("candidate"))
    with small_batches(counts.sparkSession, BATCH_BLOCKS):
        return common.cut(whole.where(F.col("candidate") & (F.col("a") >= least)).drop("candidate"), "frequent-phrases")


def bitmap(found: DataFrame, bits: int = BITS) -> dict[int, bytes]:
    """The places of the phrases as bits, in chunks; no more than ``bits`` bits are ever held."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = common.raw_bytes_of(batch.column("phrase").filter(pc.equal(langs.indices, k)))
                starts, ends, at = common.words_of(data, offsets, _WORD)
                own, size = _keys_of(lang, common.fingerprints(data, starts, ends)), np.diff(at)
                keys = own[at[:-1]]
                for j in range(1, int(size.max())):
                    keys = np.where(size > j, _longer(keys, own[np.minimum(at[:-1] + j, len(own) - 1)]), keys)
                yield pa.RecordBatch.from_arrays([pa.array((keys % np.uint64(bits)).astype(np.int64) + 1)], names=["place"])

    place = found.select("lang", "phrase").mapInArrow(places, "place bigint")
    chunks = place.groupBy(F.bitmap_bucket_number("place").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    return {r.chunk - 1: bytes(r.bits) for r in chunks.toLocalIterator()}


def shard_supports(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, shard, n, support), written: words of the language in all, and the local support of each shard."""
    own = blocks.groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    n = own.groupBy("lang").agg(F.sum("own").alias("n"))
    whole, share = F.col("n").cast("decimal(20,0)"), F.col("own").cast("decimal(20,0)")
    return common.cut(own.join(n, "lang").select("lang", "shard", "n", F.ceil(share * least / whole).cast("bigint").alias("support")), "shard-supports")


def frequent_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, a) of all phrases of 1 to ``words`` words and ``least`` occurrences; the shards' supports)."""
    blocks = coded_blocks(docs, block_bytes, shards)
    supports = shard_supports(blocks, least)
    out, known = None, None
    for size in range(1, words + 1):
        level = frequent(block_counts(blocks, size, known, bits), supports.select("lang", "shard", "support"), least)
        part = level.select("lang", "phrase", F.lit(size).alias("size"), "a")
        out = part if out is None else out.union(part)
        if size < words:
            known = docs.sparkSession.sparkContext.broadcast(bitmap(level, bits))
    return out, supports


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, covered: int = COVERED, top: int = TOP, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    found, supports = frequent_phrases(docs, least, words, block_bytes, shards, bits)
    candidates = found.where("size > 1").withColumn("words", F.split("phrase", " "))
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    # every cut asks for its two parts
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    asked = candidates.select("lang", "phrase", "size", "a", "words", cut).select(
        "lang", "phrase", "a", "k", F.explode(F.array(
            F.struct(F.lit(True).alias("first"), _part(1, F.col("k")).alias("part")),
            F.struct(F.lit(False).alias("first"), _part(F.col("k") + 1, F.col("size")).alias("part")))).alias("p"))
    cuts = asked.select("lang", "phrase", "a", "k", "p.first", "p.part").join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer candidate asks for all phrases of two words or more inside it
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))).alias("phrase")
    longer = candidates.where("size > 2").select("lang", F.col("a").alias("longer"), inner).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(supports.select("lang", "n").distinct(), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))


#: DuckDB SQL for the rows of ``collocations`` over ``documents`` with the defaults.
ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') as words
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as p from documents)
), totals as (
  select lang, sum(len(words)) as n from pieces group by lang
), grams as (
  select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase
  from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as k))
), found as (
  select lang, k, phrase, count(*)::hugeint as a, string_split(phrase, ' ') as words from grams group by lang, k, phrase having count(*) >= 30
), cuts as (
  select c.lang, c.phrase, c.a, j, l.a as l, r.a as r, 2000000 * c.a // (l.a + r.a) as score
  from (select *, unnest(range(1, k)) as j from found where k > 1) c
  join found l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:j], ' ')
  join found r on r.lang = c.lang and r.phrase = array_to_string(c.words[j + 1:c.k], ' ')
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), inside as (
  select lang, phrase, max(a) as longer from (
    select lang, a, array_to_string(words[i:i + m - 1], ' ') as phrase
    from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from found where k > 2)))
  group by lang, phrase
), ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
  from lowest s left join inside i on i.lang = s.lang and i.phrase = s.phrase
  where i.longer is null or 100 * i.longer < 80 * s.a
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
