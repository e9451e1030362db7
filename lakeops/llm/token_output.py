"""Token-ID / binary output in training order: a keyed Feistel permutation gives every sequence a global slot.

Texts become token ids, ids become sequences of a fixed length, and sequence number i of the stored table (files by
path, rows in file order) gets the slot that the permutation maps i to: a Feistel network over the smallest even number
of bits that holds all numbers, walked on until it lands below their count. So the slots are a permutation, any of them
can be worked out alone, and they depend on key and stored files only, not on how Spark splits the files.

A shard file holds ``per_shard`` slots in order, each at ``slot % per_shard * stride``; one task writes it under a name of
its own and renames it when it is whole, so retries and speculative tasks do no harm. Reading is sequential, and resumes
at any slot. A file of the right size is not written again with ``resume``.

The ids are those of a tokenizer file (``tokenizer``; the registered query names the public vocabulary), little-endian in 2
or 4 bytes each, whichever the vocabulary needs. The two largest values of that width mark the end of a text and fill its
last sequence; they are never ids, also where a text holds the string of a special token. Without a tokenizer the ids are
the UTF-8 bytes themselves (0xFF ends and 0xFE fills, neither is ever part of UTF-8).

Texts are encoded once: their ids are written to the shared folder with the number of sequences before them in their
split. The sequences of each split are added up from there, so slots follow from the real token counts. Sequences go to
their shards in a code of few bits (``bitcode``) made from the counts of all ids; the shards hold the ids as they are.

Cases: a null or empty text is one sequence with only the end; repeated rows and null ids are sequences like others; a
very long text is as many sequences as it needs; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm import bitcode, bpe, common
from lakeops.session import scratch_path

LENGTH = 512
PER_SHARD = 16_384
KEY = 0x5EED
ROUNDS = 6
#: Bytes of coded sequences that are read together.
READ_BYTES = 4 << 20


def permute(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers below ``n``: a permutation of range(n)."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = common.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for k in keys:
            left, right = right, left ^ (common.mix(right ^ k) & low)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def id_type(tokenizer: str | None) -> np.dtype:
    """How an id is stored: the narrowest of 2 and 4 bytes that leaves two values free, one byte without a tokenizer."""
    if tokenizer is None:
        return np.dtype("u1")
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    largest = max(chain(spec["model"]["vocab"].values(), (t["id"] for t in spec["added_tokens"])))
    return np.dtype("<u2" if largest < 0xFFFE else "<u4")


def end_and_fill(kind: np.dtype) -> tuple[int, int]:
    """The values after a text and after its end: the two largest of the width."""
    return int(np.iinfo(kind).max), int(np.iinfo(kind).max) - 1


def _spans(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _encoded(docs: DataFrame, tokenizer: str | None, ids: np.dtype, length: int) -> DataFrame:
    """(doc_id, file, block, before, many, ids): the ids of each row's text, its sequences and those before it in its split."""
    spans = _spans(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], int] = {}
        for batch in common.runs(batches, "text", bpe.TRIE_BYTES if tokenizer else common.RUN_BYTES):
            if tokenizer:
                flat, offsets = bpe.load(tokenizer).encode_arrays([t or "" for t in batch.column("text").to_pylist()])
            else:
                flat, offsets = common.raw_bytes_of(batch.column("text"))
            many = (np.diff(offsets) + length) // length
            bodies = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(offsets * ids.itemsize), pa.py_buffer(flat.astype(ids))])
            many, before = many.tolist(), []
            for place, n in zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True), many, strict=True):
                before.append(done.get(place, 0))
                done[place] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("block"), pa.array(before, pa.int64()), pa.array(many, pa.int64()), bodies.cast(pa.binary())],
                names=["doc_id", "file", "block", "before", "many", "ids"])

    return spans.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, file string, block bigint, before bigint, many bigint, ids binary")


def _stored(encoded: DataFrame) -> DataFrame:
    """``encoded`` written to and read from the shared folder; ids of 2 bytes shrink to about half in pages of this size."""
    path = scratch_path(encoded.sparkSession, "token-ids")
    encoded.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": 9, "parquet.page.size": 8 << 20}).parquet(path)
    return encoded.sparkSession.read.schema(encoded.schema).parquet(path)


def _code(encoded: DataFrame, ids: np.dtype, texts: int) -> bitcode.BitCode:
    """The code of all ids and of the end, the symbol after the largest id; as many counts as the vocabulary has reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in common.runs(batches, "ids"):
            part = np.bincount(common.raw_bytes_of(batch.column("ids"))[0].view(ids), minlength=len(total))
            part[:len(total)] += total
            total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in found], default=-1) + 2, np.int64)
    for r in found:
        counts[r.id] = r.n
    counts[-1] = max(texts, 1)
    return bitcode.BitCode(counts, np.append(np.arange(len(counts) - 1), end_and_fill(ids)[0]))


def materialise(docs: DataFrame, out_dir: str, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD, resume: bool = False, tokenizer: str | None = None) -> DataFrame:
    """Encode the texts of ``docs`` (read from files), and write the shards below ``out_dir`` when the result is computed.

    One row per sequence: doc_id, seq (its number in the text), n_tokens (with the end), slot, shard, offset (bytes).
    """
    ids = id_type(tokenizer)
    encoded = _stored(_encoded(docs, tokenizer, ids, length))
    # sequences before each split of each file: as many rows as there are splits
    splits = encoded.groupBy("file", "block").agg(F.sum("many").alias("n"), F.count("*").alias("texts")).orderBy("file", "block").collect()
    before, total = {}, 0
    for r in splits:
        before[r.file, r.block] = total
        total += r.n
    known = docs.sparkSession.sparkContext.broadcast(before)
    code = docs.sparkSession.sparkContext.broadcast(_code(encoded, ids, sum(r.texts for r in splits)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "ids"):
            data, offsets = common.raw_bytes_of(batch.column("ids"))
            data, offsets = data.view(ids), offsets // ids.itemsize
            size, many = np.diff(offsets), batch.column("many").to_numpy()
            inner = np.ones(len(data) + len(size), bool)
            inner[offsets[1:] + np.arange(len(size))] = False
            symbols = np.full(len(inner), len(code.value.length) - 1)
            symbols[inner] = data
            places = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)
            base = np.array([known.value[place] for place in places], np.int64) + batch.column("before").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), many)
            seq = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
            held = np.minimum(size[owner] + 1 - seq * length, length)
            packed, borders = code.value.pack(symbols, held)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(owner)), pa.array(seq.astype(np.int32)), pa.array(held.astype(np.int32)), pa.array(permute(base[owner] + seq, total, key)),
                pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(packed)])],
                names=["doc_id", "seq", "n_tokens", "slot", "packed"])

    numbered = encoded.mapInArrow(number, f"doc_id {kind}, seq int, n_tokens int, slot bigint, packed binary")
    shards = max(1, -(-total // per_shard))
    dealt = numbered.repartitionById(shards, F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot")
    return dealt.mapInArrow(_writer(out_dir, ids, length, per_shard, total, resume, code), f"doc_id {kind}, seq int, n_tokens int, slot bigint, shard int, offset bigint")


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _writer(out_dir: str, ids: np.dtype, length: int, per_shard: int, total: int, resume: bool, code: Broadcast):
    stride, fill = length * ids.itemsize, end_and_fill(ids)[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        open_: tuple[int, str, pa.NativeFile] | None = None

        def close():
            shard, name, stream = open_
            stream.close()
            store.move(name, f"{root}/{shard_name(shard)}")

        for batch in common.runs(batches, "packed", READ_BYTES):
            slots, held = batch.column("slot").to_numpy(), batch.column("n_tokens").to_numpy()
            data, offsets = common.raw_bytes_of(batch.column("packed"))
            shards = slots // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                shard = int(shards[a])
                if open_ is None or open_[0] != shard:
                    if open_ is not None:
                        close()
                    open_ = None
                    whole = min(per_shard, total - shard * per_shard) * stride
                    if not (resume and store.get_file_info(f"{root}/{shard_name(shard)}").size == whole):
                        name = f"{root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                        open_ = shard, name, store.open_output_stream(name)
                if open_ is not None:
                    rows = np.full((b - a, length), fill, ids)
                    open_[2].write(code.value.unpack(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], held[a:b], rows).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("doc_id", "seq", "n_tokens", "slot")], pa.array(shards.astype(np.int32)), pa.array(slots % per_shard * stride)], names=["doc_id", "seq", "n_tokens", "slot", "shard", "offset"])
        if open_ is not None:
            close()

    return write


def read_slots(out_dir: str, first: int, end: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 1) -> Iterator[bytes]:
    """Sequences ``first`` to ``end`` in training order, shard after shard; reading resumes at any slot. ``width``: bytes an id."""
    store, root = fs.FileSystem.from_uri(out_dir)
    while first < end:
        shard, last = first // per_shard, min(end, (first // per_shard + 1) * per_shard)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(first % per_shard * length * width)
            for _ in range(first, last):
                yield f.read(length * width)
        first = last
