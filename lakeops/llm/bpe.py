"""BPE encoding and decoding: the distinct words of a batch form a trie, walked depth-first with last-token states.

For every prefix of a word there is exactly one token that ends its encoding. A prefix' last token is found among the
vocabulary's suffixes of that prefix: the one that may follow the last token of what stands before it. Sorted, the
words of a batch are their trie in depth-first order: a word keeps the states of the prefix it shares with the word
before, so the encoding of a shared prefix is worked out once. Walking the states back from a word's end gives its
tokens. The word's last symbol has its own form (``</w>``), so it is a leaf below the prefix without it.

Documents are encoded where they lie, without a shuffle. Words seen before in a Python worker come from a table that
is emptied at ``MEMO_WORDS`` words, so memory is bounded and results do not depend on it.

``encode_arrays`` gives the same ids as arrays, for outputs that store them. The words between white space are found and
told apart as whole Arrow columns; the distinct words of up to ``ROUNDS_BYTES`` bytes are merged together, one merge of each word
a round, so the rounds are bounded; longer words go through the trie. It keeps no table from one batch to the next.

Cases: a null text is empty and has no tokens; strings of special tokens in a text are those tokens, as in the
tokenizer file; very long texts and words are worked on whole; rows are independent of each other.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeops.llm import common

#: Words kept per Python worker before the table is emptied.
MEMO_WORDS = 400_000
#: Characters of a word up to which its encoding is kept.
MEMO_CHARS = 64
#: Bytes of text whose distinct words make one trie.
TRIE_BYTES = 8 << 20
#: Bytes of a word up to which ``encode_arrays`` merges it in rounds with all others.
ROUNDS_BYTES = 64

_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\S+")


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + size]`` end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PairRanks:
    """Ranks of pairs of tokens for whole arrays: a hash table with linear probing; pairs without a merge get ``NONE``."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, merge: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(merge)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        for (a, b), rank in merge.items():
            key = a << 32 | b
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)
            while self.keys[at] >= 0:
                at = at + 1 & self.last
            self.keys[at], self.ranks[at] = key, rank

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out, found = self.ranks[at], self.keys[at]
        pending = np.flatnonzero(found != key)
        out[pending] = self.NONE
        pending = pending[found[pending] >= 0]
        while len(pending):
            at[pending] = at[pending] + 1 & self.last
            found = self.keys[at[pending]]
            hit = found == key[pending]
            out[pending[hit]] = self.ranks[at[pending[hit]]]
            pending = pending[(found >= 0) & ~hit]
        return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer file with NFC, one space for white space, lower case; split by a pattern; byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in (self.tokens | self.special).items()}
        self.letters = byte_letters()
        # rank of the merge that makes a token of two; -1 marks tokens that no merge makes
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {(self.tokens[a], self.tokens[b]): k for k, (a, b) in enumerate(pairs)}
        self.parts = {self.tokens[a + b]: (self.tokens[a], self.tokens[b], k) for k, (a, b) in enumerate(pairs)}
        # letters that some token ends with -> that token, or -1 where they only end longer ones; by inner tokens and word ends
        self.tails: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for token, k in self.tokens.items():
            ends = token.endswith(self.suffix) and token != self.suffix
            name, tails = token.removesuffix(self.suffix) if ends else token, self.tails[ends]
            for i in range(1, len(name)):
                tails.setdefault(name[i:], -1)
            tails[name] = k
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.sizes: dict[int, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.memo: dict[str | int, tuple[int, ...]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at a token's outer edge (0: left, 1: right) from symbol to token, each with the rank that ends it."""
        known = (self.left, self.right)[side]
        if token not in known:
            chain, rank, at = [], float("inf"), token
            while True:
                chain.append((at, rank))
                if at not in self.parts:
                    break
                rank, at = self.parts[at][2], self.parts[at][side]
            known[token] = chain[::-1]
        return known[token]

    def may_follow(self, a: int, b: int) -> bool:
        """No merge joins the seam of ``a`` and ``b`` before both are complete.

        While their outer parts form, the part at the right of ``a`` and the one at the left of ``b`` meet at the
        seam. If they have a merge of lower rank than the ones that use them up, it comes first (between equal ranks
        the one further left does) and the pair is no encoding.
        """
        known = self.follows.get((a, b))
        if known is not None:
            return known
        x, y, i, j, good = self.edge(a, 1), self.edge(b, 0), 0, 0, True
        while i < len(x) and j < len(y):
            (p, p_end), (q, q_end) = x[i], y[j]
            rank = self.merge.get((p, q))
            if rank is not None and rank < p_end and rank <= q_end:
                good = False
                break
            if p_end <= q_end:
                i += 1
            else:
                j += 1
        if len(self.follows) > 4 * MEMO_WORDS:
            self.follows.clear()
        self.follows[a, b] = good
        return good

    def is_whole(self, token: int) -> bool:
        """The token's own letters encode to it (true for all that merges make unless another merge comes first)."""
        known = self.whole.get(token)
        if known is None:
            known = True
            if token in self.parts:
                a, b, rank = self.parts[token]
                known = self.is_whole(a) and self.is_whole(b) and self.joins(a, b, rank)
            self.whole[token] = known
        return known

    def joins(self, a: int, b: int, rank: int) -> bool:
        """Nothing joins the seam of ``a`` and ``b`` before the merge of the two itself."""
        x, y, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while i < len(x) and j < len(y):
            (p, p_end), (q, q_end) = x[i], y[j]
            found = self.merge.get((p, q))
            if found is not None and found != rank and found < p_end and found <= q_end:
                return False
            if p_end <= q_end:
                i += 1
            else:
                j += 1
        return True

    def last_token(self, prefix: str, depth: int, states: list[int], tails: dict[str, int]) -> int:
        """The one token that ends the encoding of ``prefix`` (``depth`` letters); ``tails``: inner tokens or word ends."""
        fits = []
        for at in range(depth - 1, -1, -1):
            token = tails.get(prefix[at:depth])
            if token is None:
                break
            if token >= 0:
                fits.append((at, token))
        follows = self.follows
        for at, token in reversed(fits):
            if not self.is_whole(token):
                continue
            if not at:
                return token
            good = follows.get((states[at], token))
            if good is None:
                good = self.may_follow(states[at], token)
            if good:
                return token
        raise ValueError(f"no token ends {prefix[:depth]!r}")

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words, by a depth-first walk of their trie."""
        letters = self.letters
        spelled = sorted(("".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]), w) for w in words)
        out, states, before = {}, [-1], ""
        inner, final = self.tails
        for prefix, word in spelled:
            n = len(prefix)
            if not n:
                out[word] = ()
                continue
            shared = 0
            most = min(len(before), n - 1, len(states) - 1)
            while shared < most and before[shared] == prefix[shared]:
                shared += 1
            del states[shared + 1:]
            for depth in range(shared + 1, n):
                states.append(self.last_token(prefix, depth, states, inner))
            before = prefix
            token = self.last_token(prefix, n, states, final)
            ids, at = [token], n - self.size(token)
            while at > 0:
                token = states[at]
                ids.append(token)
                at -= self.size(token)
            out[word] = tuple(ids[::-1])
        return out

    def size(self, token: int) -> int:
        """Letters (bytes of text) of a token."""
        sizes = self.sizes
        if token not in sizes:
            name = self.names[token]
            sizes[token] = len(name) - (len(self.suffix) if name.endswith(self.suffix) and len(name) > len(self.suffix) else 0)
        return sizes[token]

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # sigma has one lower case here, wherever it stands in a word
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str | int]:
        """What white space separates, and the ids of special tokens whose strings stand in the text."""
        if self.special_pattern is None or "<|" not in text:
            return self.split(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.split(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split(text[at:])

    def split(self, text: str) -> list[str]:
        # str.split() also splits at U+001C-U+001F, which are no white space to the tokenizer
        return self.normalized(text).split() if not _SEPARATORS.search(text) else _SPACE.findall(self.normalized(text))

    def encode_batch(self, texts: list[str]) -> Iterator[list[tuple[int, ...]]]:
        """For each text the encodings of its chunks in order. No word crosses white space."""
        chunks = [self.chunks(t) for t in texts]
        used = set().union(*chunks)
        table = {c: self.memo[c] for c in used if c in self.memo}
        new = used - table.keys()
        words = {c: self.pattern.findall(c) for c in new if isinstance(c, str)}
        distinct = {w for found in words.values() for w in found}
        known = {w: self.words[w] for w in distinct if w in self.words}
        known |= (fresh := self.encode_words([w for w in distinct if w not in known]))
        for c in new:
            table[c] = tuple([i for w in words[c] for i in known[w]]) if isinstance(c, str) else (c,)
        if len(self.words) + len(fresh) > MEMO_WORDS:
            self.words.clear()
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
        self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= MEMO_CHARS)
        self.memo.update((c, table[c]) for c in new if isinstance(c, int) or len(c) <= MEMO_CHARS)
        for found in chunks:
            yield [table[c] for c in found]

    def marked(self, text: str) -> bytes:
        """The text with ASCII white space only; a special token is a word of 0xFF, which no text holds, and its id."""
        if self.special_pattern is not None and "<|" in text:
            return b" ".join([c.encode() if isinstance(c, str) else b"\xff%d" % c for c in self.chunks(text)])
        return text.lower().encode() if text.isascii() else " ".join(self.split(text)).encode()

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids begin and end)."""
        rows = [self.marked(t) for t in texts]
        data = np.frombuffer(b" ".join([*rows, b""]), np.uint8)
        inside = common.NOT_SPACE[data]
        after = np.zeros(len(data), bool)
        after[1:] = inside[:-1] & ~inside[1:]
        before = np.searchsorted(np.flatnonzero(after), np.cumsum([0, *[len(r) + 1 for r in rows]]))
        # every chunk with one space behind it
        letters = np.where(inside, data, np.uint8(0x20))[inside | after]
        offsets = np.concatenate(([0], np.flatnonzero(letters == 0x20) + 1)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        flat, first, size = self.encode_chunks(*common.raw_bytes_of(chunks.dictionary))
        where = chunks.indices.to_numpy()
        sizes = size[where]
        return _gather(flat, first[where], sizes), np.concatenate(([0], np.cumsum(sizes)))[before]

    def encode_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, how many) of distinct chunks, each with a space behind it."""
        special = np.flatnonzero(data[offsets[:-1]] == 0xFF)
        named = np.array([int(data[offsets[k] + 1:offsets[k + 1]].tobytes()) for k in special], np.int32)
        if len(special):
            plain = np.ones(len(data), bool)
            for k in special:
                plain[offsets[k]:offsets[k + 1] - 1] = False
            data, offsets = data[plain], np.concatenate(([0], np.cumsum(plain)))[offsets]
        text = data.tobytes().decode()
        found = self.pattern.findall(text)
        data, borders = data[data != 0x20], offsets - np.arange(len(offsets))
        # the words of all chunks are all of their letters, unless the pattern leaves some out
        letters = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
        ends = np.cumsum(np.fromiter(chain((0,), map(len, found)), np.int64, len(found) + 1))
        if ends[-1] == len(letters) - 1:
            ends = letters[ends]
            at = np.searchsorted(ends, borders)
            words = pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        else:
            by_chunk = [self.pattern.findall(c) for c in text.split(" ")[:-1]]
            words, at = pa.array(chain.from_iterable(by_chunk), pa.string()), np.cumsum([0, *map(len, by_chunk)])
        words = words.dictionary_encode()
        flat, first, size = self.merge_words(words.dictionary)
        where = words.indices.to_numpy()
        sizes = size[where]
        ids, begin = _gather(flat, first[where], sizes), np.concatenate(([0], np.cumsum(sizes)))[at]
        first, size = begin[:-1], np.diff(begin)
        first[special], size[special] = len(ids) + np.arange(len(special)), 1
        return np.concatenate((ids, named)), first, size

    @cached_property
    def arrays(self) -> tuple[PairRanks, np.ndarray, np.ndarray]:
        """Ranks of pairs, the token that each merge makes, the tokens of single bytes inside (0) and at the end (1) of a word."""
        pairs = sorted(self.merge, key=self.merge.get)
        made = np.array([self.tokens[self.names[a] + self.names[b]] for a, b in pairs], np.int32)
        symbols = np.array([[self.tokens.get(x + e, -1) for x in self.letters] for e in ("", self.suffix)], np.int32)
        return PairRanks({pair: k for k, pair in enumerate(pairs)}), made, symbols

    def merge_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, how many) of distinct words: in each round every word makes its lowest merge, from left to right."""
        ranks, made, symbols = self.arrays
        data, offsets = common.raw_bytes_of(words)
        length = np.diff(offsets)
        long = np.flatnonzero(length > ROUNDS_BYTES)
        texts = words.take(pa.array(long)).to_pylist()
        known = self.encode_words(texts)
        size = np.zeros(len(length), np.int64)
        size[long] = [len(known[t]) for t in texts]
        done, order = [np.array([i for t in texts for i in known[t]], np.int32)], [long]

        final = np.zeros(len(data), np.int8)
        final[offsets[1:] - 1] = 1
        of = np.repeat(np.arange(len(length), dtype=np.int32), length)
        short = length[of] <= ROUNDS_BYTES
        token, of = symbols[final, data][short], of[short]
        if (token < 0).any():
            raise ValueError("no token for a byte")
        rank = np.full(len(token), PairRanks.NONE, np.int32)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = ranks.of(token[inner], token[inner + 1])
        while len(token):
            starts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
            many = np.diff(starts, append=len(token))
            lowest = np.minimum.reduceat(rank, starts)
            ready = lowest == PairRanks.NONE
            lowest[ready] = -1
            at = np.flatnonzero(rank == np.repeat(lowest, many))
            # of pairs that overlap (a token twice) the first, third, ... of each run is made
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[place % 2 == 0]
            keep, near = np.ones(len(token), bool), np.zeros(len(token) + 1, bool)
            if ready.any():
                finished = np.repeat(ready, many)
                done.append(token[finished])
                order.append(of[starts[ready]])
                size[order[-1]] = many[ready]
                keep = ~finished
            token[at] = made[rank[at]]
            rank[at] = rank[at + 1]
            keep[at + 1] = False
            near[at], near[at - 1] = True, True
            token, of, rank, near = token[keep], of[keep], rank[keep], near[:-1][keep]
            # pairs on both sides of what was made
            changed = np.flatnonzero(near[:-1] & (of[1:] == of[:-1]))
            rank[changed] = ranks.of(token[changed], token[changed + 1])
        order = np.concatenate(order)
        first = np.zeros(len(length), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(done), first, size

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by single spaces (the file names no decoder)."""
        return " ".join([self.names[i] for i in ids if i in self.names])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer of a file, read once in each Python worker."""
    if path not in _loaded:
        gc.disable()  # the tables hold no cycles; walking millions of entries again and again would cost most of the time
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, ids (token ids of the whole text)."""
    docs = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in common.runs(batches, "text", TRIE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [[i for piece in p for i in piece] for p in bpe.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text; a null list decodes to the empty text, unknown ids to nothing."""
    encoded = encoded.select("doc_id", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: n_tokens, ids_sha256 and decoded_sha256, digested where the ids are made."""
    docs = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        shown: dict[tuple[int, ...], tuple[int, bytes, bytes]] = {}
        for batch in common.runs(batches, "text", TRIE_BYTES):
            counts, ids, decoded = [], [], []
            for pieces in bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                rows = []
                for piece in pieces:
                    row = shown.get(piece)
                    if row is None:
                        row = shown[piece] = (len(piece), " ".join(map(str, piece)).encode(), bpe.decode(piece).encode("utf-8", "surrogatepass"))
                    rows.append(row)
                counts.append(sum([r[0] for r in rows]))
                ids.append(hashlib.sha256(b" ".join([r[1] for r in rows])).hexdigest())
                decoded.append(hashlib.sha256(b" ".join([r[2] for r in rows])).hexdigest())
            if len(shown) > MEMO_WORDS:
                shown.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
