"""Phrase mining, document fingerprints and periodic runs against plain versions, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeops.llm import minhash, periodic, phrases
from lakeops.llm.queries import ORACLE, QUERIES, table

ROOT = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def text_of(doc_id):
    return "" if doc_id is None else str(doc_id)


# phrases ------------------------------------------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r.text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least}
        covered = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i:i + k]] = max(covered[p[i:i + k]], a)
        best = []
        for p, a in found.items():
            if len(p) > 1 and 100 * covered[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return out


def test_collocations(spark, edge):
    docs = table(spark, ROOT, "documents")
    rows = docs.collect()
    # one block and many, few shards and many, a map so small that nearly all its bits are set
    for block, shards, bits, least in ((1 << 24, 10, 1 << 27, 30), (1 << 14, 3, 1 << 15, 30), (1 << 12, 50, 1 << 16, 12)):
        got = phrases.collocations(docs, least=least, block_bytes=block, shards=shards, bits=bits)
        assert ordered(map(tuple, got.collect())) == ordered(plain_collocations(rows, least, 2000))
    assert ordered(map(tuple, phrases.collocations(docs, top=7).collect())) == ordered(plain_collocations(rows, 30, 7))
    got = phrases.collocations(edge, least=2)
    assert ordered(map(tuple, got.collect())) == ordered(plain_collocations(edge.collect(), 2, 2000)) and got.count() > 500


def test_collocations_of_pieces_and_ties(frame, spark):
    docs = frame([(k, "A b a\tB c, a b. A\nb\x0bc a b a", lang) for k, lang in enumerate(["en", None, "und", "en"])] + [(9, None, "xx"), (10, " .,\t", "yy")])
    got = [tuple(r) for r in phrases.collocations(docs, least=2).collect()]
    assert ordered(got) == ordered(plain_collocations(docs.collect(), 2, 2000)) and {r[0] for r in got} == {"en", "und"}
    assert phrases.collocations(docs, least=1000).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_collocations_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{ROOT}/documents.parquet'")
    want = con.sql(ORACLE["op11_phrase_collocations"])
    got = QUERIES["op11_phrase_collocations"](spark, ROOT)
    assert set(want.columns) == set(got.columns)
    assert ordered(map(tuple, got.select(want.columns).collect())) == ordered(want.fetchall()) and want.fetchall()


def test_local_supports_lose_nothing(spark):
    docs = table(spark, ROOT, "documents")
    shares = phrases.shard_supports(phrases.coded_blocks(docs, 1 << 14, 10)).collect()
    for lang in {r.lang for r in shares}:
        own = [r for r in shares if r.lang == lang]
        # one less than its support in every shard is less than the support in all
        assert sum(r.support - 1 for r in own) < 30 and max(r.support for r in own) < 30


# fingerprints -------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = SPACE.findall(lower(text))
    shingles = [words[i:i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words]
    bins = [None] * minhash.BINS
    for s in shingles:
        h = 42
        for w in s:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        b = h >> 56
        bins[b] = h if bins[b] is None else min(bins[b], h)
    out = ""
    for b in range(minhash.BINS):
        asked = [b] + [(minhash.FIRST[b] + t * minhash.STEP[b]) % minhash.BINS for t in range(minhash.BINS)]
        value = next(bins[e] for e in asked if bins[e] is not None)
        out += f"{value >> 4 * (b % 13) & 15:x}"
    return out


def shingles(text):
    words = SPACE.findall(lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / minhash.BINS - 1 / 16) / (15 / 16))


def plain_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), hashlib.sha256((r.text or "").encode()).hexdigest()))
    out = []
    for k, r in enumerate(rows):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, other = plain_fingerprint(text), plain_fingerprint(edited)
        out.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other,
                    round(likeness(own, other), 9), round(likeness(own, plain_fingerprint(after)), 9)))
    return out


def rounded(rows):
    return ordered(tuple(r)[:5] + (round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def test_fingerprints(spark, edge, frame):
    docs = table(spark, ROOT, "documents")
    for given in (docs, edge, frame([(3, "only one row of it here")]), frame([(3, "twice the same row"), (3, "twice the same row")])):
        rows = given.collect()
        assert rounded(minhash.report(given).collect()) == ordered(plain_fingerprints(rows))
        assert rounded(minhash.report(given.repartition(7)).collect()) == ordered(plain_fingerprints(rows))
    assert minhash.report(edge.limit(0)).count() == 0
    held = edge.withColumn("next", F.lit("x")).withColumn("half", F.lit(1))
    assert set(minhash.with_fingerprints(held).columns) == {*held.columns, "fingerprint"}


def test_likeness_is_unbiased(spark):
    rows = {r.doc_id: r for r in minhash.report(table(spark, ROOT, "documents")).collect()}
    docs = {r.doc_id: r.text or "" for r in table(spark, ROOT, "documents").collect()}
    ids, errors = sorted(docs, reverse=True), []
    for k, i in enumerate(ids):
        text = docs[i]
        edited = text[:len(text) - len(text) // 2] + docs[ids[(k + 1) % len(ids)]][:len(text) // 2]
        a, b = shingles(text), shingles(edited)
        errors.append(rows[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and math.sqrt(np.mean(np.square(errors))) < 0.05 and max(map(abs, errors)) < 0.25


def test_empty_bins_follow_their_own_orders():
    orders = {tuple((minhash.FIRST[b] + t * minhash.STEP[b]) % minhash.BINS for t in range(minhash.BINS)) for b in range(minhash.BINS)}
    assert len(orders) == minhash.BINS and all(sorted(o) == list(range(minhash.BINS)) for o in orders)
    # each of two filled bins is taken by about half of the others
    taken = sum(min(o.index(17), o.index(200)) == o.index(17) for o in orders)
    assert 100 < taken < 156


# runs ---------------------------------------------------------------------------------------------------------------

def plain_runs(words, least=6, exponent=4):
    codes, found = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int), {}
    for q in range(1, len(codes) // exponent + 1):
        same = np.concatenate(([0], (codes[:-q] == codes[q:]).astype(int), [0]))
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a + q >= max(least, exponent * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_report(rows):
    for r in rows:
        words, h = SPACE.findall(r.text or ""), zlib.crc32(text_of(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = None
        for s, length, q in runs:
            if best is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        yield (r.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest,
               hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_periodic_report(spark, edge, frame):
    repeats = frame([(k, t, "en") for k, t in enumerate(["a a a a a", "a a a a a a", "A a " * 20, "x y x y x y x y x", "a b c " * 4 + "b c b c b c b c " * 2, "é f " * 8])])
    for docs in (table(spark, ROOT, "documents"), edge, repeats):
        assert ordered(map(tuple, periodic.report(docs).collect())) == ordered(plain_report(docs.collect()))
    assert periodic.report(edge.limit(0)).count() == 0


def test_find_runs_keeps_real_outputs(frame):
    docs = frame([(1, "so  it is it is it is it is\tdone"), (2, None), (None, "la la la la la la la")])
    got = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "so it is done" and got[1].n_words == 10
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].n_words == 0
    assert [tuple(r) for r in got[None].runs] == [(0, 7, 1)] and got[None].collapsed == "la"
    assert periodic.find_runs(docs, least=20, exponent=3).where("size(runs) > 0").count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, exponent=2)


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                p, a = rng.randint(1, 5), rng.randrange(n)
                words = [words[i] if i < a else words[a + (i - a) % min(p, n - a)] for i in range(n)] + words[:rng.randint(0, n)]
            texts.append(words)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start, length, period = periodic.runs_of_words(np.array(sum(texts, []), np.int32), at)
        want = [(a + int(at[d]), ln, q) for d, t in enumerate(texts) for a, ln, q in plain_runs(t)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_runs_of_long_texts_stay_linear():
    n = 100_000
    fib, other = [0, 1], [0]
    while len(fib) < n:
        fib, other = fib + other, fib
    for codes, runs in ((np.zeros(n, np.int32), [(0, n, 1)]), (np.arange(n, dtype=np.int32) % 7, [(0, n, 7)]), (np.array(fib[:n], np.int32), [])):
        assert list(zip(*(x.tolist() for x in periodic.runs_of_words(codes, np.array([0, n]))), strict=True)) == runs
