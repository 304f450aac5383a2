"""Ranked search, SimHash groups and whitening against plain versions, and on hard tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries, ranked, simhash, whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


# Ranked search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def all_scores(docs, queries_, k=10):
    """Every document scored for every query: docs and queries_ are (id, text)."""
    counts = [(i, Counter(PATTERN.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for q, text in queries_:
        terms = Counter(PATTERN.findall(lower(text)))
        scores = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_all
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in terms.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(df):
    return sorted(((r[0], r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts, shard, terms", [(1, 1, 10**6), (4, 300, 40), (3, 10**6, 1)])
def test_ranked_search_for_any_shards_and_blocks(spark, parts, shard, terms):
    """Small shards carry the k-th score from one to the next; small blocks read the corpus again."""
    rng = random.Random(parts)
    words = [f"w{k}" for k in range(60)] + ["über", "Ünder", "12", "A"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=rng.randint(0, 60)))) for k in range(300)]
    docs += [(k, docs[k - 1000][1]) for k in range(1000, 1040)]
    asked = [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = ranked.search(df, spark.createDataFrame(asked, "item_id long, text string"), shard_postings=shard, block_terms=terms)
    assert found(got) == sorted(all_scores(docs, asked), key=repr)


def test_ranked_search_limits_accumulators():
    """Where a rare term decides, documents with the common term alone get no accumulator."""
    n = np.full(1000, 10)
    terms, ends = np.array([0, 1] * 3 + [1] * 997), np.array([2] * 3 + [1] * 997)
    shard = ranked.Shard(n, ends, terms, np.ones(len(terms), np.int64), np.array([5000, 1]), 1000, 10_000)
    places, scores = shard.best([(0, 1), (1, 1)], 2, 0)
    assert places.tolist() == [0, 1, 2] and len(set(scores.tolist())) == 1
    assert shard.best([(0, 1), (1, 1)], 2, int(scores[0]) + 1)[0].tolist() == []


def test_ranked_search_on_hard_tables(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "alpha"), (4, "alpha"), (None, "alpha"), (5, "alpha beta " * 200_000), (6, "gamma ÉÉ É")]
    asked = [(7, "ALPHA beta"), (7, "ALPHA beta"), (None, "gamma"), (8, None), (9, "?"), (10, "nowhere"), (11, "é"), (12, "É")]
    extra = {c: F.lit("clash") for c in ("n", "terms", "tfs", "score", "RANK", "query", "item")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra)
    q = spark.createDataFrame(asked, "item_id long, text string").withColumns(extra)
    got = found(ranked.search(d, q))
    assert got == sorted(all_scores(docs, asked), key=repr)
    assert {g[0] for g in got} == {7, None, 12} and sum(g[0] == 7 for g in got) == 8
    assert ranked.search(d.limit(0), q).count() == 0 and ranked.search(d, q.limit(0)).count() == 0
    assert ranked.search(d.limit(0), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts_are_cut_between_terms():
    text = ("abc é12 " * 50).encode()
    assert [t for part in ranked.term_lists(text, piece=7) for t in part] == re.findall("[^ ]+".encode(), text)


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    """The least id reachable over all pairs of fingerprints at distance 3 or less; prints are numbers below 2**64."""
    f = np.array(prints, np.uint64)
    label = list(range(len(f)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(f)):
        for y in np.flatnonzero(np.bitwise_count(f[x] ^ f[:x]) <= 3).tolist():
            label[root(x)] = root(y)
    least = defaultdict(list)
    for x, i in enumerate(ids):
        least[root(x)].append(i)
    return [min(i for i in least[root(x)] if i is not None) if any(i is not None for i in least[root(x)]) else None for x in range(len(f))]


def test_simhash_query_equals_all_pairs(spark, texts):
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = {(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(ids, prints))}
    assert {tuple(r) for r in queries.op12_simhash(spark, SF).collect()} == want


def test_fingerprints_of_words_and_long_texts():
    rng = random.Random(5)
    some = ["", " \t\n", "One", " One\x0b tWo ", "a  b\r\nc", "é É x ß", "x y z w", " ".join(rng.choices("abcdefghij", k=3000)), "z " * 1000]
    for text in some:
        for block in (1, 254, 255, 256, 1 << 16):
            if len(text) < 3000 or block > 1:
                assert simhash.fingerprint(text.encode(), 3, block) % 2**64 == plain_fingerprint(text)
    assert simhash.fingerprint(None, 3) == 0


@pytest.mark.parametrize("bucket", [1, 3, 40, 4096])
def test_links_of_the_index_are_all_links(spark, bucket):
    """Dense families share segments, so small buckets send them through all levels of keys."""
    rng = random.Random(bucket)
    prints = {0, 2**64 - 1, 1 << 63}
    for family in range(4):
        centre = rng.getrandbits(64)
        loose = rng.sample(range(64), 9) if family % 2 else rng.sample(range(32), 7)
        prints |= {centre ^ sum(1 << b for b in rng.sample(loose, rng.randint(0, 6))) for _ in range(90)}
    prints |= {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints)[:20]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), 3)))
    prints = sorted(prints)
    signed = {simhash._signed(p): p for p in prints}
    got = simhash.index_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket)
    pairs = {tuple(sorted((signed[r.a], signed[r.b]))) for r in got.collect()}
    f = np.array(prints, np.uint64)
    want = {(prints[x], prints[y]) for x in range(len(f)) for y in range(x + 1, len(f)) if int(np.bitwise_count(f[x] ^ f[y])) <= 3}
    assert pairs == want and len(want) > 1000


def test_simhash_on_hard_tables(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one two"), (7, "one two"), (None, "ONE\ttwo"), (None, "alone here now"), (8, "x y z " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "FINGERPRINT", "mask", "key", "n", "component_id", "least")})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints))]
    assert got == sorted(want, key=repr)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


# Whitening


def plain_whitening(rows, weight="one", components=16):
    """rows: (id, list); by numpy over the whole table."""
    kept = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return {}
    length = max(Counter(len(v) for _, v in kept).items(), key=lambda kv: (kv[1], kv[0]))[0]
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in kept if len(v) == length]
    times = Counter(x for _, x in kept)
    w = {x: n if weight == "count" else 1 for x, n in times.items()}
    n, sums = sum(w.values()), [sum(w[x] * x[d] for x in w) for d in range(length)]
    centred = {x: np.array([(n * c - s) / n for c, s in zip(x, sums)]) for x in w}
    v = sum(w[x] * np.outer(c, c) for x, c in centred.items()) / n
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values) if values[k] > 1e-12 * values.max()][:components] if values.max() > 0 else []
    out = defaultdict(list)
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out[i].append([(k + 1, n, deviation, abs(float(centred[x] @ vectors[:, j])) / math.sqrt(values[j]), values[j] / np.trace(v)) for k, j in enumerate(order)])
    return out


def check_whitened(got, want):
    assert sum(len(rows) for many in want.values() for rows in many) == len(got)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append((r.component, r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error < 1e-8
    for i, rows in by.items():
        for a, b in zip(sorted(rows), sorted(x for many in want[i] for x in many)):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6, abs=1e-9)


def test_whitening_query_equals_numpy(spark):
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    check_whitened(queries.op13_whitening(spark, SF).collect(), plain_whitening(rows))


@pytest.mark.parametrize("weight", ["one", "count"])
def test_whitening_on_hard_tables(spark, weight):
    rng = random.Random(3)
    scale = [9.0, 5.0, 2.0, 1.0]
    rows = [(k, [rng.gauss(0, s) for s in scale]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("key", "x", "w", "copies", "N", "Component", "id", "v")})
    got = whitening.whiten_embeddings(df, weight=weight).collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows if i is None or i < 900} and got[0].n == (60 if weight == "one" else 262)
    check_whitened(got, plain_whitening(rows, weight))
    again = whitening.whiten_embeddings(df.repartition(7), weight=weight).collect()
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.component)
    assert [r.whitened for r in sorted(again, key=key)] == pytest.approx([r.whitened for r in sorted(got, key=key)], abs=1e-9)


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten_embeddings(same).count() == 0 and whitening.whiten_embeddings(same.limit(0)).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], schema)
    got = whitening.whiten_embeddings(line).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)
    wide = whitening.whiten_embeddings(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], schema)).collect()
    assert all(r.deviation is None for r in wide) and len(wide) == 2
    with pytest.raises(ValueError):
        whitening.whiten_embeddings(line, weight="rows")
