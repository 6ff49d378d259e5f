"""Lexical search, collocations and shards against brute force, and on odd tables."""

from __future__ import annotations

import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.llm import collocations, lexical, sharding

SCHEMA = "doc_id long, text string, lang string, source string, rank string, score string, shard string, slot string, f long, n string, item string"
WORDS = "the cat sat on a mat while rain fell over old town roofs and birds sang in green parks near river banks".split()


def docs_of(spark, rows):
    """(doc_id, text, lang) rows with extra columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, lang, "s", *["x"] * 4, 7, "x", "x") for i, t, lang in rows], SCHEMA)


def texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "!"]) for _ in range(rng.randint(1, most))) for _ in range(n)]


def odd_rows():
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(40_000))
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n.,", "en"), (4, "Café CAFÉ café 12a", "fr"), (5, long, "en"), (5, "repeated id here", "en"), (None, "the cat without an id", None)]
    return rows + [(7, "the cat sat on a mat", "en")] * 3 + [(10 + i, t, "en") for i, t in enumerate(texts(60, 9))]


# --- 11


def brute_terms(t):
    return ["".join(c.lower() if c.isascii() else c for c in x) for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]


def brute_search(rows, items, top=10):
    """(item, rank, doc_id, score); rows with equal ids count each."""
    held = [(i, Counter(brute_terms(t))) for i, t, *_ in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(brute_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(heapq.nsmallest(top, scores))]
    return out


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_docs", [1, 7, 64])
def test_search_equals_brute_force(spark, monkeypatch, block_docs):
    rows = [(i, t, "en") for i, t in enumerate(texts(150) + texts(40, 2, 3))] + [(500 + i, "rare" + str(i % 9) + " cat", "en") for i in range(30)]
    items = [(k, t) for k, t in enumerate(texts(12, 3))] + [(90, "rare3 RARE4 nothing"), (91, None), (92, "zzz"), (93, "rare5 rare5 river")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    got = lexical.ranked_search(docs_of(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(rows, items), key=repr)


def test_blocks_hold_each_point_once_and_search_in_any_wave(monkeypatch):
    rng = np.random.default_rng(4)
    many = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 500) for _ in range(300)]
    rows = [(i, t, "en") for i, t in enumerate(many)]
    total = sum(len(brute_terms(t)) for t in many)
    block = lexical.Block(dict(zip([x.split()[0] for x in lexical._BLOCK.split(", ")], lexical._block(list(range(300)), [t.encode() for t in many], 300, total))))
    assert len(block.values) == sum(len(set(brute_terms(t))) for t in many)
    names = [x.decode() for x in block.names.to_pylist()]
    df = Counter(t for text in many for t in set(brute_terms(text)))
    for item in many[:25]:
        terms = sorted({t for t in brute_terms(item)})
        weights = np.array([math.floor(1000 * math.log(602 / (2 * df[t] + 1))) for t in terms])
        at = np.array([names.index(t) for t in terms])
        want = [(s, i) for _, _, i, s in brute_search(rows, [(0, item)])]
        for wave in (1, 5, 1000):
            monkeypatch.setattr(lexical, "WAVE", wave)
            score, col = block.search(at[weights > 0], weights[weights > 0])
            assert list(zip(score.tolist(), col.tolist())) == want
        assert block.search(at[weights > 0], weights[weights > 0], floor=want[4][0])[0].tolist()[:5] == [s for s, _ in want[:5]]


def test_search_on_odd_tables(spark, monkeypatch):
    rows = odd_rows()
    items = [(1, "the cat sat"), (1, "café 12A"), (None, "river banks"), (3, ""), (4, "repeated id")]
    got = lexical.ranked_search(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(rows, items), key=repr)
    monkeypatch.setattr(lexical, "SET_TERMS", 2)  # items in several sets
    again = lexical.ranked_search(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert found(again, "item_id", "rank", "doc_id", "score") == found(got, "item_id", "rank", "doc_id", "score")
    none = docs_of(spark, rows).filter("doc_id < 0")
    assert lexical.ranked_search(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.ranked_search(docs_of(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- 12


def brute_collocations(rows, least, top):
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, best = sum(c for p, c in f.items() if len(p) == 1), []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * b >= 50 * a and (q[:2] == p or q[1:] == p) for q, b in candidates.items() if len(q) == 3):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 300])
def test_collocations_equal_brute_force(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)  # phrases across chunks
    rows = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts(300, 7, 40))]
    got = collocations.collocations(docs_of(spark, rows).repartition(3), least=4, top=40, bucket_bytes=bucket_bytes)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute_collocations(rows, 4, 40)


def test_collocations_of_a_hot_pair_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MERGE_ENTRIES", 20)
    rows = odd_rows() + [(100 + i, f"of the x{i} of the É of the", "en") for i in range(200)] + [(1000, "of the " * 5000, "en")]
    got = collocations.collocations(docs_of(spark, rows), bucket_bytes=5000)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute_collocations(rows, 10, 2000)
    assert collocations.collocations(docs_of(spark, rows).filter("doc_id < 0")).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, "en"), (2, " . ", "en")])).count() == 0


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.createDataFrame([(big - 1, big, big + 5)], "a long, l long, r long")
    assert row.select(collocations._score("l", "r").alias("s")).first()["s"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 5))


# --- 13


def brute_pack(sizes, capacity):
    """Best fit decreasing, one item at a time over a plain list of bins."""
    free, bins = [], []
    for s in sorted(sizes, reverse=True):
        fit = min((f, b) for b, f in enumerate(free) if f >= s) if any(f >= s for f in free) else None
        if fit is None:
            free.append(capacity)
            bins.append([])
            fit = (capacity, len(free) - 1)
        free[fit[1]] -= s
        bins[fit[1]].append(s)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force(seed, monkeypatch):
    monkeypatch.setattr(sharding, "LEAF", 3)
    rng = random.Random(seed)
    items = [rng.choice([rng.randint(1, 30), rng.randint(1, 100)]) for _ in range(400)]
    by_size = sorted(Counter(items).items(), reverse=True)
    sizes, counts = (np.array(x) for x in zip(*by_size))
    runs, bins = sharding.pack(sizes, counts, 100)
    held = [Counter() for _ in range(bins)]
    for at, b, n in runs:
        held[b][int(sizes[at])] += n
    assert held == [Counter(b) for b in brute_pack(items, 100)]


def test_near_equal_shards():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 5000, 800))
    counts = rng.integers(1, 9, len(sizes))
    for bins in (1, 2, 7, 16):
        load, groups = np.zeros(bins, np.int64), Counter()
        for at, b, n in sharding.near_equal(sizes, counts, bins):
            load[b] += sizes[at] * n
            groups[at] += n
        assert [groups[i] for i in range(len(sizes))] == counts.tolist()
        assert load.max() - load.min() <= 64
    load = np.zeros(4, np.int64)  # one group above an even share has a bin of its own
    for at, b, n in sharding.near_equal(np.array([1, 10, 1000]), np.array([30, 30, 1]), 4):
        load[b] += [1, 10, 1000][at] * n
    assert sorted(load.tolist()) == [110, 110, 110, 1000]


def test_shards_of_odd_tables(spark):
    rows = odd_rows() + [(2000 + i, "a hot text", "en") for i in range(300)]
    got = [r.asDict() for r in sharding.shard_documents(docs_of(spark, rows).repartition(5)).collect()]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    of_text = defaultdict(set)
    for r in got:
        of_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) <= 15
    again = sharding.shard_documents(docs_of(spark, rows).repartition(2)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r.values()) for r in got)  # reruns agree
    assert sharding.shard_documents(docs_of(spark, rows).filter("doc_id < 0")).count() == 0


def test_shards_of_the_given_table_are_near_equal(spark):
    got = sharding.op13_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    load = [r["bytes"] for r in got]
    assert len(load) == 16 and max(load) - min(load) <= 64


def test_groups_of_one_size_are_split_by_digest(spark):
    rows = [(i, f"text {i:04d}", "en") for i in range(640)]
    got = sharding.shard_documents(docs_of(spark, rows)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [40] * 16


def test_fewest_shards_of_a_capacity(spark):
    items = [random.Random(3).randint(1, 60) for _ in range(200)]
    runs = sharding.fewest_shards(spark.createDataFrame([(x,) for x in items], "bytes long"), 100).collect()
    assert len({r["shard"] for r in runs}) == len(brute_pack(items, 100)) and sum(r["groups"] for r in runs) == 200
    with pytest.raises(ValueError):
        sharding.fewest_shards(spark.createDataFrame([(101,)], "bytes long"), 100)
