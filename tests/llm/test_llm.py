"""The training-data operators against brute force, and on odd tables: nulls, empty and very long texts, ties, repeats."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sondera.llm import components, exact_dedup, golay, html_text, language_id, media, mixing, near_text, secret_scan, sentencepiece_codec, simhash, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, fp string, score string"
WORDS = "the cat sat on a mat while rain fell over old town roofs and birds sang in green parks near river banks".split()


def docs_of(spark, texts, langs=None, sources=None):
    """A table with extra columns whose names clash with those that operators add."""
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{i % 3}"), None, "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(3)
    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    base = " ".join(rng.choice(WORDS) for _ in range(300))
    return [None, "", "   ", "one", base, base, base.upper(), base + " extra", long, "ÉTÉ été", "Été ÉTÉ", "a\x0bb\x1cc\u00a0d", "12345 !!", *[base.replace("cat", "dog", 1)] * 3]


def empty(df):
    return df.filter("doc_id < 0")


# --- 1


def test_secret_spans_equal_brute_force(spark):
    rng = random.Random(1)
    alphabet = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", '"', " ", "AKIA", "ABCDEF0123", "deadbeef", "0f", "x", "é", "ſecret", "\n", "a9Z+/", "'"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        want = []
        for place, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
            want += [(m.start(), place, m.end()) for m in pattern.finditer(t) if len(m.group(group)) >= least]
        assert secret_scan.base_spans(t) == sorted(want)
    assert secret_scan.base_spans("secret=token:xyzabc123") == []  # the short match takes the second key word with it


def test_random_strings_and_known_digests():
    rng = random.Random(2)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(50)]
    assert sum(map(secret_scan.looks_random, keys)) >= 48
    for plain in (hashlib.md5(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "2024-01-02-2025-03-04-10", "some_long_function_name_2", "internationalization"):
        assert not secret_scan.looks_random(plain)


def test_random_parts_of_runs():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    assert sum(secret_scan.looks_random(key(letters, 24)) for _ in range(100)) >= 95
    assert all(secret_scan.looks_random(f"services/incoming/webhook/notifications/{key(letters + '0123456789', 24)}") for _ in range(50))
    sha1, md5 = hashlib.sha1(b"x").hexdigest(), hashlib.md5(b"x").hexdigest()
    for plain in (f"repos/blob/{sha1}", f"md5-{md5}", f"digest_{sha1}", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "id-e233b297-1e3f-44a4-8f35-2f7c144307d9", "AbstractSingletonProxyFactoryBean", "getElementByIdFromDocumentRoot", "a" * 10_000):
        assert not secret_scan.looks_random(plain)
    assert secret_scan.looks_random(key(letters + "0123456789", 5000))


def test_secrets_on_odd_tables(spark):
    df = docs_of(spark, [*odd_texts(), "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""])
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(df).collect()}
    assert got[0]["spans"] == got[1]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    last = got[max(got)]
    assert last["spans"] == "assign:0:49,hex:9:49" and (last["n_assign"], last["n_hex"]) == (1, 1)
    assert secret_scan.find_secrets(empty(df)).count() == 0


# --- 2


def toy_labels(n=600):
    rng = random.Random(4)
    bad = ["idiot", "moron", "trash", "pathetic"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(60)]
        if i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(i % 3 == 0)
    return texts, np.array(labels, float)


def test_toxicity_held_out_and_misspelt():
    texts, y = toy_labels()
    model = toxicity.fit(texts[:450], y[:450])
    memory: dict = {}
    p = np.array([model.score(t, memory) for t in texts[450:]])
    right = (p >= toxicity.THRESHOLD) == (y[450:] == 1)
    assert right.mean() > 0.95
    clean = " ".join(WORDS)
    assert model.score(clean + " idiott", memory) > model.score(clean, memory)
    assert 0 <= model.score(None, memory) == model.score("", memory) <= 1


def test_toxicity_on_odd_tables(spark):
    texts, y = toy_labels(120)
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(5, 1), (5, 0), (9999, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.judge(docs_of(spark, odd_texts()), model)
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert got.filter("doc_id in (0, 1, 2)").select("score").distinct().count() == 1
    none = toxicity.train(df, labels.filter("doc_id < 0"))
    assert toxicity.judge(df, none).filter("predicted = 1").count() == 0
    assert toxicity.judge(empty(df), model).count() == 0


# --- 3


def lower_ascii(t):
    return (t or "").encode("utf-8").lower()


def test_exact_dedup_equals_brute_force(spark):
    texts = odd_texts()
    df = docs_of(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower_ascii(t)].append(i)
    index = exact_dedup.DigestIndex(spark, "t_exact", buckets=3)
    for r in exact_dedup.dedup(df, index).collect():
        own = groups[lower_ascii(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(lower_ascii(texts[r["doc_id"]])).hexdigest()
    again = exact_dedup.dedup(df.withColumn("doc_id", F.col("doc_id") + 1000), index)  # nothing is new to the index
    assert again.filter("kept").count() == 0 and again.filter("keep_id >= 1000").count() == 0
    assert index.read().count() == len(groups)


def test_exact_dedup_repeated_rows(spark):
    df = docs_of(spark, ["a", "A", "b"])
    twice = df.unionByName(df)
    got = exact_dedup.dedup(twice, exact_dedup.DigestIndex(spark, "t_twice", 2))
    assert got.count() == 6 and got.filter("kept").count() == 2
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(twice).collect()) == [1, 2]
    assert exact_dedup.drop_copies(twice).columns == df.columns
    assert exact_dedup.drop_copies(empty(df)).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert exact_dedup.drop_copies(nulls).count() == 2


# --- 4


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    hosts = ["example.com", "a.example.com", "EXAMPLE.net", "b.net", "c.org", "org", "notexample.com", "x.co", ""]
    paths = ["/en/7", "/en/", "/en", "/de/8", "/de/", "/es/1", "/EN/", ""]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/en/', '#b', '?x#y'])}" for _ in range(300)] + [None, "", "no url", "://", "a://b://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit(1)})

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for verdict, rule in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        return host, path, best and best[1], best[0] if best else "allow"

    no_rules = url_filter.mine(spark.createDataFrame([], "tokens array<string>, blocked boolean"))
    assert no_rules.default == "allow" and no_rules.rules.isEmpty()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, no_rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def mined_by_brute_force(rows, support, confidence, least_rows):
    """(tokens, verdict, strength) of all rules of up to four tokens, with nothing pruned, and the default."""
    labelled = [(frozenset(t), b) for t, b in rows if b is not None]
    n, blocked = len(labelled), sum(b for _, b in labelled)
    least, found = max(least_rows, support * n), []
    every = sorted({t for own, _ in labelled for t in own})
    for k in range(1, 5):
        for need in combinations(every, k):
            of = [b for own, b in labelled if own >= set(need)]
            for label, base in ((True, blocked / n), (False, 1 - blocked / n)):
                both = sum(b == label for b in of)
                if both >= least and both / len(of) >= confidence and both / len(of) / base >= url_filter.MIN_LIFT - 1e-9:
                    found.append((set(need), "block" if label else "allow", (-both / len(of), -both / n, k, not label, " ".join(need))))
    return found, "block" if blocked > n - blocked else "allow"


def test_mined_verdicts_equal_brute_force(spark):
    rng = random.Random(17)
    hosts = ["spam", "good", "shop", "news"]
    for blocked_share in (0.3, 0.9):
        rows = []
        for _ in range(200):
            host, lang = rng.choice(hosts), rng.choice(["en", "de", "fr"])
            bad = (host == "spam" and lang != "de") or (host == "shop" and rng.random() < 0.8)
            bad = bad if blocked_share == 0.3 else not (host == "good" and lang == "en")
            rows.append(([f"host:{host}", f"site:{host}.x", "scheme:https", f"path:{lang}", *(["query:q"] * (rng.random() < 0.3))], bad))
        rows += [(["host:spam"], None), ([], False), (["host:spam", "path:en"], True)]  # no label; no token; a host without its site
        mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
        rules, default = mined_by_brute_force(rows, url_filter.MIN_SUPPORT, url_filter.MIN_CONFIDENCE, url_filter.MIN_ROWS)
        asked = [sorted(set(t)) for t, _ in rows] + [["site:spam.x", "path:en"], ["host:new"], ["host:good", "path:en", "other"], None]
        asked = asked + asked[:50]
        want = []
        for t in asked:
            fits = [r for r in rules if r[0] <= set(t or [])]
            want.append(min(fits, key=lambda r: (round(r[2][0], 12), round(r[2][1], 12), *r[2][2:]))[1] if fits else None)
        urls = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "page_id long, tokens array<string>")
        got = {r["page_id"]: r["mined"] for r in mined.verdicts(urls).collect()}
        assert [got[i] for i in range(len(asked))] == want and mined.default == default
        assert {"block", None} <= set(want) or {"allow", None} <= set(want)


def test_url_filter_on_odd_tables(spark):
    long = "https://spam.org/" + "x/" * 20_000
    pages = spark.createDataFrame([(1, None), (2, "spam"), (3, long), (3, long), (None, "https://spam.net/a/1"), (4, "https://good.net/a/1")], "page_id long, url string").withColumns({"tokens": F.lit(1), "mined": F.lit(2)})
    rows = [(["host:spam"], True)] * 30 + [(["host:good"], False)] * 60
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    got = sorted((r["page_id"] or 0, r["verdict"]) for r in url_filter.judge_urls(pages, mined).collect())
    assert got == [(0, "block"), (1, "allow"), (2, "allow"), (3, "block"), (3, "block"), (4, "allow")]
    assert url_filter.judge_urls(pages.filter("page_id < 0"), mined).count() == 0


# --- 5


def test_media_copies_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(48)] + [(100, [0.5] * 64), (101, [0.5] * 64), (102, None)], "vec_id long, embedding array<float>")
    table = media.media_of(vectors)
    rows = table.collect()
    assert Counter(r["edit"] for r in rows)["crop"] >= 1
    images = {r["media_id"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]) for r in rows}
    found = {k: media.features(v) for k, v in images.items()}
    ids = sorted(found)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if images[a].tobytes() == images[b].tobytes() and images[a].shape == images[b].shape or media.agreeing(found[b], found[a]) >= media.LEAST_AGREE:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
                linked += 1
    got = {r["media_id"]: r["class_id"] for r in media.copies(table).collect()}
    recall = sum(got[i] == root(i) for i in ids) / len(ids)
    assert linked >= 6 and recall >= 0.95
    broken = spark.createDataFrame([(1, 2, 2, None), (2, 5, 5, bytearray(b"abc")), (3, None, None, bytearray(b"abcd"))], "media_id long, height int, width int, pixels binary")
    assert media.copies(broken).filter("n_corners > 0").count() == 0
    assert media.copies(broken.filter("media_id < 0")).count() == 0


@pytest.mark.parametrize("leaders, crowd", [(1, 256), (4, 256), (1, 2)])
def test_media_copies_behind_a_stranger(spark, leaders, crowd):
    """Image 1 holds all descriptors of the others, in places that fit no shift: the copies 2 to 4 meet all the same."""
    rng = np.random.default_rng(3)
    own = np.zeros(12, media.FEATURE)
    own["x"], own["y"], own["scale"] = rng.uniform(20, 60, 12), rng.uniform(20, 60, 12), 1
    own["bits"] = rng.integers(0, 256, (12, 32))
    strangers = own.copy()
    strangers["x"], strangers["y"] = rng.uniform(0, 900, 12), rng.uniform(0, 900, 12)
    moved = own.copy()
    moved["x"] += 5
    images = [(1, strangers), (2, own), (3, moved), (4, own)]
    frame = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in images], "media_id long, features binary")
    assert media.agreeing(strangers, own) < media.LEAST_AGREE <= media.agreeing(own, moved)
    linked = media.links(frame, leaders, crowd)
    assert {(r["node"], r["component"]) for r in components.components(linked).collect()} == {(2, 2), (3, 2), (4, 2)}


def _corners(rng, n):
    own = np.zeros(n, media.FEATURE)
    own["x"], own["y"], own["scale"], own["bits"] = rng.uniform(20, 60, n), rng.uniform(20, 60, n), 1, rng.integers(0, 256, (n, 32))
    return own


def _other_buckets(found, but=()):
    """The same corners with a bit of each table's key turned; of those in ``but`` the first table's bucket stays."""
    bits, places = np.unpackbits(found["bits"], axis=1), media._tests()[1]
    for i in range(len(found)):
        kept = set(places[0][:60].tolist()) if i in but else set()
        for table in places:
            turned = [p for p in table[:60].tolist() if p not in kept][:1]
            bits[i, turned] ^= 1
        # every further twelve bits of the first table are others too: once they dealt a crowded bucket out again
        rest = np.random.default_rng(media.SEED)
        rest.random((4 * media.BITS, 2)), rest.random((4 * media.BITS, 2))
        further = rest.permutation(media.BITS)[60:120]
        bits[i, further[::12]] ^= i in but
    out = found.copy()
    out["bits"], out["x"] = np.packbits(bits, axis=1), found["x"] + 5
    return out


def _classes_of(spark, images, *limits):
    frame = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in images], "media_id long, features binary")
    return {(r["node"], r["component"]) for r in components.components(media.links(frame, *limits)).collect()}


@pytest.mark.parametrize("limits", [(), (1, 2), (4, 1)])
def test_media_copies_that_share_one_crowded_bucket(spark, limits):
    """Images 3 and 8 are copies and share just the bucket that strangers crowd."""
    rng = np.random.default_rng(5)
    own = _corners(rng, 12)
    copy = _other_buckets(own, {4})
    names = [media.bucket_names(f) for f in (own, copy)]
    names = [n[0] if isinstance(n, tuple) else n for n in names]
    assert np.intersect1d(*names).tolist() == [names[0][4, 0]] and media.agreeing(own, copy) >= media.LEAST_AGREE
    images = [(3, own), (8, copy)]
    for i in (1, 2, 4, 5, 6, 7, 9):
        stranger = _corners(rng, 12)
        bits = np.unpackbits(stranger["bits"], axis=1)
        at = media._tests()[1][0][:60]
        bits[0, at] = np.unpackbits(own["bits"][4])[at]
        stranger["bits"] = np.packbits(bits, axis=1)
        images.append((i, stranger))
    assert _classes_of(spark, images, *limits) == {(3, 3), (8, 3)}


@pytest.mark.parametrize("limits", [(), (1, 2)])
def test_media_copies_of_a_copy_of_the_leader(spark, limits):
    """Image 2 overlaps 1 and 3, which overlap not: all share one bucket, and 2 and 3 meet though 2 is of 1's class. 4 to 8 are strangers."""
    rng = np.random.default_rng(8)
    left, right = _corners(rng, 9), _corners(rng, 9)
    first = np.concatenate([left, right[:1]])
    both = np.concatenate([_other_buckets(left), _other_buckets(right, {0})])
    last = np.concatenate([right])
    images = [(1, first), (2, both), (3, last)]
    for i in range(4, 9):
        images.append((i, np.concatenate([_corners(rng, 9), right[:1]])))
    assert media.agreeing(first, last) < media.LEAST_AGREE <= min(media.agreeing(first, both), media.agreeing(both, last))
    assert _classes_of(spark, images, *limits) == {(1, 1), (2, 1), (3, 1)}


# --- 6


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / open_weight > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        full |= over


def test_mixing_targets_and_budget(spark):
    rng = random.Random(7)
    texts = [" ".join(["w"] * rng.randint(0, 40)) for _ in range(400)]
    sources = {i: rng.choice(["a"] * 12 + ["b", "Z", "é", None]) for i in range(400)}
    df = docs_of(spark, texts, sources=sources)
    rows = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for i, t in enumerate(texts):
        sizes[sources[i]] += len(t.split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == 400
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(empty(df)).count() == 0


def test_mixing_hot_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_SHARE", 1)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"))
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "HOT_SHARE", 10**6)
    split = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    assert sum(plain.values()) == sum(split.values()) and len(split) == 5000


def test_repeat_by_mix(spark):
    df = docs_of(spark, ["a b", "c", "d e f", None], sources={0: "x", 1: "y", 2: "y", 3: "x"})
    out = mixing.repeat_by_mix(df)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v}) and out.columns == df.columns


def test_repeat_by_mix_with_repeated_ids(spark):
    """Just the planned words are written where ids repeat, with one source and size or several."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None, 40 + i]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))), "en", rng.choice(["x", "y", None]), None, *["x"] * 4) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = Counter()
    for r in mixing.mix(df).collect():
        planned[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = mixing.repeat_by_mix(df).collect()
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out) == Counter({k: v for k, v in planned.items() if v})
    assert {tuple(r) for r in out} <= set(rows)


# --- 7


def test_pieces_equal_the_tokenizer(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    texts = [t for t in odd_texts()] + ["   a  b ", "日本語🎉", "<s> </s> <0x0A>", "aaaaaaaaaa", "▁x▁"]
    texts += ["".join(rng.choice("etaoin shr ▁,.0123ABCéß\n\t") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    df = docs_of(spark, texts)
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df)).collect():
        t = texts[r["doc_id"]]
        assert r["piece_ids"] == library.encode(t or "") and r["n_pieces"] == len(r["piece_ids"])
        assert r["decoded"] == (t or "").replace("▁", " ")
    assert sentencepiece_codec.round_trip(df).filter("not round_trip").count() == 0
    assert sentencepiece_codec.encode(empty(df)).count() == 0


# --- 8


def brute_fingerprint(t, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower_ascii(t))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_within_two():
    assert golay.shares_within_two()


def test_all_pairs_within_four_bits_share_a_bucket():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * 2 + rng.integers(0, 2, 3000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.uint64)) for _ in a])
    for x, y in ((a, a ^ flips),):
        (wx, kx), (wy, ky) = simhash.bucket_keys(x), simhash.bucket_keys(y)
        left, right = defaultdict(set), defaultdict(set)
        for w, k in zip(wx.tolist(), kx.tolist()):
            left[w].add(k)
        for w, k in zip(wy.tolist(), ky.tolist()):
            right[w].add(k)
        assert all(left[i] & right[i] for i in range(len(a)))


def brute_components(fps):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if comp[j] < comp[i] and (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i], changed = comp[j], True
    return comp


def test_simhash_equals_brute_force(spark):
    rng = random.Random(10)
    texts = odd_texts()
    base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(400)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 9))
        texts.append(" ".join(own))
    df = docs_of(spark, texts)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_groups(df).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    kept = simhash.drop_near_copies(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    assert simhash.near_groups(empty(df)).count() == 0
    assert simhash.drop_near_copies(df.unionByName(df)).count() == len(set(want.values()))


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(21)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(5)]
    rows = [(None, base[0]), (None, base[1]), (None, base[2]), (None, base[2]), (7, base[3]), (7, base[4]), (8, base[3]), (9, base[0])]
    df = spark.createDataFrame([(i, t, *["x"] * 2, None, *["x"] * 4) for i, t in rows], SCHEMA)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(df).collect()), key=repr)
    assert kept == sorted([(9, base[0]), (None, base[1]), (None, base[2]), (7, base[3]), (7, base[4])], key=repr)
    assert simhash.near_groups(df).count() == len(rows)


def test_crowded_buckets_lose_no_link(spark):
    """Buckets of more than 2 (and 40) fingerprints are dealt out again; the groups stay those of all pairs."""
    rng = random.Random(12)
    fps = {0, 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << i for i in rng.sample(range(24), rng.randint(0, 6))))
    fps = sorted(fps)
    signed = {i: x - (x >> 63 << 64) for i, x in enumerate(fps)}
    want = brute_components(dict(enumerate(fps)))
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    for most_in_bucket in (2, 40, 10**6):
        got = {r["node"]: r["component"] for r in components.components(simhash.fingerprint_links(df, 4, most_in_bucket)).collect()}
        groups, of_all = defaultdict(set), defaultdict(set)
        for i, x in signed.items():
            groups[got.get(x, x)].add(i)
            of_all[want[i]].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, of_all.values()))
    for most in (1, 2, 3):
        got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.neighbour_links(df, most).collect()}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= most for a, b in got)


def kept_by_brute_force(texts, least=0.8):
    """Smallest positions of the groups that pairs with a five-word Jaccard of ``least`` join."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(31)
    texts = odd_texts()
    passage = [rng.choice(WORDS) for _ in range(40)]  # held by many texts that are no copies
    base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(200)]
    for n in range(120):
        own = list(base) if n % 2 else [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(60)] + passage
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 99))
        texts.append(" ".join(own))
    df = docs_of(spark, texts)
    kept = near_text.drop_similar(df)
    want, got = set(kept_by_brute_force(texts)), {r["doc_id"] for r in kept.collect()}
    # fingerprints are found by chance near the limit: no document goes that brute force keeps, and 9 of 10 others go
    assert want <= got and kept.columns == df.columns
    assert len(texts) - len(got) >= 0.9 * (len(texts) - len(want))
    assert len(got) < simhash.drop_near_copies(df).count()  # copies that 4 bits miss
    assert near_text.drop_similar(empty(df)).count() == 0
    assert near_text.drop_similar(df.unionByName(df)).count() == len(got)


def test_candidates_of_large_buckets(spark):
    """Buckets that are dealt out in blocks, or cut by verification, join the same sets as buckets taken whole."""
    rng = random.Random(37)
    base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(120)]
    texts = []
    for n in range(80):
        own = list(base)
        for _ in range(n % 5):
            own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 99))
        texts.append(" ".join(own))
    docs = docs_of(spark, texts)
    found = near_text.cut(near_text.text_sets(docs, 5))
    groups = []
    for limits in ((1 << 20, 1 << 30), (3, 1 << 30, 10), (1 << 20, 0, 1024, 4000)):
        links = near_text.similar_links(found, docs, 5, 0.8, *limits)
        groups.append({(r["node"], r["component"]) for r in components.components(links).collect()})
    assert groups[0] and groups[0] == groups[1] == groups[2]


def test_forest_joins_what_all_candidates_join():
    rng = np.random.default_rng(5)
    for n in (2, 3, 30, 200):
        centres = rng.integers(0, 1 << 62, 4)
        rest = np.array([int(centres[rng.integers(4)]) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 14))) for _ in range(n)], np.int64)
        size = rng.choice([100, 110, 200], n)
        near = [near_text._near(rest.view(np.uint64), size, i, 0.8) for i in range(n)]
        root = list(range(n))
        for i in range(n):
            for j in np.flatnonzero(near[i]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        mine, links = list(range(n)), near_text.forest(rng.permutation(n), rest, size, 0.8)
        for i, j in links:
            assert near[i][j] and mine[i] != mine[j]
            low, high = sorted((mine[i], mine[j]))
            mine = [low if r == high else r for r in mine]
        assert mine == root


def test_similar_texts_with_null_and_repeated_ids(spark):
    """Different texts stay, each once, whatever their ids; of copies the one with an id stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (7, c), (7, "short"), (9, c + " end"), (None, c), (None, "lone"), (None, "lone")]
    kept = near_text.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 5 and {r["text"] for r in kept if r["doc_id"] == 7} == {c, "short"}
    alone = [r["text"] for r in kept if r["doc_id"] is None]
    assert len(alone) == 3 and {b, "lone"} < set(alone) and (a in alone) != (a + " end" in alone)


def test_components_of_a_chain(spark):
    n = 60
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1001), (7, 7)], "a long, b long").repartition(5)
    for limits in ((), (components.MANY_LINKS, 10), (0, 20)):
        got = {r["node"]: r["component"] for r in components.components(chain, *limits).collect()}
        assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# --- 9


def test_main_text():
    page = """<html><head><title>x</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header><p>Site name and a long slogan that goes on and on for quite a while</p></header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies and like them a lot, more than is good for us.</div>
    <article><h1>A &amp; B</h1><p>First   paragraph<br>goes <b>on</b>&nbsp;here.</p><p>To.</p><aside>Related reading, with quite a lot of text in it</aside><form><p>Sign up</p></form><p>End&#46;</p></article>
    <div id="comments"><p>I liked this very much and will read it again, says a reader at length.</p></div><footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_text(page) == "A & B First paragraph goes on here. To. End."
    bare = re.sub(r"</?article>", "", page)
    assert html_text.main_text(bare) == "A & B First paragraph goes on here. To. End."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article><p>cut off <script>never closed") == "cut off"


def test_main_text_of_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extract(pages.withColumn("text", F.lit("clash"))).collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = " ".join(b for b in blocks if b)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_comments_beside_the_article_and_bare_attributes(spark):
    page = "<article><h1>Title</h1><p>Body text.</p><div data-u=/x/>more</div></article><article class='comment'><p>Nice article, says a reader.</p></article><p>after</p>"
    assert html_text.main_text(page) == "Title Body text. more"
    rows = [(1, page, 9), (1, page, 9), (2, None, 9), (3, "", 9), (4, "<p>" + "word " * 200_000 + "</p>", 9)]
    pages = spark.createDataFrame(rows, "page_id long, html string, n_chars long")
    got = sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in html_text.extract(pages).collect())
    assert got == [(1, 21, 21), (1, 21, 21), (2, 0, 0), (3, 0, 0), (4, 999_999, 999_999)]
    assert html_text.extract(pages.filter("page_id < 0")).count() == 0


def test_main_text_is_whole_where_links_cut_it():
    first, second = "The first part of the article, which is long enough to be a surge of its own, as it is.", "The second part is a little shorter, and it is long enough for a surge of its own too."
    links = "".join(f'<p><a href="/{i}">Read more of what we have on this</a></p>' for i in range(4))
    menu = '<div><a href="/">Home of this site</a></div>' * 4
    bare = f"<body>{menu}<p>{first}</p>{links}<p>{second}</p>{menu}</body>"
    assert html_text.main_text(bare) == f"{first} {second}"
    lines = "Read more of what we have on this " * 4
    assert html_text.main_text(bare.replace(f"<p>{first}", f"<article><p>{first}").replace(f"{second}</p>", f"{second}</p></article>")) == f"{first} {lines}{second}"


def test_sums_decide_on_marked_pages():
    title, body = "A title", "A paragraph of the article that is long enough for a surge of its own, and then some more."
    beside = "Words beside the article in a plain block that no name gives away, such as a long claim of rights. " * 3
    page = f"<div>{beside}</div><article><h1>{title}</h1><p><a href=/1>Part one</a></p><p>{body}</p><p><a href=/2>Part two</a></p></article><div>{beside}</div>"
    whole = f"{title} Part one {body} Part two"
    assert html_text.main_text(page) == whole  # links at both ends belong to it, words beside it do not surge
    assert html_text.main_text(page, surge=10) == f"{beside}{whole} {beside}".strip()  # with a low threshold they do
    assert html_text.main_text(page, surge=10_000) == whole
    long = beside * 5
    assert html_text.main_text(page.replace(beside, long)) == f"{long}{whole} {long}".strip()  # a long text beside the mark surges
    teaser = "<article><h2>Another one</h2><p>Read it.</p></article>"
    assert html_text.main_text(f"<body>{teaser}<article><p>{body}</p></article>{teaser}") == body
    both = f"<article><p>{body}</p></article><p>cut</p><article><p>{body}</p><p>End.</p></article>"
    assert html_text.main_text(both) == f"{body} {body} End."
    assert html_text.main_text("<p>beside</p><main><p>Short.</p></main>") == "Short."


def test_short_lines_before_the_surge_and_a_dive(spark):
    body = "A paragraph that is long enough for a surge of its own, and then it goes on for some more words."
    short, links = [f"<p>Line {i}</p>" for i in range(6)], "<p><a href=/>Menu of the site</a></p>" * 4
    bare = f"{links}{''.join(short)}<p>{body}</p><p>End.</p>{links}<p>left over</p>{links}"
    assert html_text.main_text(bare) == " ".join([f"Line {i}" for i in range(6)] + [body, "End."])
    assert html_text.main_text(bare, surge=5).endswith("End. left over")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", F.regexp_replace("html", "</?article>", "").alias("bare"))
    assert html_text.extract(pages).join(html_text.extract(pages, "bare").select("page_id", F.col("text").alias("of_bare")), "page_id").filter("text <> of_bare").count() == 0


# --- 10


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs.filter(~held))
    rows = language_id.identify(docs.filter(held), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and zlib.crc32(str(rows[0]["doc_id"]).encode()) % 5 == 0


def test_language_on_odd_tables(spark):
    texts = odd_texts()
    df = docs_of(spark, texts, langs={4: None, 9: "fr", 10: "fr"})
    model = language_id.train(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i] == ("und", 0.0)) == (t is None or not any(c.isalpha() for c in t))
    assert got[4] == got[5]
    assert {r["lang_pred"] for r in language_id.identify(df, language_id.train(empty(df))).collect()} == {"und"}
    assert language_id.identify(empty(df), model).count() == 0


# --- the pipeline


def test_language_equals_brute_force(spark):
    rng = random.Random(41)
    rows = [(i, "".join(rng.choice(("abcde ", "cdefg ", "xyzé ")[i % 3]) for _ in range(rng.randint(1, 40))), "abc"[i % 3]) for i in range(90)] + [(90, None, "a"), (91, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = [(t, lang) for _, t, lang in rows if t is not None and lang is not None]
    ids = {t: [i for b in language_id.blocks(t) for i in b.tolist()] for t, _ in known}
    counts = {x: {} for x in "abc"}
    for t, lang in known:
        for i in ids[t]:
            counts[lang][i] = counts[lang].get(i, 0) + 1
    size = 1 << language_id.BUCKET_BITS
    total = {x: sum(c.values()) + language_id.SMOOTHING * size for x, c in counts.items()}
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df)).collect()}
    for i, t, _ in rows[:90]:
        if not any(map(str.isalpha, t)):
            assert got[i]["lang_pred"] == "und"
            continue
        weight = min(1.0, language_id.EVIDENCE / len(ids[t]))
        score = {x: weight * sum(np.log((counts[x].get(k, 0) + language_id.SMOOTHING) / total[x]) for k in ids[t]) + np.log(30 / 90) for x in "abc"}
        best = max(sorted(score), key=score.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(np.exp(v - score[best]) for v in score.values())) < 1e-4


def test_many_languages_have_fewer_buckets(spark):
    assert [language_id.bits_for(n) for n in (0, 4, 256, 257, 1024, 65536)] == [16, 16, 16, 15, 14, 8]
    df = spark.createDataFrame([(i, f"{chr(0x4E00 + i)} word", f"l{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.log_prob.shape == (1 << 15, 300)
    assert language_id.identify(df, model).filter("lang_pred = lang").count() >= 290


def test_pipeline_equals_brute_force_where_it_can(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.language_stage(spark, docs, sf)
    given = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in first.collect()}
    assert all(any(c.isalpha() for c in given[i]["text"]) for i in kept) and len(kept) >= 0.95 * len(given)
    second = corpus_pipeline.exact_stage(spark, first, sf)
    best = {}
    for i in kept:
        t = lower_ascii(given[i]["text"])
        best[t] = max(best.get(t, i), i)
    assert {r["doc_id"] for r in second.collect()} == set(best.values())
    third = corpus_pipeline.near_stage(spark, second, sf)
    want = brute_components({i: brute_fingerprint(given[i]["text"]) for i in best.values()})
    assert {r["doc_id"] for r in third.collect()} == set(want.values())
    assert first.columns == second.columns == third.columns == docs.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(want.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
