"""Operators of the library on small inputs with known answers."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sondera.functions import dates, money, stats, text, trust
from sondera.operators import burst, evaluation, evidence, footprint, grouping, history, neighbours, ranking, scoring, training, verify
from sondera.sources import readers, works


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("title, usd", [
    ("Zama raises $51.6 Million for chips", 51.6e6), ("A $20.5M seed", 20.5e6), ("worth $1.2bn", 1.2e9), ("$500K pre-seed", 500e3), ("just $5 a month", None),
    ("no money", None), ("gets $1,200 million", 1.2e9), ("grant of $500,000", 500e3), ("$5 menu, then $20M", 20e6),
])
def test_parse_usd(spark, title, usd):
    assert one(spark, money.parse_usd("t"), t=title) == usd


def test_funding_word(spark):
    assert one(spark, money.is_funding("t"), t="Acme closes Series-A") is True
    assert one(spark, money.is_funding("t"), t="Acme ships chips") is False


def test_names_in_texts(spark):
    rows = [("federated learning", "New federated learnings for phones", True), ("rag", "averages and fragments", False), ("rag", "two RAGs compared", True), ("cnn-lstm", "a CNN LSTM hybrid", True), ("ai", "main detail", False), ("", "x", False)]
    df = spark.createDataFrame(rows, "core string, t string, want boolean")
    assert df.filter(text.core_matches(text.padded("t"), F.col("core")) != F.col("want")).count() == 0


def test_footprint_by_postings_equals_scan(spark):
    w = spark.createDataFrame(
        [(1, "federated learning at the edge", dt.date(2016, 1, 1), False), (2, "Federated learning, again", dt.date(2019, 5, 2), False), (3, "federated learnings", dt.date(2022, 6, 1), False), (4, "retrieval (RAG) agents", dt.date(2021, 3, 3), False), (5, "rags to riches", dt.date(2030, 1, 2), False)],
        "id long, term_raw string, observed_at date, junk boolean",
    ).withColumn("tok", text.padded("term_raw"))
    n = spark.createDataFrame([("federated learning",), ("rag",), ("riches",), ("nothing here",)], "name string")
    a = sorted(footprint.scan(w, n, "2022-12-31").collect())
    assert a == sorted(footprint.footprint(w, n, "2022-12-31").collect())
    assert [r for r in a if r["name"] == "federated learning"][0][1:] == (3, 2019, 1)  # 1 January is no first year
    assert sorted(footprint.footprint(w, n, "2031-01-01").select("name", "works").collect())[1:] == [("rag", 2), ("riches", 1)]


def test_as_of_shows_no_future(spark):
    w = spark.createDataFrame([(i, "graph networks", dt.date(2020, 1, 2 + i), False) for i in range(5)], "id long, term_raw string, observed_at date, junk boolean")
    n = spark.createDataFrame([("graph",)], "name string")
    early = footprint.footprint(w.filter("id < 3"), n, "2020-01-04").collect()
    assert early == footprint.footprint(w, n, "2020-01-04").collect()


def test_burst_uses_the_whole_vocabulary(spark):
    found = spark.createDataFrame([("graph convolutional", 60, 10), ("old topic", 5, 300), ("rare thing", 2, 0)], "phrase string, recent long, before long")
    titles = spark.createDataFrame([(37000, 55000)], "n_recent long, n_before long")
    got = burst.score(found, titles).collect()
    assert [r["phrase"] for r in got] == ["graph convolutional"]
    other = burst.score(found.union(spark.createDataFrame([("filler", 1, 9000)], found.schema)), titles).collect()
    assert other[0]["z"] != got[0]["z"]


def test_percentile_with_ties(spark):
    df = spark.createDataFrame([("q", 1.0), ("q", 2.0), ("q", 2.0), ("q", 3.0), ("q", None)], "q string, v double")
    got = [r[0] for r in df.select(scoring.mid_percentile("v", "q").alias("p")).orderBy(F.col("p").asc_nulls_last()).collect()]
    assert got == [0.125, 0.5, 0.5, 0.875, None]


def test_missing_value_is_the_training_median(spark):
    p = scoring.probability({"query_share_pct": F.col("v")}, scoring.GROWTH_MODEL)
    df = spark.createDataFrame([(None,), (0.5,)], "v double").select(p["probability"])
    a, b = [r[0] for r in df.collect()]
    assert a == b


def test_gate_closed_gives_no_score(spark):
    pool = spark.createDataFrame([(0.5,)], "query_share_pct double")
    assert scoring.score(pool, scoring.GROWTH_MODEL | {"gate": {"passed": False}}).first()["confidence"] is None


def test_trust(spark):
    urls = [("https://www.reuters.com/x", "media", "medium"), ("https://a.medium.com/y", "blog", "low"), ("https://nasa.gov", "gov", "high"), ("https://who.example", "media", "unknown"), ("arxiv.org", "preprint", "high")]
    df = trust.with_trust(spark.createDataFrame(urls, "url string, k string, l string"))
    assert df.filter("kind <> k or level <> l").count() == 0


def test_dates(spark):
    assert one(spark, dates.published_date("t"), t="2021") == dt.date(2021, 7, 1)
    assert one(spark, dates.iso_of_compact("t"), t="20240131") == "2024-01-31"
    assert one(spark, dates.too_late("t", F.lit("2020-06-30").cast("date")), t="soon") is False
    assert one(spark, dates.years_back(F.lit("2024-02-29").cast("date"), 1)) == dt.date(2023, 2, 28)


def test_wilson(spark):
    low, high = one(spark, stats.wilson(F.lit(0), F.lit(0)))
    assert (low, high) == (0.0, 1.0)
    low, high = one(spark, stats.wilson(F.lit(96), F.lit(100)))
    assert round(low, 2) == 0.90 and round(high, 2) == 0.98


def test_work_id(spark):
    import hashlib
    import struct

    key = "\x1f".join(("arxiv", "2101.00001", "works", str(1609459200_000000)))
    want = struct.unpack("<Q", hashlib.md5(key.encode()).digest()[8:])[0] >> 1
    got = one(spark, works.work_id(F.lit("arxiv"), F.lit("2101.00001"), F.lit("works"), F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")))
    assert got == want


def test_top_k_agrees_with_a_cross_join(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    queries = corpus.filter("id < 4").select(F.col("id").alias("query"), "v")
    got = {(r["query"], r["rank"]): r["id"] for r in neighbours.top_k(corpus.repartition(5), queries, 3).collect()}
    for q in range(4):
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-(v @ v[q]), kind="stable")[:3])
    assert neighbours.top_k(corpus.filter("id < 0"), queries, 3).count() == 0
    pairs = {(r["a"], r["b"]) for r in neighbours.pairs_above(corpus, 0.5, block_rows=3).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] >= 0.5}


def test_groups_do_not_hang_on_partitions(spark):
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.85), (4, 5, 0.9), (5, 6, 0.4)], "a long, b long, score double")
    items = spark.createDataFrame([(i, 1) for i in range(1, 8)], "id long, weight int")
    a = sorted(grouping.variant_groups(items, links, 0.7).collect())
    assert a == sorted(grouping.variant_groups(items, links.repartition(7), 0.7).collect())
    assert {r["id"] for r in a if r["head"] == a[0]["head"]} == {1, 2, 3}


def test_similar_names_find_all_pairs(spark):
    names = ["homomorphic encryption hardware and protocols", "fully homomorphic encryption hardware acceleration", "graph nets", "Graph Nets", "edge nets"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    assert {(r["a"], r["b"]) for r in grouping.similar_names(df, 0.5).collect()} == {(0, 1), (2, 3)}


def test_auc_and_excess(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, y boolean")
    assert evaluation.auc(df, "s", "y").first()["auc"] == 0.875
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 0.0), ("b", 0.0), ("b", 0.0)], "domain string, v double")
    got = {(r["domain"], r["v"]): (r["above"], r["top"]) for r in evaluation.excess(rows, "v", above_zero=True).collect()}
    assert got["a", 6.0] == (True, True) and got["b", 0.0] == (False, False)


def test_layers(spark):
    def lay(companies, **k):
        given = {"leaders": False, "commercial": False, "pilot": False, "funding": False, "works": 0, "growth": None} | k
        c = F.array(*map(F.lit, companies)) if companies else F.array().cast("array<string>")
        args = [F.lit(given[x]) for x in ("leaders", "commercial", "pilot", "funding", "works")]
        return one(spark, ranking.layer(c, *args, F.lit(given["growth"]).cast("double"), F.lit(1.0)))["layer"]

    assert lay([], leaders=True) == "trend"
    assert lay(["NVIDIA"], commercial=True) == "trend"
    assert lay(["Zama", "Niobium", "NVIDIA"], commercial=True, works=5) == "weak"
    assert lay([], works=5) == "watch"
    assert lay([], works=5, growth=2.0) == "weak"


def test_prior_runs_far_back(spark):
    """Where the near runs repeat one label set, older runs are found all the same."""
    base = dt.datetime(2024, 1, 1)
    rows = [(f"r{i:03d}", "Q", base + dt.timedelta(days=i), ["old", str(i)] if i < 3 else ["same"]) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, query string, started timestamp, labels array<string>")
    got = [r["prior"] for r in history.prior_runs(df).filter("name = 'r059'").orderBy("rank").collect()]
    assert got == ["r058", "r002", "r001", "r000"]


def test_holes(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 3, 4, 9)], "day date")
    assert [(str(a), str(b), n) for a, b, n in sorted(history.holes(days, most=3).collect())] == [("2020-01-01", "2020-01-03", 3), ("2020-01-04", "2020-01-04", 1), ("2020-01-09", "2020-01-09", 1)]


def test_quotes(spark):
    page = "The firm said on Monday that its new optical switch cut power use by 40 percent in tests."
    rows = [("its new optical switch cut power use by 40 percent", True), ("its new optical switch … by 40 percent", True), ("its new optical … by 40 percent", False), ("its new optical switch cut power use by 45 percent", False), ("by 40 percent … its new optical", False), ("", False)]
    df = spark.createDataFrame(rows, "q string, want boolean").withColumn("ok", verify.quote_appears(F.col("q"), F.lit(page)))
    assert df.filter("ok <> want").count() == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "oa.json").write_text('{"results": [{"id": "https://openalex.org/W1", "title": "T", "publication_date": "2020-05-01", "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, {"id": "https://openalex.org/W2", "title": null, "publication_date": "2020-05-01"}]}')
    r = readers.openalex(spark, str(tmp_path / "oa.json")).collect()
    assert [(x["external_id"], x["abstract"]) for x in r] == [("W1", "a b a")]
    (tmp_path / "atom.xml").write_text('<feed><entry><id>http://arxiv.org/abs/math/0101001v2</id><title>An\n entry</title><summary>s</summary><published>2001-01-02T00:00:00Z</published><updated>2005-01-01T00:00:00Z</updated></entry><entry><id>x</id></entry></feed>')
    r = readers.arxiv(spark, str(tmp_path / "atom.xml")).collect()
    assert [(x["external_id"], x["title"], str(x["observed_at"])) for x in r] == [("math/0101001v2", "An entry", "2001-01-02")]
    (tmp_path / "p.json").write_text('{"title": [{"lang": "de", "text": "Ding"}, {"lang": "en", "text": "Thing"}], "date": "20240131", "applicant": "Acme", "abstract": "x"}')
    r = readers.patents(spark, str(tmp_path / "p.json")).first()
    assert (r["title"], r["published"], r["applicants"]) == ("Thing", "2024-01-31", ["Acme"])


def test_entry_and_queries(spark):
    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_news_feed_file_and_lines(spark, tmp_path):
    feed = "<rss><channel>" + "".join(f'<item><title>Big &amp;amp; new {i} - The Daily</title><link>u{i}</link><pubDate>Tue, 03 Jan 2023 08:00:00 GMT</pubDate><source url="https://www.daily.org/x">The Daily</source></item>' for i in range(3)) + "</channel></rss>"
    (tmp_path / "feed.xml").write_text(feed)
    for lines in (False, True):
        got = sorted(tuple(r[c] for c in ("title", "url", "published", "publisher", "domain")) for r in readers.news_rss(spark, str(tmp_path / "feed.xml"), lines=lines).collect())
        assert got == [(f"Big & new {i}", f"u{i}", "2023-01-03", "The Daily", "daily.org") for i in range(3)]


def test_twins_join_first_accepted_head(spark):
    rng = random.Random(4)
    pairs = [(a, b, round(rng.random(), 3), rng.random() < 0.2) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.4]
    accepted = {(a, b) for a, b, _, _ in pairs if rng.random() < 0.4}
    near = {}
    for a, b, score, same in pairs:
        near.setdefault(a, []).append((not same, -score, b))
        near.setdefault(b, []).append((not same, -score, a))
    want = {}
    for i in range(32):
        heads = [j for _, _, j in sorted(near.get(i, [])) if want.get(j) == j][:4]
        want[i] = next((j for j in heads if (min(i, j), max(i, j)) in accepted), i)
    cands = spark.createDataFrame([(i, i) for i in range(32)], "id long, rank long")
    verdicts = spark.createDataFrame([(b, a) for a, b in accepted] or [(-1, -1)], "a long, b long")
    got = grouping.assign_twins(cands, spark.createDataFrame(pairs, "a long, b long, score double, same boolean"), verdicts)
    assert {r["id"]: r["head"] for r in got.collect()} == want


def test_copy_goes_on_or_refuses(spark):
    source = spark.range(100)
    assert sorted(r[0] for r in works.to_copy(source, spark.range(60)).collect()) == list(range(60, 100))
    assert works.to_copy(source, spark.range(0)).count() == 100
    with pytest.raises(ValueError):
        works.to_copy(source, spark.range(60).filter("id <> 3"))


def test_shuffled_deals_out_the_same_values(spark):
    rows = spark.range(500).select("id", (F.col("id") * 3).alias("v"))
    got = training.shuffled(rows, "v", "id", 7, bucket_rows=100).collect()
    assert sorted(r["v"] for r in got) == [3 * i for i in range(500)] and sum(r["v"] == 3 * r["id"] for r in got) < 25


def test_top_k_takes_any_number_of_queries(spark):
    """Every 50th vector of 1,500 asks, and blocks hold a few of them only."""
    rng = random.Random(21)
    rows = []
    for i in range(1500):
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, [x / n for x in v]))
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    queries = corpus.filter("id % 50 = 0").select(F.col("id").alias("query"), "v")
    want = {}
    for q, v in rows[::50]:
        order = sorted(((-round(sum(a * b for a, b in zip(v, w)), 9), i) for i, w in rows))
        want |= {(q, r): i for r, (_, i) in enumerate(order[:5], 1)}
    for most_numbers in (8 * 18, neighbours.MOST_QUERY_NUMBERS):
        got = neighbours.top_k(corpus, queries, 5, most_numbers).collect()
        assert len(got) == len(want) and {(r["query"], r["rank"]): r["id"] for r in got} == want


def test_students_t_and_coin(spark):
    for t, df, p in [(12.7062, 1, 0.05), (4.3027, 2, 0.05), (3.1824, 3, 0.05), (2.7764, 4, 0.05), (2.2622, 9, 0.05), (3.2498, 9, 0.01), (1.9842, 99, 0.05), (0.0, 7, 1.0), (-2.2281, 10, 0.05)]:
        assert one(spark, evaluation.t_two_sided(F.col("t"), F.col("df")), t=t, df=df) == pytest.approx(p, abs=2e-5)
    from math import comb

    for k, n in [(0, 0), (0, 1), (1, 3), (3, 10), (10, 10), (50, 100), (400, 1000), (900, 1000)]:
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
        assert one(spark, evaluation.binomial_two_sided(F.col("k"), F.col("n")), k=k, n=n) == pytest.approx(want, rel=1e-8)


def test_paired_tests(spark):
    folds = spark.createDataFrame([("x", d) for d in (0.03, 0.01, 0.05, 0.02)] + [("zero", 0.0)] * 3 + [("same", 0.5)] * 3 + [("one", 0.5)], "m string, d double")
    got = {r["m"]: r for r in evaluation.corrected_t(folds, "d", F.lit(90), F.lit(30), "m").collect()}
    naive = 0.0275 / (0.01707825 / 2)
    assert got["x"]["t"] == pytest.approx(naive / (1 + 4 / 3) ** 0.5, rel=1e-5) and 0.05 < got["x"]["p"] < 0.2
    assert (got["zero"]["t"], got["zero"]["p"]) == (0.0, 1.0) and got["same"]["t"] == float("inf") and got["same"]["p"] == 0.0 and got["one"]["t"] is None
    rows = spark.createDataFrame([(1, 1, 0)] * 7 + [(0, 1, 0)] + [(1, 1, 1)] * 3 + [(None, 1, 0)], "y int, a int, b int")
    assert tuple(evaluation.mcnemar(rows, "y", "a", "b").first())[:2] == (7, 1)


def test_platt_and_choice(spark):
    rows = [(x / 10, True) for x in range(-5, 20)] + [(x / 10, False) for x in range(-20, 6)] + [(None, True)]
    a, b = evaluation.platt(spark.createDataFrame(rows, "s double, y boolean"), "s", "y")
    grad = sum((y - 1 / (1 + 2.718281828459045 ** -(a * s + b))) * s for s, y in rows if s is not None)
    assert a > 1 and abs(grad) < 1e-3
    pick = lambda *m: evaluation.choose(spark.createDataFrame(list(m), "model string, auc double, sparse boolean")).first()["model"]
    assert pick(("a", 0.79, True), ("b", 0.80, False)) == "a" and pick(("a", 0.77, True), ("b", 0.80, False)) == "b" and pick(("a", 0.1, True)) == "a"


def test_what_reports_said(spark):
    items = spark.createDataFrame([("r1", "top", 2, "Old"), ("r1", "watch", None, "New"), ("r2", "watch", None, "New one"), ("r2", "top", 1, "NEW"), ("r3", "excluded", None, "New")], "report string, stage string, place int, label string")
    runs = spark.createDataFrame([("r1", dt.date(2019, 1, 1)), ("r2", dt.date(2020, 1, 1)), ("r3", dt.date(2018, 1, 1)), ("r4", dt.date(2017, 1, 1))], "report string, cut date")
    asked = spark.createDataFrame([("t", r, a) for r in ("r1", "r2", "r3", "r4") for a in ("new", "new one")], "target string, report string, alias string")
    places = evaluation.locate(items, runs, asked)
    assert {r["report"]: (r["stage"], r["place"], r["pool"]) for r in places.collect()} == {"r1": ("watch", None, 2), "r2": ("top", 1, 2), "r3": ("excluded", None, 1), "r4": ("missing", None, 0)}
    assert tuple(evaluation.retro(places, top=1).first()) == (4, 1, 2, 3, 2.0)
    known = spark.createDataFrame([("t", dt.date(2019, 1, 31))], "target string, day date")
    assert tuple(evaluation.lead_time(places, known).first()) == ("t", dt.date(2020, 1, 1), dt.date(2019, 1, 1), 30)


def test_first_naming_and_catalogue(spark):
    h = spark.createDataFrame([("ensemble of models", "a", 1), ("ensemble of models", "b", 2)], "label string, title string, n int")
    firms = spark.createDataFrame([("a", "Ensemble"), ("b", "Acme"), ("a", "Acme"), ("b", "Beta"), ("c", "Gone")], "title string, company string")
    assert sorted(map(tuple, grouping.first_naming(h, firms, "n").collect())) == [("ensemble of models", "Acme", 1), ("ensemble of models", "Beta", 2)]
    c = spark.createDataFrame([(1, "Federated learnings for phones", 1546300800), (2, "federated learning", 1609459200), (3, "federated learning", None), (4, None, 1546300800)], "id long, text string, launched_at long")
    got = grouping.catalogue(spark.createDataFrame([("federated learning",)], "phrase string"), c, "2020-01-01").collect()
    assert [(r["id"], str(r["launched"])) for r in got] == [(1, "2019-01-01"), (3, "None")]


def test_label_footprint_equals_matching(spark):
    r = random.Random(3)
    words = "graph graphs neural net nets ai ais deep deepest of learning".split()
    works_ = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 6))), dt.date(2020, 1, 2 + i % 20), False) for i in range(60)], "id long, term_raw string, observed_at date, junk boolean")
    labels = spark.createDataFrame([(x,) for x in ("graph ai", "neural net", "deep learning graph", "missing graph", "ai", "net-net deep")], "name string")
    want = works_.join(labels, text.label_matches(text.padded("term_raw"), F.col("name"))).filter(F.size(text.loose_words("name")) > 1).groupBy("name").count()
    assert {x["name"]: x["works"] for x in footprint.label_footprint(works_, labels, "2022-01-01").collect()} == {x["name"]: x["count"] for x in want.collect()}


# --- the index of works


def index_works(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, term_raw string, observed_at string, field string, junk boolean").withColumn("observed_at", F.to_date("observed_at")).withColumn("tok", text.padded("term_raw"))


def test_index_answers_as_the_scan_does_and_grows_by_appends(spark, tmp_path):
    from sondera.operators.postings import Postings

    rows = [
        (1, "arxiv", "Federated learning for phones; federated-learning again", "2019-05-01", "cs", False),
        (2, "arxiv", "RAG and rags to riches", "2020-01-01", "cs", False),
        (3, "openalex", "A federated data set with learnings on graph neural networks", "2021-06-01", "bio", False),
        (4, "arxiv", "graph neural network fragments; CNN-LSTM", "2022-06-01", "bio", False),
        (5, "openalex", "federated learning, but junk", "2022-07-01", "cs", True),
        (6, "arxiv", "the federated learning of the graph neural networks", "2022-08-01", "cs", False),
    ]
    names = spark.createDataFrame([(x,) for x in ("federated learning", "rag", "graph neural network", "cnn-lstm", "of the", "fed", "a", "nothing here", "", "neural networks federated")], "name string")
    works = index_works(spark, rows)
    index = Postings(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.append(works.filter("id < 4"))
    index.append(works.filter("id >= 4"))  # later works are added, the first are not read again
    assert Postings(spark, str(tmp_path / "index")).exists()
    for day in ("2020-06-01", "2022-12-31", "2000-01-01"):
        want = sorted(footprint.scan(works, names, day).collect())
        assert sorted(footprint.footprint(index, names, day).collect()) == want
        assert sorted(footprint.footprint(works, names, day).collect()) == want
        labels = names.filter("name <> ''")
        assert sorted(footprint.label_footprint(index, labels, day).collect()) == sorted(footprint.label_footprint(works, labels, day).collect())
    assert {r["token"]: r["df"] for r in index.vocabulary().collect()}["federated"] == 4
    only = index.filter("field = 'bio'").filter(F.col("observed_at") > "2022-01-01")
    assert [r["name"] for r in footprint.footprint(only, names, "2030-01-01").orderBy("name").collect()] == ["cnn-lstm", "graph neural network"]


def test_index_of_many_names_equals_the_scan(spark, tmp_path, monkeypatch):
    import random

    from sondera.operators import postings

    rng = random.Random(3)
    words = ["ab", "abc", "abcd", "bcd", "cde", "ce", "d", "de", "the", "thesis", "abs"]
    works = index_works(spark, [(i, "arxiv", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), f"20{10 + i % 10}-0{1 + i % 9}-02", "cs", False) for i in range(150)])
    names = spark.createDataFrame(list({(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))),) for _ in range(120)}), "name string")
    want = sorted(footprint.scan(works, names, "2022-12-31").collect())
    want_labels = sorted(footprint.label_footprint(works, names, "2022-12-31").collect())
    for few in (64, 0):  # a scan that names the tokens, and one that joins them
        monkeypatch.setattr(postings, "FEW", few)
        index = postings.Postings(spark, str(tmp_path / f"index{few}"))
        index.append(works)
        assert sorted(footprint.footprint(index, names, "2022-12-31").collect()) == want
        assert sorted(footprint.label_footprint(index, names, "2022-12-31").collect()) == want_labels


# --- quotes

PAGE = (
    "CRM for field service — AstraCRM. Orders, schedules, clients and analytics in one account. "
    "Plan “Start” — 1 990 € a month, up to 5 people. Revenue grew to reach 500 million dollars in 2021."
)


def test_quotes_are_on_their_page(spark):
    from sondera.operators.verify import quote_appears

    cases = [
        ('Plan "start" – 1 990 € a MONTH', True), ("Orders, schedules, clients and analitics in one account", True), ("Orders, schedules, and analytics clients in one account", False),
        ("Plan “Start” — 2 990 € a month, up to 5 people", False), ("CRM for field service … up to 5 people", True), ("up to 5 people … CRM for field service", False),
        ("CRM", False), ("", False), (None, False), ("Automation of the work of agents by example", False), ("Revenue grew to reach 50", False), ("00 million dollars in 2021.", False), ("grew", False),
        ("CRM for field service [...] grew ... in 2021", True), ("Revenue grew to reach 500 million", True),
    ]
    rows = spark.createDataFrame([(i, q, PAGE) for i, (q, _) in enumerate(cases)], "i int, q string, page string")
    got = {r["i"]: r["ok"] for r in rows.select("i", quote_appears(F.col("q"), F.col("page")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert not rows.limit(1).select(quote_appears(F.lit("a quote of twenty letters"), F.lit(None).cast("string")).alias("ok")).first()["ok"]


def test_a_cut_number_does_not_hide_a_later_whole_one():
    from sondera.operators.verify import _appears

    assert _appears("500 million dollars were paid", "1500 million dollars were paid, then 500 million dollars were paid")
    assert not _appears("500 million dollars were paid", "1500 million dollars were paid")


def test_near_quotes_equal_all_windows():
    """The anchors and the bits find what trying every window does."""
    import random

    from sondera.operators import verify

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        return row[-1]

    rng = random.Random(8)
    hits = 0
    for _ in range(60):
        page = "".join(rng.choice("abcde f") for _ in range(90))
        at, n = rng.randint(0, 60), rng.randint(20, 30)
        part = list(page[at : at + n])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], [rng.choice("abcdef")], [part[k], "x"]])
        part = "".join(part)
        slack = max(1, len(part) // 10)
        ends = [r for a in range(len(page)) for r in range(a + len(part) - slack, min(len(page), a + len(part) + slack) + 1) if 2 * common(page[a:r], part) >= 0.9 * (r - a + len(part))]
        got = verify._near_end(part, page, verify._grams(page), 0)
        assert (got is None) == (not ends)
        hits += got is not None
    assert 20 < hits < 60


def test_one_form(spark):
    from sondera.operators.verify import one_form

    rows = spark.createDataFrame([("“Ёж” — ﬁne  Straße",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(one_form(F.col("t"))).collect()] == ['"еж" - fine strasse', None, ""]


# --- greedy groups in rounds


def greedy_heads(ranks, near):
    heads, out = [], {}
    for i in sorted(ranks, key=lambda x: (ranks[x], x)):
        out[i] = next((h for h in heads if h in near.get(i, {})), i)
        if out[i] == i:
            heads.append(i)
    return out


def greedy_twins(ranks, near, same, yes, most):
    out = {}
    for i in sorted(ranks, key=lambda x: (ranks[x], x)):
        offered = sorted((not same[frozenset((i, j))], -s, j) for j, s in near.get(i, {}).items() if out.get(j) == j)[:most]
        out[i] = next((j for *_, j in offered if frozenset((i, j)) in yes), i)
    return out


def greedy_variants(near, threshold):
    free, groups, of, out = set(near), [], {}, []
    for seed in sorted(near, key=lambda i: (-len(near[i]), -round(sum(near[i].values()), 9), i)):
        if seed in free:
            members = [seed]
            for other in sorted(near[seed], key=lambda i: (-near[seed][i], i)):
                if other in free and sum(near[other].get(m, 0) for m in members) / len(members) >= threshold:
                    members.append(other)
            if len(members) > 1:
                free -= set(members)
                groups.append(members)
    for members in groups:
        head = max(members, key=lambda i: (sum(near[i].get(m, 0) for m in members), -i))
        of.update(dict.fromkeys(members, head))
    for i in free:
        reach = [(s, -j) for j, s in near[i].items() if j in of]
        out += [(i, of[-max(reach)[1]], True)] if reach else []
    return sorted(out + [(i, h, False) for i, h in of.items()])


@pytest.mark.parametrize(("n", "links", "tail"), [(9, 13, 3), (60, 130, 20_000)])
def test_greedy_groups_equal_brute_force(spark, n, links, tail):
    rng = random.Random(11)
    pairs = [(a, b, rng.randint(30, 100) / 100, rng.random() < 0.3) for a, b in sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)})]
    ranks = {i: rng.randint(0, 9) for i in range(n + 3)}
    near, same = {}, {}
    for a, b, s, c in pairs:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
        same[frozenset((a, b))] = c
    accepted = [(b, a) for a, b, *_ in pairs if rng.random() < 0.5]
    links = spark.createDataFrame(pairs, "a long, b long, score double, same boolean")
    cands = spark.createDataFrame(list(ranks.items()), "id long, rank int")
    assert {r["id"]: r["head"] for r in grouping.merge_near(cands, links, tail).collect()} == greedy_heads(ranks, near)
    verdicts = spark.createDataFrame(accepted, "a long, b long")
    got = {r["id"]: r["head"] for r in grouping.assign_twins(cands, links, verdicts, 2, tail).collect()}
    assert got == greedy_twins(ranks, near, same, {frozenset(p) for p in accepted}, 2)
    assert sorted(map(tuple, grouping.variant_groups(cands, links.drop("same"), 0.5, tail).collect())) == greedy_variants(near, 0.5)


def test_equal_names_are_linked_with_their_smallest_id(spark):
    df = spark.createDataFrame([(3, "Graph Nets"), (1, "graph nets "), (2, "GRAPH NETS"), (4, "graph nets two")], "id long, name string")
    assert sorted((r["a"], r["b"]) for r in grouping.similar_names(df, 0.6).collect()) == [(1, 2), (1, 3), (1, 4)]


def test_directions_across_runs(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", "Q", t0, ["graph neural nets", "dust"]), ("r2", "q ", t0 + dt.timedelta(1), ["Neural Graph Search"]), ("r3", "Q", t0 + dt.timedelta(2), ["graph neural fields", "dust", "new"])]
    df = spark.createDataFrame(rows, "name string, query string, started timestamp, labels array<string>")
    got = {r["name"]: (r["runs"], r["stable"]) for r in history.stability(df).collect()}
    assert got == {"r2": (1, 1), "r3": (2, 2)}  # the first label is held by both runs, dust by one of two, new by none


# --- ranks by ranges, copies over JDBC


def test_ranks_by_ranges_equal_windows(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.randint(0, 12), rng.randint(0, 9) + rng.random() // 1, rng.random() < 0.4) for _ in range(400)], "x int, y double, pos boolean").repartition(7)
    want = {r["x"]: r["r"] for r in rows.withColumn("r", evaluation.average_rank("x")).collect()}
    got = evaluation.value_ranks(rows, "x")
    assert {r["x"]: r["rank"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Window" in plan and "SinglePartition" not in plan
    whole = rows.withColumn("all", F.lit(1))
    a, b = evaluation.auc(rows, "x", "pos").first(), evaluation.auc(whole, "x", "pos", "all").first()
    assert abs(a["auc"] - b["auc"]) < 1e-12 and (a["pos"], a["neg"]) == (b["pos"], b["neg"])
    a, b = evaluation.spearman(rows, "x", "y").first(), evaluation.spearman(whole, "x", "y", "all").first()
    assert abs(a["rho"] - b["rho"]) < 1e-12 and a["n"] == b["n"] == 400
    none = rows.filter("x > 99")
    assert evaluation.auc(none, "x", "pos").first()["auc"] is None and evaluation.spearman(none, "x", "y").first()["n"] == 0


def test_copy_over_jdbc_breaks_off_and_goes_on(spark, tmp_path):
    import shutil

    address = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    step = 2**63 // 40
    rows = spark.createDataFrame([(i * step + step // 2, f"work {i}") for i in range(40)], "id long, title string")
    rows.coalesce(1).write.format("jdbc").options(url=address, dbtable="works", createTableColumnTypes="title varchar(64)", **driver).save()
    path = str(tmp_path / "copy")
    assert works.copy_ranges(spark, address, "works", "id", path, 4, 3, **driver) == [(0, 10), (1, 10), (2, 10), (3, 10)]
    assert works.jdbc(spark, address, "works", "id", 8, **driver).rdd.getNumPartitions() == 8
    shutil.rmtree(f"{path}/range=2")  # as if it had broken off there
    assert works.copy_ranges(spark, address, "works", "id", path, 4, 3, **driver) == [(2, 10)]
    assert sorted((r["id"], r["title"]) for r in spark.read.parquet(path).collect()) == sorted(map(tuple, rows.collect()))
    spark.createDataFrame([(7, "late")], "id long, title string").write.format("jdbc").mode("append").options(url=address, dbtable="works", **driver).save()
    with pytest.raises(ValueError):
        works.copy_ranges(spark, address, "works", "id", path, 4, 3, **driver)


# --- streams with timers and an end


def _waited(found, seconds=60):
    import time

    until = time.time() + seconds
    while time.time() < until:
        got = found()
        if got:
            return got
        time.sleep(0.5)
    return found()


def test_idle_run_alarms_without_a_new_event(spark, tmp_path):
    from sondera.streaming import feeds

    spark.conf.set(*feeds.STATE_STORE)
    try:
        spark.createDataFrame([(1, 5), (2, 1), (1, 6)], "job_id long, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job_id long, seq long").parquet(str(tmp_path / "in"))
        q = feeds.idle_alarms(stream, 2).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        try:
            got = _waited(lambda: sorted(map(tuple, spark.table("alarms").collect())) if spark.table("alarms").count() >= 2 else [])
        finally:
            q.stop()
        assert got == [(1, 6), (2, 1)]
    finally:
        spark.conf.unset(feeds.STATE_STORE[0])


def test_lower_version_that_comes_later_wins(spark, tmp_path):
    from sondera.streaming import feeds

    spark.conf.set(*feeds.STATE_STORE)
    try:
        put = lambda rows: spark.createDataFrame(rows, "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        put([("a/1v3",), ("a/2",), ("a/1v4",)])
        stream = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
        q = feeds.replaced_versions(stream, 3600).writeStream.format("memory").outputMode("update").queryName("versions").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        try:
            assert _waited(lambda: spark.table("versions").count() == 2)
            put([("a/1v2",), ("a/2v5",)])
            assert _waited(lambda: spark.table("versions").count() == 3)
            got = [tuple(r) for r in spark.table("versions").collect()]
            rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        finally:
            q.stop()
        assert sorted(got) == [("a/1", 2), ("a/1", 3), ("a/2", 1)] and rows <= 2 * 2
    finally:
        spark.conf.unset(feeds.STATE_STORE[0])


def test_pairs_of_equal_and_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.15
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[250:290], v[290:] = v[3], 0.0  # a class of copies, and vectors of no length
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(7)
    for threshold in (0.9, 0.2):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if v[i] @ v[j] >= threshold}
        for block_rows in (16, 4096):
            got = [(r["a"], r["b"]) for r in neighbours.pairs_above(rows, threshold, block_rows).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    pairs, members = neighbours.classes_above(rows, 0.9, 16)
    assert members.count() == 300 and members.filter("rep = 3").count() == 41
    assert pairs.filter("a = 3 or b = 3").count() == sum(1 for i in range(250) if i != 3 and v[i] @ v[3] >= 0.9)
    assert neighbours.pairs_above(rows.filter("id < 0"), 0.5).count() == 0


def test_rows_that_meet_in_a_task_do_not_grow(spark):
    rng = np.random.default_rng(6)
    most, met = [], []
    for n in (400, 4000):
        v = np.concatenate([rng.normal(size=(1, 8)).repeat(n // 2, 0) + rng.normal(size=(n // 2, 8)) * 0.05, rng.normal(size=(n // 2, 8))])
        v /= np.linalg.norm(v, axis=1)[:, None]
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
        left, right = neighbours.meetings(rows, 0.9, 100)
        keys = ["block_a", "block_b", "part_a", "part_b"]
        groups = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("r")), keys)
        most.append(groups.agg(F.max(F.greatest("l", "r"))).first()[0])
        met.append(groups.agg(F.sum(F.col("l") * F.col("r"))).first()[0] / (n * n / 2))
    assert max(most) < 180 and met[1] < 0.6  # 100 by the mean, hashes deal unevenly; far blocks do not meet


def test_facets_at_a_date_are_filled_from_bursts(spark):
    facets = spark.createDataFrame([("q", f"f{i}", i) for i in range(1, 8)] + [("r", "f1", 1), ("s", "f9", 1)], "query string, facet string, place int")
    prints = spark.createDataFrame([("f1", 3), ("f2", 2), ("f3", 9), ("f4", 4), ("f9", 0)], "facet string, works long")
    bursts = spark.createDataFrame([(q, b, i) for q in "qt" for i, b in enumerate(["b1", "f3", "b2", "b3", "b4", "b5", "b6", "b7"])], "query string, facet string, place int")
    got = {q: [] for q in "qrst"}
    for r in footprint.dated_facets(facets, prints, bursts).orderBy("query", "place").collect():
        got[r["query"]].append(r["facet"])
    assert got == {"q": ["f1", "f3", "f4", "b1", "b2", "b3"], "r": ["f1"], "s": [], "t": ["b1", "f3", "b2", "b3", "b4", "b5"]}
    many = spark.createDataFrame([(f"f{i}", 5) for i in range(1, 8)], "facet string, works long")
    assert footprint.dated_facets(facets, many, bursts).filter("query = 'q'").count() == 7  # none is cut, none filled up


def test_batches_by_topic(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[20:24] = v[7]
    docs = [(i, f"t{i % 9}", x.tolist()) for i, x in enumerate(v)]
    queries = [(100 + i, v[i * 11].tolist()) for i in range(4)]
    nearest = {i: min((-round(float(np.dot(x, q)), 9), k) for k, q in queries) for i, _, x in docs}
    order = sorted((nearest[i][1], nearest[i][0], t, i) for i, t, _ in docs)
    got = {r["id"]: (r["query"], r["batch"]) for r in neighbours.topic_batches(spark.createDataFrame(docs, "id long, title string, v array<double>").repartition(6), spark.createDataFrame(queries, "query long, v array<double>"), 7).collect()}
    assert got == {i: (q, place // 7) for place, (q, _, _, i) in enumerate(order)}


def test_folds_hold_outcomes_within_one_row(spark):
    rows = spark.range(1007).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    for bucket_rows in (10_000, 60):
        dealt = training.stratified(rows, "y", "id", 5, bucket_rows=bucket_rows)
        counts = {}
        for y, fold, n in dealt.groupBy("y", "_fold").count().collect():
            counts.setdefault(y, {})[fold] = n
        assert dealt.count() == 1007 and all(len(c) == 5 and max(c.values()) - min(c.values()) <= 1 for c in counts.values())
    one, two = (training.stratified(rows, "y", "id", 5, seed).select("id", "_fold") for seed in (1, 2))
    assert one.join(two.withColumnRenamed("_fold", "other"), "id").filter("_fold <> other").count() > 500


def test_two_measures_and_two_sides(spark):
    form = "name string, works long, first_year int, last_year_works long"
    a = spark.createDataFrame([("a", 10, 2001, 1), ("b", 20, 2002, 2), ("c", 30, 2003, 3), ("d", 0, None, 0)], form)
    b = spark.createDataFrame([("a", 10, 2001, 1), ("b", 40, 2002, 2), ("c", 60, 2004, 3), ("e", 1, 2005, 1)], form)
    r = evaluation.agreement(a, b, "name").first()
    assert (r["n"], r["both"], r["only_a"], r["only_b"], r["median_ratio"], r["passed"]) == (5, 3, 0, 1, 2.0, False)
    assert r["same_year"] == pytest.approx(2 / 3) and 0.9 < r["rho"] <= 1
    assert evaluation.agreement(a, a, "name").first()["passed"] is True
    rows = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, z double")
    got = {(s["side"], s["feature"]): (s["n"], s["missing"], s["q2"]) for s in evaluation.skew({"one": rows, "none": rows.filter("x < 0")}, ["x", "z"]).collect()}
    assert got[("one", "x")] == (2, 0, 2.0) and got[("one", "z")] == (0, 2, None) and ("none", "x") not in got


def test_floor_of_each_group(spark):
    rows = spark.createDataFrame([(g, i, float((i * 7) % 40), i % 3 == 0 and g != "no") for g in ("a", "b", "no") for i in range(40)], "g string, key long, score double, y boolean")
    got = {r["g"]: r["floor"] for r in evaluation.permutation_floor(rows, "score", "y", "key", "g").collect()}
    assert got["a"] == got["b"] and 0.5 < got["a"] < 0.8 and got["no"] is None  # equal keys are dealt alike; one outcome has no area
    assert evaluation.permutation_floor(rows.filter("g = 'a'"), "score", "y", "key").first()["floor"] == got["a"]


def test_candidate_features_and_their_missing_states(spark):
    d = dt.date
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    papers = spark.createDataFrame([("a", 0.5, d(2020, 12, 1)), ("a", 0.7, d(2018, 12, 31)), ("b", 0.4, None)], "label string, score double, day date")
    news = spark.createDataFrame(
        [("a", "Firm raises $3M seed", "https://www.nist.gov/x", "", d(2020, 12, 31)), ("a", "Other news", "https://reuters.com/y", "Reuters", d(2020, 1, 1)), ("a", "Other news", "https://reuters.com/z", "Reuters", None)],
        "label string, title string, url string, publisher string, published date",
    )
    form = "label string, works long, first_year int, last_year_works long"
    core, whole = spark.createDataFrame([("a", 8, 2015, 2), ("b", 0, None, 0)], form), spark.createDataFrame([("a", 2, 2016, 1), ("b", 0, None, 0)], form)
    got = {r["label"]: r.asDict() for r in evidence.candidate_features(labels, papers, news, core, whole, "2020-12-31").collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert set(a) == {"label", *evidence.FEATURES} and len(evidence.FEATURES) == 20
    assert (a["papers_found"], a["cos_max"], a["cos_mean"], a["paper_first_age_days"], a["paper_recent_share"]) == (2, 0.7, pytest.approx(0.6), 731, 0.5)
    assert (a["news_found"], a["publishers_distinct"], a["source_kinds_distinct"], a["trust_high_count"], a["news_first_age_days"], a["news_span_days"]) == (3, 2, 3, 1, 365, 365)
    assert (a["recent_share"], a["funding_share"]) == (0.75, pytest.approx(1 / 3))
    assert (a["core_works"], a["core_age_years"], a["core_unseen"], a["core_last_year_share"], a["label_last_year_share"], a["label_to_core_ratio"]) == (8, 5, 0, 0.25, 0.5, 0.25)
    assert (b["core_unseen"], b["core_age_years"], b["label_to_core_ratio"], b["paper_recent_share"], b["recent_share"], b["news_found"], b["funding_share"]) == (1, None, None, None, 0.0, 0, None)
    assert (c["core_unseen"], c["core_works"], c["papers_found"], c["cos_max"], c["source_kinds_distinct"]) == (None, None, 0, None, 0)
    assert evidence.candidate_features(labels.filter("label = 'z'"), papers, news, core, whole, "2020-12-31").count() == 0


def test_similar_names_meet_by_combinations_of_words(spark):
    rng = random.Random(3)
    words = [{f"kind{rng.randrange(4)}x", f"size{rng.randrange(5)}", f"brand{rng.randrange(4)}", *(f"w{rng.randrange(6)}x" for _ in range(rng.randrange(4)))} for _ in range(300)]
    names = sorted({" ".join(sorted(w)) for w in words} | {"size1", "kind1x size1"})
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    sets = [set(n.split()) for n in names]
    for least in (0.4, 0.5, 0.8):
        want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
        assert {(r["a"], r["b"]) for r in grouping.similar_names(df, least).collect()} == want


def test_names_of_frequent_words_do_not_all_meet(spark):
    """Every word is in a tenth of the names: by one rare word of each some 80,000 pairs would meet, and none is alike."""
    names = [(i, f"aaa{i // 100} bbb{i // 10 % 10} ccc{i % 10} ddd{(i // 100 + i // 10 + i) % 10}") for i in range(1000)]
    nodes = spark.createDataFrame(names, "id long, name string").select("id", grouping._words("name").alias("words"))
    df = nodes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    keyed = grouping._meeting_keys(nodes, ["id"], df, 0.8).collect()
    by_key = {}
    for r in keyed:
        by_key.setdefault(r["key"], set()).add(r["id"])
    assert sum(len(g) * (len(g) - 1) // 2 for g in by_key.values()) < 1000


def test_floor_by_slices_and_pages_equals_brute_force(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(evaluation, "PAGE", 8)  # 150 rows: sixteen slices to the two digits, nineteen pages
    rng = random.Random(5)
    data = [(k, None if k % 10 == 3 else rng.randrange(20) / 20, rng.random() < 0.3) for k in range(150)]
    own = sorted((k, s, y) for k, s, y in data if s is not None)
    scores = sorted(s for _, s, _ in own)
    rank = {s: scores.index(s) + (scores.count(s) + 1) / 2 for s in scores}
    pos = sum(y for _, _, y in own)
    areas = []
    for t in range(1, 201):
        dealt = sorted(own, key=lambda r: (hashlib.md5(f"7:{t}:{r[0]}".encode()).hexdigest(), r[0]))
        areas.append((sum(rank[r[1]] for r, o in zip(dealt, own) if o[2]) - pos * (pos + 1) / 2) / (pos * (len(own) - pos)))
    rows = spark.createDataFrame(data, "key long, score double, y boolean")
    assert evaluation.permutation_floor(rows, "score", "y", "key").first()["floor"] == pytest.approx(sorted(areas)[190], abs=1e-12)
    assert evaluation.permutation_floor(rows.filter("key < 0"), "score", "y", "key").first()["floor"] is None


def test_neighbourhoods_count_all_that_are_close(spark):
    day = dt.date(2021, 1, 1)
    corpus = spark.createDataFrame([(i, [1.0, 0.0], day) for i in range(2500)] + [(9000, [0.0, 1.0], dt.date(2019, 1, 1))], "id long, v array<double>, observed_at date").repartition(3)
    got = neighbours.neighbourhoods(corpus, spark.createDataFrame([(1, [1.0, 0.0])], "query long, v array<double>"), "2022-06-30").first()
    assert (got["nn_now"], got["nn_asof"], got["dense_last"], got["dense_prev"]) == (1.0, 0.0, 2500, 0)
    assert neighbours.neighbourhoods(corpus.filter("id < 0"), spark.createDataFrame([(1, [1.0, 0.0])], "query long, v array<double>"), "2022-06-30").count() == 0


def test_top_k_memory_does_not_grow_with_a_batch():
    """A batch of 10,000 vectors and 1,024 queries: sorted at once, the scores alone are 80 MB, all that is held 5 times as much."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(4)
    m, v = rng.normal(size=(1024, 4)), rng.normal(size=(10_000, 4))
    batch = pd.DataFrame({"id": np.arange(len(v)), "v": list(v)})
    tracemalloc.start()
    got = next(iter(neighbours._best_of(np.arange(len(m)), m, 3, iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
    assert got["id"].to_numpy().reshape(-1, 3).tolist() == np.argsort(-(m @ v.T), axis=1, kind="stable")[:, :3].tolist()


def test_a_chain_of_twins_needs_no_round_for_each(spark, monkeypatch):
    """Each of 60 waits for the one before. By rounds that took a cut table or two each; by blocks of 20 offers it takes three blocks."""
    calls, cut = [], grouping.cut
    monkeypatch.setattr(grouping, "cut", lambda df: calls.append(1) or cut(df))
    cands = spark.createDataFrame([(i, i) for i in range(60)], "id long, rank long")
    pairs = spark.createDataFrame([(i, i + 1, 0.5, False) for i in range(59)], "a long, b long, score double, same boolean")
    got = grouping.assign_twins(cands, pairs, pairs.select("a", "b"), tail=20)
    assert {r["id"]: r["head"] for r in got.collect()} == {i: i - i % 2 for i in range(60)}
    assert len(calls) < 10


def test_dense_variants_need_no_round_for_each_group(spark, monkeypatch):
    """150 items all linked: only one seed at a time comes before every other within two links, so rounds would be as many as groups."""
    rng = random.Random(6)
    near = {i: {} for i in range(150)}
    for a in range(150):
        for b in range(a + 1, 150):
            near[a][b] = near[b][a] = round(rng.uniform(0.3, 0.7), 3)
    calls, cut = [], grouping.cut
    monkeypatch.setattr(grouping, "cut", lambda df: calls.append(1) or cut(df))
    links = spark.createDataFrame([(a, b, s) for a in near for b, s in near[a].items() if a < b], "a long, b long, score double")
    got = grouping.variant_groups(spark.range(150), links, 0.55)
    assert sorted(map(tuple, got.collect())) == greedy_variants(near, 0.55)
    assert len(calls) < 30


def corpus_folder(spark, tmp_path):
    docs = [(i, f"alpha{i % 3} network{'s' * (i % 2)} beta gamma{i % 40} number{i}", "en", "src1" if i % 2 else "src2", 40) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_names_and_footprints_need_no_index_of_all_occurrences(spark, tmp_path):
    """Names, pairs and footprints are counted before anything is shuffled, and no index is written."""
    from sondera.lineage import checkpoint_dir
    from sondera.plans import QUERIES
    from sondera.plans import views as V

    d, at = corpus_folder(spark, tmp_path), Path(checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in at.glob("postings*")}
    got = sorted(QUERIES["a1_footprint"](spark, d).collect())
    assert got == sorted(footprint.scan(V.works(spark, d), V.names(spark, d), V.AS_OF).collect()) and len(got) == 30
    assert QUERIES["f17_patent_growth"](spark, d).count() == V.names(spark, d).count()
    assert {p.name for p in at.glob("postings*")} == before


def test_pairs_are_counted_of_frequent_words_only(spark, tmp_path, monkeypatch):
    from sondera.plans import corpus_queries

    d = corpus_folder(spark, tmp_path)
    n, want = 120, {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        t = r["text"].split()
        for pair in {f"{a} {b}" for a, b in zip(t, t[1:])}:
            want[pair] = want.get(pair, 0) + 1
    want = {p: k for p, k in want.items() if k * 40 >= n and k * 20 <= n}
    assert {r["name"]: r["df"] for r in corpus_queries._count_pairs(spark, d).collect()} == want
    plan = corpus_queries._count_pairs(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() or " IN " in plan.upper()
    monkeypatch.setattr(corpus_queries, "_MOST_WORDS", 1)
    assert {r["name"]: r["df"] for r in corpus_queries._count_pairs(spark, d).collect()} == want


def test_phrases_are_looked_up_in_a_broadcast(spark):
    """The texts that hold a phrase's first word do not come together in one task."""
    texts = spark.createDataFrame([(i, "deep learning of graph nets") for i in range(20)], "id long, text string")
    phrases = spark.createDataFrame([("deep learning",), ("graph net",)], "phrase string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = grouping.contains_phrase(phrases, texts)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.select("phrase", "id").collect())) == [(p, i) for p in ("deep learning", "graph net") for i in range(3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_word_positions_are_made_in_the_row(spark):
    rows = [(1, ["b", "a", "b", "c", "b"]), (2, []), (3, None), (4, ["x"])]
    df = spark.createDataFrame(rows, "id long, w array<string>").select("id", readers.word_positions(F.col("w")).alias("m"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["m"] for r in df.collect()} == {1: {"a": [1], "b": [0, 2, 4], "c": [3]}, 2: None, 3: None, 4: {"x": [0]}}
    assert [r[0] for r in df.orderBy("id").select(readers.inverted_abstract(F.col("m"))).collect()] == ["b a b c b", "", "", "x"]


def test_twin_options_by_parts_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6))
    v[40:44] = v[39]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i % 3, str(i % 7) if i % 11 else "lone", v[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, run long, core string, v array<double>")
    want = set()
    for i, run, core, _ in rows:
        near = [(c != core, -round(float(v[i] @ v[j]), 9), j) for j, r, c, _ in rows if i % 4 and not j % 4 and r == run and (c == core or v[i] @ v[j] >= 0.3)]
        want |= {(i, j, n + 1) for n, (_, _, j) in enumerate(sorted(near)[:4])}
    items, heads = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    assert set(map(tuple, grouping.twin_options(items, heads, 0.3).collect())) == want
    others = heads.select(F.col("id").alias("other"), "run", F.col("v").alias("w"))
    whole, parts = (sorted(map(tuple, neighbours.best_in_groups(items, others, ["run"], 4, 0.3, n).select("id", "other").collect())) for n in (4096, 3))
    assert whole == parts


def test_seeded_orders_are_dealt_in_parts(spark, monkeypatch):
    """A task deals so many candidates to all orders at most, and the result does not hang on how many."""
    from sondera.plans import QUERIES, evidence_queries

    run = lambda: QUERIES["m16_ranking_coverage"](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in run()._jdf.queryExecution().executedPlan().toString()
    whole = sorted(run().collect())
    monkeypatch.setattr(evidence_queries, "_PART_ROWS", 7)
    assert sorted(run().collect()) == whole


def test_a_fold_is_imputed_once_for_all_strengths(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), None if i % 9 == 0 else float(b), int(a + b + rng.normal() > 0)) for i, (a, b) in enumerate(x)], "a double, b double, y int")
    calls, fit = [], training.Imputer._fit
    monkeypatch.setattr(training.Imputer, "_fit", lambda self, rows: calls.append(1) or fit(self, rows))
    got = {r["penalty"]: r for r in training.fit_logistic(df, ["a", "b"], "y", grid=(0.1, 1.0), folds=2).collect()}
    assert len(calls) == 2 and set(got) == {"l1", "l2"} and all(r["auc"] > 0.7 and r["c"] in (0.1, 1.0) for r in got.values())


def test_dense_variants_beyond_a_block_need_no_round_for_each_group(spark, monkeypatch):
    """A dense component of more links than a block, beside small ones: blocks of seeds in order, not a round for each group."""
    rng = random.Random(8)
    near = {}
    for at, n, least in ((0, 150, 0.3), (200, 5, 0.6), (300, 2, 0.9)):
        for a in range(at, at + n):
            for b in range(a + 1, at + n):
                near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = round(rng.uniform(least, least + 0.1 if at else 0.7), 3)
    calls, cut = [], grouping.cut
    monkeypatch.setattr(grouping, "cut", lambda df: calls.append(1) or cut(df))
    links = spark.createDataFrame([(a, b, s) for a in near for b, s in near[a].items() if a < b], "a long, b long, score double")
    got = grouping.variant_groups(spark.range(150), links, 0.55, tail=20_000)
    assert sorted(map(tuple, got.collect())) == greedy_variants(near, 0.55)
    assert len(calls) < 60


def test_near_names_take_few_jobs(spark, monkeypatch):
    """Few links take one cut table and no rounds of components; a chain, beyond a tail, takes rounds and the same heads."""
    calls, cut = [], grouping.cut
    monkeypatch.setattr(grouping, "cut", lambda df: calls.append(1) or cut(df))
    ranks = {i: i // 2 for i in range(40)}
    near = {i: {j: 1.0 for j in (i - 1, i + 1) if j in ranks} for i in ranks}
    cands = spark.createDataFrame(list(ranks.items()), "id long, rank int")
    links = spark.createDataFrame([(i, i + 1) for i in range(39)], "a long, b long")
    assert {r["id"]: r["head"] for r in grouping.merge_near(cands, links).collect()} == greedy_heads(ranks, near)
    assert len(calls) < 3
    assert {r["id"]: r["head"] for r in grouping.merge_near(cands, links, tail=20).collect()} == greedy_heads(ranks, near)


def test_directions_are_compared_in_the_row(spark):
    """Labels meet labels of earlier runs in the report's own row, not by a shuffle of keys of all their words."""
    rows = [(f"r{i}", "q", dt.datetime(2024, 1, 1 + i), ["graph neural nets", f"dust {i}", f"other{i}", None]) for i in range(9)]
    got = history.stability(spark.createDataFrame(rows, "name string, query string, started timestamp, labels array<string>"))
    assert {r["name"]: (r["runs"], r["stable"]) for r in got.collect()} == {f"r{i}": (min(i, 5), 2) for i in range(1, 9)}
    assert "FlatMap" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" not in plan


def test_pairs_of_single_vectors_are_not_shuffled(spark):
    """What the tasks find is joined with the few equal vectors in a broadcast; copies still give all their pairs."""
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.6, 0.8] if i < 5 else [0.0, 1.0]) for i in range(6)], "id long, v array<double>")
    got = neighbours.pairs_above(rows, 0.7)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter, (a#") + plan.count("LeftOuter, (b#") == 2 == plan.count("rightHint=(strategy=broadcast)")


def test_vectors_are_not_shuffled_to_the_parts_that_they_meet(spark):
    """Vectors without clusters meet everywhere: written out for each part they would take the square of their number on disk."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs, _ = neighbours.classes_above(rows, 0.3, 16)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if v[i] @ v[j] >= 0.3}
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_numbers", [400, 50_000_000])
def test_groups_of_vectors_equal_brute_force_and_write_no_links(spark, monkeypatch, most_numbers):
    """240 vectors of some 8,000 links, copies among them: in small blocks or one, no table that is cut has more rows than there are vectors."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(6, 8))[rng.integers(0, 6, 240)] + rng.normal(size=(240, 8)) * 0.9
    v[200:212] = v[5]
    v /= np.linalg.norm(v, axis=1)[:, None]
    score = v @ v.T
    near = {i: {int(j): float(score[i, j]) for j in np.flatnonzero(score[i] >= 0.5) if j != i} for i in range(240)}
    near = {i: n for i, n in near.items() if n}
    rows, cut = [], grouping.cut
    monkeypatch.setattr(grouping, "cut", lambda df: (rows.append((out := cut(df)).count()), out)[1])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = grouping.vector_groups(df, 0.5, 0.6, most_numbers)
    assert sorted(map(tuple, got.collect())) == greedy_variants(near, 0.6)
    assert sum(map(len, near.values())) > 4000 and max(rows) <= 240


@pytest.mark.parametrize(("tail", "block"), [(40, 16), (1_000_000, 4096)])
def test_twins_of_vectors_equal_brute_force_and_make_no_other_pairs(spark, monkeypatch, tail, block):
    """120 vectors of some 2,000 links, copies, one without a core and one without a vector: only heads and a block's members are offered."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(4, 6))[rng.integers(0, 4, 120)] + rng.normal(size=(120, 6)) * 0.9
    v[90:100] = v[5]
    v /= np.linalg.norm(v, axis=1)[:, None]
    score, ranks = np.round(v @ v.T, 9), {i: i * 7 % 30 for i in range(121)}
    near = {i: {int(j): float(score[i, j]) for j in np.flatnonzero(score[i] >= 0.5) if j != i} for i in range(120)}
    same = {frozenset((i, j)): i % 5 == j % 5 and 9 not in (i, j) for i in near for j in near[i]}
    yes = {p for p in same if sum(p) % 3}
    rows, cut = [], grouping.cut
    monkeypatch.setattr(grouping, "cut", lambda df: (rows.append((out := cut(df)).count()), out)[1])
    monkeypatch.setattr(grouping, "MOST_BLOCK", block)
    items = [(i, ranks[i], None if i == 9 else i % 5, v[i].tolist() if i < 120 else None) for i in range(121)]
    df = spark.createDataFrame(items, "id long, rank long, core long, v array<double>").repartition(3)
    got = grouping.vector_twins(df, 0.5, lambda o: o.withColumn("yes", (F.col("id") + F.col("other")) % 3 != 0), 2, tail)
    assert {r["id"]: r["head"] for r in got.collect()} == greedy_twins(ranks, near, same, yes, 2)
    assert sum(map(len, near.values())) > 2000 and max(rows) <= 121
