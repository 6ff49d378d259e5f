"""SimHash near-dedup: links by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a 23-bit word with leading zeros. When two
fingerprints differ in 4 bits or fewer, either no segment has more than 2 of them, or one segment has 3 or 4 and then
another has none and the last at most 1. Golay keys meet whenever a segment differs in at most 2 bits, so two kinds of
bucket find every such pair: a Golay key of each of the three segments, and one segment as it is with a Golay key of
another. Members of a bucket are then compared bit by bit. A bucket gives at most one link per member (a spanning
forest of its true links), so that a large group of near copies does not become all of its pairs.

Where a bucket holds very many fingerprints they are dealt out again, each to all words within 2 bits of it: any two
that differ in 4 bits share such a word, and no word has more than 2,081 fingerprints around it. No task gets a group
that grows with the input, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import golay
from sondera.llm.common import cut, table, with_hot_apart
from sondera.llm.components import components

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit, width
#: Shingles hashed at a time, so that a very long text needs no more memory than a long one.
BLOCK = 1 << 16
#: A bucket with more fingerprints than this is not compared but dealt out again by neighbouring words.
MOST_IN_BUCKET = 1 << 14


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes. No words: zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and \\x20 \\x09-\\x0D, alone
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, set_bits = len(parts) - words + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, to - at)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, *more: Column) -> DataFrame:
    """(doc_id, fp, and ``more`` columns): fp is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in batch], np.uint64).view(np.int64))

    return docs.select("doc_id", of("text").alias("fp"), *more)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) of all buckets of the given unsigned fingerprints.

    The two highest bits of a key are the kind of bucket: 0 for three Golay keys, 1 for a segment with a Golay key.
    """
    segments = [(fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near, counts = zip(*(golay.keys(s) for s in segments))
    where, key = [], []
    everyone = np.arange(len(fps))

    def add(picked: np.ndarray, value: np.ndarray) -> None:
        where.append(picked)
        key.append(value)

    for i in range(6):
        for j in range(6):
            for k in range(6):
                has = everyone[(counts[0] > i) & (counts[1] > j) & (counts[2] > k)]
                if len(has):
                    add(has, near[0][has, i] << 24 | near[1][has, j] << 12 | near[2][has, k])
    for kind, (a, b) in enumerate(permutations(range(3), 2)):
        for i in range(6):
            has = everyone[counts[b] > i]
            if len(has):
                add(has, np.int64(1) << 62 | np.int64(kind) << 40 | segments[a][has] << 12 | near[b][has, i])
    return np.concatenate(where), np.concatenate(key)


def links_within(fps: np.ndarray, most: int = MAX_BITS) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints of one bucket."""
    root = np.arange(len(fps))
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= most)
        for r in np.unique(root[near]):
            yield int(i), int(near[root[near] == r][0])
            root[root == r] = root[i]


def _bucket_links(rows: pd.DataFrame, most: int, most_in_bucket: int) -> list[tuple[int, int]]:
    """Links of the buckets in ``rows`` (key, fp), which hold whole buckets, sorted by key.

    Of a bucket that is too large each member is linked to itself: the sign that it must be dealt out again.
    """
    key, fp = rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    edge = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], edge)), np.append(edge, len(key))
    out: list[tuple[int, int]] = []
    two = starts[ends - starts == 2]
    close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most]
    out += zip(fp[close].tolist(), fp[close + 1].tolist())
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        own = np.unique(fp[s:e])
        if e - s > most_in_bucket:
            out += zip(own.tolist(), own.tolist())
        elif (np.bitwise_count(own ^ own[0]) <= most).all():
            out += ((int(x), int(own[0])) for x in own[1:])
        else:
            out += ((int(own[i]), int(own[j])) for i, j in links_within(own, most))
    return out


def _links_by_key(keyed: DataFrame, most: int, most_in_bucket: int) -> DataFrame:
    """(a, b): the links of the buckets of ``keyed`` (key, fp). A task holds ``most_in_bucket`` rows of a bucket at most."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the last bucket of a batch waits for the next batch, where it may go on."""
        rest: list[pd.DataFrame] = []
        large = None  # key of the last bucket, once it is known to be too large
        for batch in batches:
            if large is not None:
                to = int(np.searchsorted(batch["key"].to_numpy(), large, side="right"))
                own, batch = batch["fp"].iloc[:to].to_numpy(), batch.iloc[to:]
                yield pd.DataFrame({"a": own, "b": own})
            if not len(batch):
                continue
            large, last = None, batch["key"].iat[-1]
            if rest and rest[0]["key"].iat[0] == last:
                rest.append(batch)
            else:
                open_from = int(np.searchsorted(batch["key"].to_numpy(), last))
                done = pd.concat([*rest, batch.iloc[:open_from]])
                rest = [batch.iloc[open_from:]]
                if len(done):
                    yield as_frame(_bucket_links(done, most, most_in_bucket))
            if sum(map(len, rest)) > most_in_bucket:
                own = pd.concat(rest)["fp"].to_numpy()
                yield pd.DataFrame({"a": own, "b": own})
                rest, large = [], last
        if rest:
            yield as_frame(_bucket_links(pd.concat(rest), most, most_in_bucket))

    def as_frame(found: list[tuple[int, int]]) -> pd.DataFrame:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long").distinct()


def _keyed(fps: DataFrame, spread) -> DataFrame:
    """Few bytes become many rows: deal them out by the session's number of partitions, not by their size."""
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(spread, "key long, fp long")


def neighbour_links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """As ``fingerprint_links``, by the words that lie within half of ``most`` bits (rounded up) of each fingerprint."""
    radius = -(-most // 2)
    masks = np.array([sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], np.uint64)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch["fp"].to_numpy()[at : at + 64]
                yield pd.DataFrame({"key": (part.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64), "fp": np.repeat(part, len(masks))})

    return _links_by_key(_keyed(fps, spread), most, len(masks))


def fingerprint_links(fps: DataFrame, most: int = MAX_BITS, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` of ``fps`` as all pairs within ``most`` bits would."""
    if most > MAX_BITS:
        raise ValueError(f"the buckets find pairs that differ in {MAX_BITS} bits at most")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch["fp"].to_numpy()[at : at + 2048]
                where, key = bucket_keys(part.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": part[where]})

    links = cut(_links_by_key(_keyed(fps, spread), most, most_in_bucket))
    crowded = links.filter("a = b").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return links
    return links.filter("a <> b").unionByName(neighbour_links(crowded, most))


def _grouped(found: DataFrame, most: int) -> DataFrame:
    """``found`` (doc_id, fp, ...) with component_id."""
    groups = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    links = fingerprint_links(groups, most)
    reached = components(links)
    first = reached.join(groups, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = reached.join(first, "component").select(F.col("node").alias("fp"), "least_id", "component")
    named = cut(groups.join(linked, "fp", "left").select("fp", "copies", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("component")))
    return with_hot_apart(found, named, "fp", "copies").drop("copies")


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links, its own included).

    A null or empty text, or one without words, has fingerprint zero and links as any other. Fewer words than a
    shingle: the whole sequence is hashed. Repeated rows give repeated rows. An empty table gives no rows. A null
    doc_id counts as larger than any other. Very long texts are hashed whole. Other columns are not read.
    """
    return _grouped(cut(fingerprints(docs, words)), most).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (null last); the columns of ``docs``.

    Of several rows of that id the one whose text has the smallest digest stays, of equal rows one.
    """
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    marked = docs.withColumns({"_digest": text, "_fp_row": F.xxhash64(*docs.columns)})
    found = cut(fingerprints(docs, SHINGLE_WORDS, text.alias("digest"), F.xxhash64(*docs.columns).alias("whole")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "whole")
    stays = _grouped(found, MAX_BITS).groupBy("component").agg(F.min(first).alias("s")).select("s.doc_id", "s.digest", "s.whole")
    stays = stays.select(F.col("doc_id").alias("_keep"), F.col("digest").alias("_keep_digest"), F.col("whole").alias("_keep_row"))
    kept = marked.join(stays, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_keep_digest")) & (F.col("_fp_row") == F.col("_keep_row")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_digest", "_fp_row"]).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
