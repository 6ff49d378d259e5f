"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

The operator of ``simhash.py`` in its general form. A set of shingles has a fingerprint of 106 bits: four segments of 21
bits, each a word of the Golay code with two leading zeros, and 22 bits that are only compared. A segment names up to
six codewords near it. Two sets of Jaccard 0.8 differ in 15 % of their bits, some three of a segment; whatever the
errors, one half of the segments has no more than its share of them, so the keys are the codewords of every two
segments. Members of a bucket are candidates where the 64 bits that the key does not come from differ in 15 at most and
the sizes allow the Jaccard; candidates are then verified by their whole sets, so that no link is false.

The keys meet for 87 % of all pairs of Jaccard 0.8, 94 % at 0.85 and 98 % at 0.9 (simulated); what is found of groups
is more, since a group has many links. Of its candidates a bucket gives a spanning forest. Of these each set is verified
with its nearest, and the parts that come of it with each other by their nearest members. Parts that a Jaccard of 0.6
joins are then compared all with all, fingerprints first, in blocks of bounded size, and only links come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm import golay
from sondera.llm.common import cut, with_hot_apart
from sondera.llm.components import components

SHINGLE_WORDS, LEAST_JACCARD, SEED = 5, 0.8, 42
SEGMENTS, SEGMENT_BITS, SPARE_BITS = 4, 21, 22
#: Bits of 64, and of all, in which a candidate may differ: 2.0 and 2.5 standard deviations above the mean at a Jaccard of 0.8.
MOST_BITS, MOST_OF_ALL = 15, 25
#: Sets are related from this Jaccard on; less is a meeting by chance.
RELATED = 0.6
#: A task takes a bucket whole up to so many rows and comparisons. Larger ones are dealt out in pairs of blocks.
MOST_ROWS, MOST_COMPARED, BLOCK_ROWS = 1 << 20, 1 << 30, 1 << 13
#: Sets and bytes of sets in a block, where related sets are compared all with all.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20
#: Buckets of so many rows are compared together with others of their size.
SMALL = 24
#: Rows of one id each that are broadcast at most; more are joined by shuffle.
FEW = 250_000
#: A set goes to the tasks once for every so many of its candidates.
PAIRS_A_PART = 10_000
ROWS = "key long, rest long, id long, size int"


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Fewer words than a shingle: the whole sequence. No words: none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint
    if not parts:
        return np.zeros(0, np.int64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(parts) - words + 1
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)
    return np.unique(hashes.view(np.int64))


def wide_fingerprint(own: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Two unsigned numbers of 64 bits, each bit 1 if it is set in over half of the hashes, or of the hashes mixed again."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(own), block):
        first = own[at : at + block].view(np.uint64)
        second = (first ^ first >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        second = (second ^ second >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        both = np.stack((first, second ^ second >> np.uint64(32)), axis=1)
        counts += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)


def bucket_rows(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, keys, bits left to compare) of the buckets of the given fingerprints, for every two segments."""
    whole = np.uint64((1 << SEGMENT_BITS) - 1)
    segments = [low >> np.uint64(SEGMENT_BITS * i) & whole for i in range(3)] + [high & whole]
    spare = high >> np.uint64(SEGMENT_BITS) & np.uint64((1 << SPARE_BITS) - 1)
    near, counts = zip(*(golay.keys(s) for s in segments))
    for kind, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        k, m = (s for s in range(SEGMENTS) if s not in (i, j))
        rest = (segments[k] | segments[m] << np.uint64(SEGMENT_BITS) | spare << np.uint64(2 * SEGMENT_BITS)).view(np.int64)
        for x in range(6):
            for y in range(6):
                has = np.flatnonzero((counts[i] > x) & (counts[j] > y))
                if len(has):
                    yield has, kind << 24 | near[i][has, x] << 12 | near[j][has, y], rest[has]


def _spread(nodes: DataFrame) -> DataFrame:
    """One row (key, rest, id, size) for each bucket of each of ``nodes`` (set_id, size, low, high)."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                own, size = part["set_id"].to_numpy(), part["size"].to_numpy()
                where, key, rest = map(np.concatenate, zip(*bucket_rows(part["low"].to_numpy().view(np.uint64), part["high"].to_numpy().view(np.uint64))))
                yield pd.DataFrame({"key": key, "rest": rest, "id": own[where], "size": size[where]})

    dealt = nodes.select("set_id", "size", "low", "high").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(spread, ROWS)


def forest(own: np.ndarray, rest: np.ndarray, size: np.ndarray, least: float, most: int = MOST_COMPARED) -> list[tuple[int, int]] | None:
    """A spanning forest of the candidates of a bucket, as positions; None if it takes over ``most`` comparisons.

    The smallest id is the first root, so that the buckets of a group name few different links.
    """
    bits, n, root = rest.view(np.uint64), len(rest), int(np.argmin(own))
    with_root = _near(bits, size, root, least)
    out = [(int(i), root) for i in np.flatnonzero(with_root) if i != root]
    others = np.flatnonzero(~with_root)
    if len(others) * n > most:
        return None
    tree = np.where(with_root, root, np.arange(n))
    for i in others[np.argsort(own[others])]:
        near = np.flatnonzero(_near(bits, size, i, least))
        near = near[np.argsort(own[near])]
        trees, first = np.unique(tree[near], return_index=True)
        for t, at in zip(trees, near[first]):
            if t != tree[i]:
                out.append((int(i), int(at)))
                tree[tree == t] = tree[i]
    return out


def _near(bits: np.ndarray, size: np.ndarray, i: int, least: float) -> np.ndarray:
    return (np.bitwise_count(bits ^ bits[i]) <= MOST_BITS) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9)


def _whole_buckets(batches: Iterator[pd.DataFrame], most_rows: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows come sorted by key: (rows of whole buckets, True), or (some rows of a bucket, False) once it is too large."""
    rest: list[pd.DataFrame] = []  # the last bucket so far, which may go on in the next batch
    large = None
    for batch in batches:
        key = batch["key"].to_numpy()
        if large is not None:
            to = int(np.searchsorted(key, large, side="right"))
            if to:
                yield batch.iloc[:to], False
            batch, key = batch.iloc[to:], key[to:]
        if not len(key):
            continue
        large, last = None, key[-1]
        if rest and rest[0]["key"].iat[0] == last:
            rest.append(batch)
        else:
            open_from = int(np.searchsorted(key, last))
            if rest or open_from:
                yield pd.concat([*rest, batch.iloc[:open_from]]), True
            rest = [batch.iloc[open_from:]]
        if sum(map(len, rest)) > most_rows:
            yield pd.concat(rest), False
            rest, large = [], last
    if rest:
        yield pd.concat(rest), True


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the buckets of sorted keys."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    return starts, np.diff(np.append(starts, len(key)))


def _small_pairs(bits: np.ndarray, size: np.ndarray, starts: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the bucket, row, row): all candidates of the buckets of ``k`` rows that begin at ``starts``."""
    one, other = np.triu_indices(k, 1)
    out = []
    for at in range(0, len(starts), max(1, (1 << 20) // len(one))):
        first = starts[at : at + max(1, (1 << 20) // len(one)), None]
        i, j = first + one, first + other
        near = (np.bitwise_count(bits[i] ^ bits[j]) <= MOST_BITS) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
        out.append((np.broadcast_to(first, i.shape)[near], i[near], j[near]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 3


def _pairs_frame(own: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(own[i], own[j]), "b": np.maximum(own[i], own[j]), "bits": np.bitwise_count(rest.view(np.uint64)[i] ^ rest.view(np.uint64)[j]).astype(np.int32)})


def _forests(keyed: DataFrame, least: float, most_rows: int, most_compared: int) -> DataFrame:
    """(a, b, bits): spanning forests of the buckets of ``keyed``. Members of a bucket that is too large are linked to themselves."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, whole in _whole_buckets(batches, most_rows):
            own = rows["id"].to_numpy()
            if not whole:
                yield pd.DataFrame({"a": own, "b": own, "bits": np.int32(0)})
                continue
            rest, size = rows["rest"].to_numpy(), rows["size"].to_numpy()
            starts, lengths = _buckets(rows["key"].to_numpy())
            singly = [(s, n) for s, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist())]
            for k in range(2, SMALL + 1):
                at, i, j = _small_pairs(rest.view(np.uint64), size, starts[lengths == k], k, least)
                bucket, first, n = np.unique(at, return_index=True, return_counts=True)
                yield _pairs_frame(own, rest, i[first[n == 1]], j[first[n == 1]])
                singly += ((s, k) for s in bucket[n > 1].tolist())
            for s, n in singly:
                found = forest(own[s : s + n], rest[s : s + n], size[s : s + n], least, most_compared)
                if found is None:
                    yield pd.DataFrame({"a": own[s : s + n], "b": own[s : s + n], "bits": np.int32(0)})
                elif found:
                    i, j = np.array(found).T
                    yield _pairs_frame(own[s : s + n], rest[s : s + n], i, j)

    found = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_gathered(compare), "a long, b long, bits int")
    return found.groupBy("a", "b").agg(F.min("bits").alias("bits"))


def _in_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` of the keys of ``counts`` (key, members), each bucket dealt out in pairs of blocks of bounded size.

    Every two rows of a bucket meet in some pair of blocks.
    """
    kept = with_hot_apart(rows, counts, "key", "members").filter("members is not null")
    blocks = F.ceil(F.col("members") / BLOCK_ROWS)
    own = kept.withColumns({"_n": blocks.cast("int"), "_own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pair = F.when(F.col("_n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return each.withColumn("key", pair).drop("_n", "_own", "_other", "members")


def _gathered(compare: Callable, rows: int = 1 << 16) -> Callable:
    """``compare`` with its small frames put together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in compare(batches):
            if len(frame):
                held.append(frame)
            if sum(map(len, held[-64:])) > rows or len(held) > 4096:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    return run


def text_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_id, set_id, size, low, high) of ``docs``: equal sets have one set_id; low and high are the fingerprint."""

    @F.pandas_udf("set_id long, size int, low long, high long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = np.zeros((len(batch), 4), np.int64)
            for i, text in enumerate(batch):
                own = shingles(text, words)
                rows[i, 0] = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)
                rows[i, 1], rows[i, 2:] = len(own), wide_fingerprint(own).view(np.int64)
            yield pd.DataFrame(rows, columns=["set_id", "size", "low", "high"]).astype({"size": "int32"})

    return docs.select("doc_id", _text_id(), of("text").alias("found")).select("doc_id", "text_id", "found.*")


def _text_id() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_id")


def _with_sets(pairs: DataFrame, side: str, sets: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the set of one side as ``name``. A set with many pairs is joined in parts, so that no task gets them all."""
    sizes = cut(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n")))
    parts = F.ceil(F.col("_n") / PAIRS_A_PART).cast("int")
    numbered = with_hot_apart(pairs, sizes, side, "_n").withColumn("_part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("_n")
    dealt = sizes.join(sets, F.col(side) == F.col("set_id")).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return numbered.join(dealt.select(side, "_part", F.col("s").alias(name)), [side, "_part"]).drop("_part")


def _jaccards(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs of sets (set_id, s: the hashes as binary)."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype="float64")

    both = _with_sets(_with_sets(pairs, "a", sets, "left"), "b", sets, "right")
    return both.select("a", "b", of("left", "right").alias("jaccard"))


def links_among(rows: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """Links of a Jaccard of ``least`` that join the sets of ``rows`` (set_id, part, block, low, high, s) as all such pairs would.

    Sets of one ``part`` are joined already. Where there are two blocks, only pairs between them count: those inside one meet elsewhere.
    """
    own, block = rows["set_id"].to_numpy(), rows["block"].to_numpy()
    low, high = (rows[c].to_numpy().view(np.uint64) for c in ("low", "high"))
    high = high & np.uint64((1 << SEGMENT_BITS + SPARE_BITS) - 1)
    sets = [np.frombuffer(s, np.int64) for s in rows["s"]]
    size, apart = np.array([len(x) for x in sets]), len(set(block.tolist())) > 1
    tree, out = np.unique(rows["part"].to_numpy(), return_inverse=True)[1], []
    for i in range(1, len(own)):
        near = (np.bitwise_count(low[:i] ^ low[i]) + np.bitwise_count(high[:i] ^ high[i]) <= MOST_OF_ALL) & (tree[:i] != tree[i])
        near &= np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i]) - 1e-9
        met = np.flatnonzero(near & (block[:i] != block[i]) if apart else near)
        if not len(met):
            continue
        at = np.concatenate(([0], np.cumsum(size[met])[:-1]))
        flat = np.concatenate([sets[j] for j in met])
        both = np.add.reduceat(sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat, at, dtype=np.int64)
        for j in met[both >= least * (size[met] + size[i] - both) - 1e-9]:
            if tree[j] != tree[i]:
                out.append((int(own[j]), int(own[i])))
                tree[tree == tree[j]] = tree[i]
    return out


def _links_of_related(related: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, block_sets: int, block_bytes: int) -> DataFrame:
    """(a, b): links among the sets of each ``tree`` of ``related`` (set_id, part, tree), as all pairs of a tree would give."""
    full = related.join(nodes, "set_id")
    trees = cut(full.groupBy("tree").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("size") * 8).alias("bytes")))
    full = with_hot_apart(full, trees, "tree", "members")
    n = F.ceil(F.greatest(F.col("members") / block_sets, F.col("bytes") / block_bytes)).cast("int")
    dealt = full.withColumns({"n": n, "block": F.pmod(F.xxhash64("set_id"), n).cast("int")})
    dealt = cut(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("tree", "set_id", "part", "block", "low", "high", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_among(rows, least), columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "set_id").groupBy("tree", "x", "y").applyInPandas(compare, "a long, b long")


def _sets_of(nodes: DataFrame, found: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(set_id, s): the hashes of the given sets (set_id), from one text of each."""

    @F.pandas_udf("binary")
    def as_bytes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingles(t, words).tobytes() for t in batch], dtype="object")

    texts = found.join(nodes, "set_id").groupBy("set_id").agg(F.min("text_id").alias("text_id"))
    one = docs.select("text", _text_id()).join(_checked(cut(texts)), "text_id").dropDuplicates(["set_id"])
    return one.select("set_id", as_bytes("text").alias("s"))


def _checked(ids: DataFrame) -> DataFrame:
    """``ids`` for the small side of a join: broadcast where a count shows that they are few, so that no text is shuffled."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def similar_links(
    found: DataFrame, docs: DataFrame, words: int, least: float, most_rows: int = MOST_ROWS, most_compared: int = MOST_COMPARED, block_sets: int = BLOCK_SETS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(a, b): links of verified Jaccard between the sets of ``found``. The limits bound tasks and change no group."""
    nodes = found.groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("size", "low", "high"))).filter("size > 0")
    tried = cut(_forests(_spread(nodes), least, most_rows, most_compared))
    crowded = cut(tried.filter("a = b").select(F.col("a").alias("set_id")))
    if not crowded.isEmpty():
        rows = cut(_spread(nodes.join(crowded, "set_id")))
        counts = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
        tried = cut(tried.filter("a <> b").unionByName(_forests(_in_blocks(rows, counts), least, 1 << 62, 1 << 62)))
    needed = tried.select(F.col("a").alias("set_id")).unionByName(tried.select(F.col("b").alias("set_id"))).distinct()
    sets = cut(_sets_of(needed, found, docs, words))
    close = F.col("jaccard") >= least - 1e-9
    # each set with its nearest candidate
    both = tried.select(F.col("a").alias("u"), F.col("b").alias("v"), "bits").unionByName(tried.select(F.col("b").alias("u"), F.col("a").alias("v"), "bits"))
    nearest = both.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("m")).select(F.least("u", "m.v").alias("a"), F.greatest("u", "m.v").alias("b")).distinct()
    links = cut(_jaccards(nearest, sets)).filter(close).select("a", "b")
    parts = cut(components(links))
    # each two parts with candidates between them, by the nearest
    between = tried
    for side in ("a", "b"):
        between = between.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    between = between.filter("of_a <> of_b").groupBy(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y")).agg(F.min(F.struct("bits", "a", "b")).alias("m"))
    between = cut(between.select("x", "y", "m.a", "m.b"))
    measured = cut(_jaccards(between.select("a", "b"), sets))
    links = links.unionByName(measured.filter(close).select("a", "b"))
    related = between.join(measured.filter(F.col("jaccard") >= RELATED), ["a", "b"])
    trees = cut(components(related.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    if trees.isEmpty():
        return links
    trees = trees.select(F.col("node").alias("part"), F.col("component").alias("tree"))
    members = needed.join(parts, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "set_id").alias("part"))
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("members")).join(trees, "part")
    related = cut(with_hot_apart(members, cut(sizes), "part", "members").filter("tree is not null").select("set_id", "part", "tree"))
    return links.unionByName(cut(_links_of_related(related, nodes, sets, least, block_sets, block_bytes)))


def drop_similar(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = LEAST_JACCARD) -> DataFrame:
    """One document of each group that similar pairs join, the one with the smallest doc_id; the columns of ``docs``.

    A null doc_id counts as larger than any other; of equal ids the smaller text_id (SHA-256) stays. Rows with equal id
    and text are one document. Null and empty texts, and those without words, are one group; a text with fewer words
    than a shingle is like its equals alone. Texts are read whole, however long. An empty table gives no rows. Other
    columns are handed on, whatever their names.
    """
    found = cut(text_sets(docs, words))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    firsts = cut(found.groupBy("set_id").agg(F.min(order).alias("first")))
    reached = components(similar_links(found, docs, words, least))
    placed = firsts.join(reached, F.col("set_id") == F.col("node"), "left")
    stays = placed.groupBy(F.coalesce("component", "set_id").alias("of"), F.col("component").isNull().alias("alone")).agg(F.min("first").alias("first"))
    stays = cut(stays.select(F.col("first.doc_id").alias("_keep"), F.col("first.text_id").alias("_keep_text")))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        gone = cut(found.join(stays, F.col("doc_id") == F.col("_keep"), "left_anti").select(F.col("doc_id").alias("_gone")))
        return docs.join(_checked(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    keyed = docs.withColumn("_text_id", _text_id())
    kept = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_text_id") == F.col("_keep_text")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_id"]).drop("_text_id")
