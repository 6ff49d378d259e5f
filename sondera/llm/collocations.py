"""Phrase collocation mining by stripes.

A stripe is the associative counter of the words that follow a prefix: no word, one word or two. The stripe of the
empty prefix counts words, that of one word the two-word phrases that begin with it, and so on, so that one structure
holds the extensions of a prefix, its total (its own count in the stripe of its beginning) and, as maxima over the
stripes of two-word prefixes, what subsumes a phrase.

Tasks count whole texts into stripes, merge equal keys and hand on packages: the part of their stripes whose next words
fall into one bucket. Packages of a bucket meet in one task and are merged elementwise. A stripe of a frequent prefix
thus lies in many buckets, each entry in just one, and a bucket's size hangs on the number of buckets alone, not on any
prefix. Entries below the least count are dropped only after their full sum is known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.llm.byte_words import coded, lowered, words_of
from sondera.llm.common import cut, table

LEAST_COUNT, MOST_WORDS, TOP = 10, 3, 2000
#: A longer candidate that makes up so many hundredths of a phrase's count replaces it.
SUBSUMED_PERCENT = 50
#: Bytes of text that a task counts at once, and that one bucket of stripes stands for.
FLUSH_BYTES, BUCKET_BYTES = 9 << 20, 6 << 20
#: Words numbered at once: three numbers make one 63-bit key.
CHUNK_WORDS = (1 << 21) - 8
#: A language's phrases are ranked in so many parts first.
PARTS = 32
#: Entries a task merges at once.
MERGE_ENTRIES = 1_500_000

_CUTS = np.zeros(256, bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_IN_WORD = ~_CUTS
_IN_WORD[list(b" \t")] = False
_PACKAGE = "bucket int, lang string, n_words int, prefixes binary, sizes binary, nexts binary, counts binary"
_FOUND = "lang string, n_words int, prefix string, next string, f long"


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _stripes(ids: np.ndarray, piece: np.ndarray, first: int, size: int, n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases of ``n_words`` words, as one array of numbers for each word, and their counts, in order of their numbers.

    Only phrases that begin within the first ``first`` words are counted.
    """
    last = min(first, len(ids) - n_words + 1)
    if last <= 0:
        return [np.zeros(0, np.int64)] * n_words, np.zeros(0, np.int64)
    whole = piece[:last] == piece[n_words - 1 : n_words - 1 + last]
    key = np.zeros(int(whole.sum()), np.int64)
    for k in range(n_words):
        key = key * size + ids[k : k + last][whole]
    key, counts = np.unique(key, return_counts=True)
    parts = []
    for _ in range(n_words):
        key, part = np.divmod(key, size)
        parts.append(part)
    return parts[::-1], counts


def _packages(lang: str, texts: list[bytes], buckets: int) -> Iterator[tuple]:
    """The stripes of some texts of one language, by bucket."""
    text = lowered(b"\n".join(texts))
    words, starts = words_of(text, _IN_WORD)
    pieces = np.cumsum(_CUTS[text])[starts]
    for at in range(0, len(words), CHUNK_WORDS):
        ids, names = coded(words.slice(at, CHUNK_WORDS + MOST_WORDS - 1))
        piece = pieces[at : at + CHUNK_WORDS + MOST_WORDS - 1]
        hashes = np.fromiter(map(zlib.crc32, names.to_pylist()), np.uint64, len(names))
        lined = pc.binary_join_element_wise(names, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        for n_words in range(1, MOST_WORDS + 1):
            parts, counts = _stripes(ids, piece, CHUNK_WORDS, len(names), n_words)
            if not len(counts):
                continue
            mark = np.full(len(counts), zlib.crc32(lang.encode()), np.uint64)
            for part in parts:
                mark = mark * np.uint64(0x100000001B3) + hashes[part]
            bucket = _mixed(mark, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket, counts, parts = bucket[order], counts[order].astype(np.int32), [p[order] for p in parts]
            begins = np.ones(len(counts), bool)  # of a stripe
            same = bucket[1:] == bucket[:-1]
            for part in parts[:-1]:
                same &= part[1:] == part[:-1]
            begins[1:] = ~same
            heads = np.flatnonzero(begins)
            sizes = np.diff(heads, append=len(counts)).astype(np.int32)
            nexts = lined.take(pa.array(parts[-1]))
            prefix = _prefixes(names, [p[heads] for p in parts[:-1]], len(heads))
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            of_heads = np.searchsorted(heads, edges)
            for a, b, c, d in zip(edges[:-1], edges[1:], of_heads[:-1], of_heads[1:]):
                yield int(bucket[a]), lang, n_words, _blob(prefix, c, d), sizes[c:d].tobytes(), _blob(nexts, a, b), counts[a:b].tobytes()


def _prefixes(names: pa.Array, parts: list[np.ndarray], n: int) -> pa.Array:
    if not parts:
        return pa.array([b"\n"], pa.large_binary()).take(pa.array(np.zeros(n, np.int64)))
    joined = [names.take(pa.array(p)) for p in parts]
    line = pa.scalar(b"\n", pa.large_binary())
    nothing = pa.scalar(b"", pa.large_binary())
    out = joined[0] if len(joined) == 1 else pc.binary_join_element_wise(*joined, pa.scalar(b" ", pa.large_binary()))
    return pc.binary_join_element_wise(out, nothing, line)


def _blob(lines: pa.LargeBinaryArray, a: int, b: int) -> bytes:
    """Lines a to b as one run of bytes."""
    offsets = np.frombuffer(lines.buffers()[1], np.int64)
    return lines.buffers()[2][int(offsets[a]) : int(offsets[b])].to_pybytes()


_LINE = np.ones(256, bool)
_LINE[10] = False


def _lines(blob: bytes) -> pa.LargeBinaryArray:
    """The lines of a run of bytes, empty ones too."""
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data == 10)
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[_LINE[data]]))])


_CODEC = "zstd"


def _packed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec=_CODEC, asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)


def _count(buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
                if size >= FLUSH_BYTES:
                    yield from _rows(held, buckets)
                    held, size = {}, 0
                    pa.default_memory_pool().release_unused()
        yield from _rows(held, buckets)

    return of


def _rows(held: dict[str, list[bytes]], buckets: int, at_once: int = 512) -> Iterator[pa.RecordBatch]:
    rows = []
    for lang, texts in held.items():
        for bucket, name, n_words, *blobs in _packages(lang, texts, buckets):
            rows.append((bucket, name, n_words, *map(_packed, blobs)))
            if len(rows) == at_once:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _PACKAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


class _Merged:
    """Stripes of one language and length, merged elementwise."""

    def __init__(self):
        self.pending, self.n = [], 0

    def add(self, prefixes: bytes, sizes: bytes, nexts: bytes, counts: bytes) -> None:
        of = np.repeat(np.arange(len(sizes) // 4), np.frombuffer(sizes, np.int32))
        self.pending.append((_lines(prefixes).take(pa.array(of)), _lines(nexts), np.frombuffer(counts, np.int32).astype(np.int64)))
        self.n += len(of)
        if self.n >= MERGE_ENTRIES:
            self.merge()

    def merge(self) -> pa.Table:
        cols = zip(*self.pending)
        rows = pa.table({name: pa.chunked_array([pa.array(x) for x in c]) for name, c in zip(("prefix", "next", "f"), cols)})
        rows = rows.group_by(["prefix", "next"], use_threads=False).aggregate([("f", "sum")]).combine_chunks()
        if rows.num_rows:
            self.pending = [(rows["prefix"].chunk(0), rows["next"].chunk(0), rows["f_sum"].to_numpy())]
        self.n = 0  # of rows that came since
        pa.default_memory_pool().release_unused()
        return rows


def _merge(least: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], _Merged] = {}
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                held.setdefault((row[1], row[2]), _Merged()).add(*map(_unpacked, row[3:]))
        for (lang, n_words), stripes in held.items():
            rows = stripes.merge()
            if n_words == 1:  # all words of the language, rare ones too
                yield _found([lang], [0], [b""], [b""], [int(pc.sum(rows["f_sum"]).as_py())])
            rows = rows.filter(pc.greater_equal(rows["f_sum"], least))
            for part in rows.to_batches(max_chunksize=50_000):
                yield _found([lang] * len(part), [n_words] * len(part), part["prefix"], part["next"], part["f_sum"])

    return of


def _found(lang, n_words, prefix, after, f) -> pa.RecordBatch:
    text = [pa.array(x, pa.large_binary()).cast(pa.binary()).cast(pa.string()) if isinstance(x, list) else x.cast(pa.binary()).cast(pa.string()) for x in (prefix, after)]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n_words, pa.int32()), *text, pa.array(f, pa.int64())], names=["lang", "n_words", "prefix", "next", "f"])


def stripes(docs: DataFrame, least: int = LEAST_COUNT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, n_words, prefix, next, f): the merged stripes of ``docs``, entries of ``least`` or more.

    ``n_words`` counts the words of prefix and next together; n_words 0 has a language's words with all repeats (a row
    for each bucket, to be summed).
    """
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = text.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    counted = text.mapInArrow(_count(buckets), _PACKAGE)
    return counted.repartitionById(buckets, F.col("bucket")).mapInArrow(_merge(least), _FOUND)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of two or three words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two sides of its weakest cut, ``n`` the language's words,
    ``score`` floor(10^6 a a / (l r)), exact in decimals. Phrases that a longer candidate makes up to half or more are
    dropped. A null text counts as empty, a null language as ``und``; texts without words, and an empty table, give no
    rows; repeated rows count each; very long texts are counted in parts that lose no phrase; other columns, whatever
    their names, are not read. Ties of the score go to the larger count, then the lesser phrase by its bytes.
    """
    found = cut(stripes(docs, least, bucket_bytes))
    n = found.filter("n_words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = found.filter("n_words = 1").select("lang", F.col("next").alias("word"), "f")
    pairs = found.filter("n_words = 2").select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("f").alias("a"))
    w1, w2 = F.substring_index("prefix", " ", 1), F.substring_index("prefix", " ", -1)
    triples = found.filter("n_words = 3").select("lang", w1.alias("w1"), F.col("prefix").alias("first2"), F.concat_ws(" ", w2, "next").alias("last2"), F.col("next").alias("w3"), F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("f").alias("a"))

    def counted(rows: DataFrame, key: str, of: DataFrame, by: str, name: str) -> DataFrame:
        side = of.select(F.col("lang").alias("_lang"), F.col(by).alias("_key"), F.col("f" if "f" in of.columns else "a").alias(name))
        return rows.join(side, (F.col("lang") == F.col("_lang")) & (F.col(key) == F.col("_key"))).drop("_lang", "_key")

    two = counted(counted(pairs, "w1", words, "word", "l"), "w2", words, "word", "r")
    longest = triples.select("lang", F.col("first2").alias("phrase"), "a").unionAll(triples.select("lang", F.col("last2").alias("phrase"), "a"))
    longest = longest.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    two = two.join(longest, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longer") < SUBSUMED_PERCENT * F.col("a"), F.lit(True)))
    two = two.select("lang", "phrase", "a", "l", "r", _score("l", "r").alias("score"))
    three = counted(counted(triples, "w1", words, "word", "l1"), "last2", pairs, "phrase", "r1")
    three = counted(counted(three, "first2", pairs, "phrase", "l2"), "w3", words, "word", "r2")
    three = three.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", *(F.when(first, F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(y) for x, y in zip("lrs", ("l", "r", "score"))))
    best, order = two.unionByName(three), (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for by in (["lang", part], ["lang"]):  # the first of each part, then the first of PARTS x top at most
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(l: str, r: str):
    wide = "cast({} as decimal(20, 0))".format
    return F.expr(f"cast(cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')}) div ({wide(l)} * {wide(r)}) as bigint)")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT doc, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
numbered AS (SELECT row_number() OVER () AS piece, lang, regexp_split_to_array(p, '[ \t]+') AS ws FROM pieces),
parts AS (SELECT piece, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM numbered),
words AS (SELECT * FROM parts WHERE w1 <> ''),
runs AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, 1 AS k
    FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.phrase = c.w1 JOIN f1 y ON y.lang = c.lang AND y.phrase = c.w2
    LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
    WHERE c.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * c.f)
    UNION ALL SELECT c.lang, c.phrase, c.f, x.f, y.f, 1
    FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.phrase = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
    UNION ALL SELECT c.lang, c.phrase, c.f, x.f, y.f, 2
    FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.phrase = c.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
