"""Ranked lexical search over a K2-treap of the term-document grid.

The documents of a block span a grid of terms (rows, most frequent first) and documents (columns, by id). A cell's
impact is the part of a score that hangs on the document: the term's weight multiplies it. The grid is cut into squares
of rows as high as the block is wide, and each square is a K2-treap: a quadtree whose node holds the greatest impact of
its cell, taken out of the cells below, and a mask of the quarters that still hold some. Nodes are stored level by level,
so that a child is found by counting mask bits, with impacts as differences from the parent and coordinates relative to
the cell, compressed.

A search descends the paths of all the item's rows jointly over ranges of documents. The bound of a range is what its
best document has gathered so far plus, for each row, its weight times the impact of its node there. Ranges are opened
best first, a wave at a time, until no bound reaches the tenth score. A task goes through its blocks with the scores
found so far.

The index is written once to the shared folder; the words that a search needs are looked up in it, and items come in
bounded sets, each against all blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.llm.byte_words import coded, lowered, words_of
from sondera.llm.common import ascii_lower, checkpoint_dir, cut, table

TOP = 10
#: Terms are runs of ASCII letters and digits and of all characters from U+0080 on.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_IN_TERM = np.zeros(256, bool)
_IN_TERM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN_TERM[128:] = True
#: A block ends with the document that fills either.
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 20 << 20
#: Ranges opened at once; (item, term) pairs searched for at once.
WAVE, SET_TERMS = 96, 200_000
_BITS = np.array([bin(x).count("1") for x in range(16)], np.int64)
_BLOCK = "n_docs int, height int, terms binary, dfs binary, doc_ids array<long>, levels binary, masks binary, falls binary, places binary"


def _packed(values: np.ndarray | bytes) -> bytes:
    blob = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of numbers under 2^16, each two places apart."""
    x = x.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & mask
    return x


def _every_other_bit(x: np.ndarray) -> np.ndarray:
    x = x & 0x55555555
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = (x | (x >> shift)) & mask
    return x


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The part of a term's score that its weight multiplies; 64-bit integers, rounded down."""
    m = 10 + (90 * lengths * n_docs) // max(all_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_levels(keys: np.ndarray, values: np.ndarray, height: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level: the cells in order, and the key and value of the greatest point of each.

    ``keys`` are distinct: number of the square, then row and column bits in turn. A point is in just one node.
    """
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    levels = []
    for level in range(height + 1):
        cell = keys >> (2 * (height - level))
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        if not len(starts):
            break
        most = np.repeat(np.maximum.reduceat(values, starts), np.diff(starts, append=len(keys)))
        at = np.flatnonzero(values == most)
        at = at[np.diff(cell[at], prepend=-1) != 0]  # the first such point of each cell
        levels.append((cell[starts], keys[at], values[at]))
        rest = np.ones(len(keys), bool)
        rest[at] = False
        keys, values = keys[rest], values[rest]
    return levels


def _block(ids: list, texts: list[bytes], n_docs: int, all_terms: int) -> tuple:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    words, starts = words_of(lowered(b"\n".join(texts)), _IN_TERM)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lengths = np.diff(np.searchsorted(starts, begins))
    codes, names = coded(words)
    width = len(ids)
    pairs, tf = np.unique(codes * width + np.repeat(np.arange(width), lengths), return_counts=True)
    code, doc = np.divmod(pairs, width)
    dfs = np.bincount(code, minlength=len(names))
    by_df = np.argsort(-dfs, kind="stable")
    row_of = np.empty(len(names), np.int64)
    row_of[by_df] = np.arange(len(names))
    row, value = row_of[code], impacts(tf, lengths[doc], n_docs, all_terms)
    height = max(1, int(width - 1).bit_length())
    side = (1 << height) - 1
    keys = ((row >> height) << (2 * height)) | (_spread_bits(row & side) << 1) | _spread_bits(doc)
    levels = build_levels(keys, value, height)
    masks, falls, places = [], [], []
    for i, (cells, key, val) in enumerate(levels):
        mask = np.zeros(len(cells), np.uint8)
        if i + 1 < len(levels):
            below = levels[i + 1][0]
            np.bitwise_or.at(mask, np.searchsorted(cells, below >> 2), (1 << (below & 3)).astype(np.uint8))
        masks.append(mask)
        above = np.full(len(cells), 1_000_000) if i == 0 else levels[i - 1][2][np.searchsorted(levels[i - 1][0], cells >> 2)]
        falls.append((above - val).astype(np.int32))
        places.append((key & ((1 << (2 * (height - i))) - 1)).astype(np.uint32))
    lined = pc.binary_join_element_wise(names.take(pa.array(by_df)), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    terms = b"".join(lined.to_pylist())
    join = lambda parts, kind: _packed(np.concatenate(parts) if parts else np.zeros(0, kind))
    return (
        width, height, _packed(terms), _packed(dfs[by_df].astype(np.int32)), ids, _packed(np.array([len(m) for m in masks], np.int64)),
        join(masks, np.uint8), join(falls, np.int32), join(places, np.uint32),
    )


def build_index(docs: DataFrame, n_docs: int, all_terms: int) -> DataFrame:
    """One row for each block of documents that hold a term: its terms, their document counts, and its K2-treaps."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def batch(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        row = _block(ids, texts, n_docs, all_terms)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for rows in batches:
            for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].cast(pa.large_binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if len(ids) == BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield batch(ids, texts)
                    ids, texts, size = [], [], 0
        if size:
            yield batch(ids, texts)

    has_term = F.coalesce("text", F.lit("")).rlike(TERM)
    return docs.filter(has_term).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, _BLOCK)


_LINE = np.ones(256, bool)
_LINE[10] = False


def _terms(blob: bytes) -> pa.Array:
    return words_of(np.frombuffer(_unpacked(blob), np.uint8), _LINE)[0]


class Block:
    """A block's K2-treaps, ready to be searched."""

    def __init__(self, row: dict):
        self.doc_ids, self.height = row["doc_ids"], row["height"]
        self.names = _terms(row["terms"])
        self.masks = np.frombuffer(_unpacked(row["masks"]), np.uint8)
        falls, places = np.frombuffer(_unpacked(row["falls"]), np.int32), np.frombuffer(_unpacked(row["places"]), np.uint32).astype(np.int64)
        sizes = np.frombuffer(_unpacked(row["levels"]), np.int64)
        n_children = _BITS[self.masks]
        self.children = int(sizes[0]) + np.cumsum(n_children) - n_children
        self.values = np.empty(len(falls), np.int64)
        self.rows, self.cols = np.empty(len(falls), np.int64), np.empty(len(falls), np.int64)
        at, cells = 0, np.arange(int(sizes[0]))
        for level, n in enumerate(sizes.tolist()):
            own = slice(at, at + n)
            if level:
                above = slice(at - sizes[level - 1], at)
                parent = np.repeat(np.arange(above.start, above.stop), n_children[above])
                self.values[own] = self.values[parent] - falls[own]
                quarter = np.flatnonzero((self.masks[above, None] >> np.arange(4)) & 1) & 3
                cells = (cells[parent - above.start] << 2) | quarter
            else:
                self.values[own] = 1_000_000 - falls[own]
            key = (cells << (2 * (self.height - level))) | places[own]
            inner = key & ((1 << (2 * self.height)) - 1)
            self.rows[own], self.cols[own] = _every_other_bit(inner >> 1), _every_other_bit(inner)
            at += n

    def search(self, rows: np.ndarray, weights: np.ndarray, floor: int = 0, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Scores and columns of the ``top`` best documents, best first; those under ``floor`` may be missing.

        ``rows`` are the item's terms in this block, ``weights`` above zero.
        """
        height, side = self.height, (1 << self.height) - 1
        own = rows & side
        acc = np.zeros(side + 2, np.int64)
        best_score, best_col = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def take_points(nodes: np.ndarray) -> np.ndarray:
            """Add the nodes' own points to the documents they are of; what is left are nodes with something below."""
            of_row = (nodes >= 0) & (self.rows[nodes] == own)
            np.add.at(acc, self.cols[nodes[of_row]], (self.values[nodes] * weights)[of_row])
            return np.where((nodes >= 0) & (self.masks[nodes] > 0), nodes, -1)

        nodes = take_points((rows >> height)[None, :])
        level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([acc.max() + int((np.where(nodes >= 0, self.values[nodes], 0) * weights).sum())])
        while len(bound):
            least = max(floor, int(best_score[-1]) if len(best_score) == top else 1)
            alive = bound >= least
            if not alive.all():
                nodes, level, place, bound = nodes[alive], level[alive], place[alive], bound[alive]
            if not len(bound):
                break
            wave = np.argpartition(-bound, WAVE - 1)[:WAVE] if len(bound) > WAVE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[wave] = False
            n, lv, pl = nodes[wave], level[wave], place[wave]
            half = (own[None, :] >> (height - 1 - lv)[:, None]) & 1
            mask, first = self.masks[n], self.children[n]
            found = []
            for right in (0, 1):
                quarter = 2 * half + right
                has = (n >= 0) & ((mask >> quarter) & 1 > 0)
                child = np.where(has, first + _BITS[mask & ((1 << quarter) - 1)], -1)
                found.append((take_points(child), lv + 1, 2 * pl + right))
            n, lv, pl = (np.concatenate(x) for x in zip(*found))
            span = 1 << (height - lv)
            low = pl * span
            gathered = np.maximum.reduceat(acc, np.column_stack([low, low + span]).ravel())[::2]
            still = (n >= 0).any(axis=1)
            done = ~still & (gathered >= least)
            if done.any():
                sizes = span[done]
                cols = np.repeat(low[done], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                cols = cols[acc[cols] >= least]
                score, col = np.concatenate([best_score, acc[cols]]), np.concatenate([best_col, cols])
                order = np.lexsort((col, -score))[:top]
                best_score, best_col = score[order], col[order]
            n, lv, pl, gathered = n[still], lv[still], pl[still], gathered[still]
            new = gathered + (np.where(n >= 0, self.values[n], 0) * weights).sum(axis=1)
            nodes, level, place, bound = np.concatenate([nodes[rest], n]), np.concatenate([level[rest], lv]), np.concatenate([place[rest], pl]), np.concatenate([bound[rest], new])
        return best_score, best_col


def _item_terms(items: DataFrame, id_col: str) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each row with any; ``item`` numbers the rows."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), 0))
    return cut(items.select(F.col(id_col).alias("item_id"), terms.alias("terms"), F.monotonically_increasing_id().alias("item")).filter(F.size("terms") > 0))


def _document_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of a bounded list of terms is."""
    shared = index.sparkSession.sparkContext.broadcast([t.encode() for t in terms])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.large_binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for blob, dfs in zip(batch["terms"].to_pylist(), batch["dfs"].to_pylist()):
                at = pc.index_in(wanted, _terms(blob)).to_numpy(zero_copy_only=False)
                has = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
                total[has] += np.frombuffer(_unpacked(dfs), np.int32)[at[has].astype(np.int64)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(of, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {terms[r["term"]]: r["df"] for r in rows}


def _search_set(index: DataFrame, items: list, n_docs: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each of a bounded list of items, of each task."""
    terms = sorted({t for row in items for t in row["terms"]})
    df = _document_counts(index, terms)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    weight = {t: w for t, w in weight.items() if w > 0}
    place = {t: i for i, t in enumerate(weight)}
    asked = [(r["item"], r["item_id"], [place[t] for t in r["terms"] if t in place]) for r in items]
    names, weights = [t.encode() for t in place], np.array(list(weight.values()), np.int64)
    shared = index.sparkSession.sparkContext.broadcast((names, weights, asked))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, asked = shared.value
        wanted = pa.array(names, pa.large_binary())
        best: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                rows = pc.index_in(wanted, block.names).fill_null(-1).to_numpy().astype(np.int64)
                for k, (_, _, own) in enumerate(asked):
                    own = np.array([i for i in own if rows[i] >= 0], np.int64)
                    if not len(own):
                        continue
                    held = best.get(k, [])
                    score, col = block.search(rows[own], weights[own], held[-1][0] if len(held) == top else 0, top)
                    if len(score):
                        held = held + [(int(s), block.doc_ids[c]) for s, c in zip(score, col)]
                        best[k] = sorted(held, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        rows = [(asked[k][0], asked[k][1], doc, score) for k, held in best.items() for score, doc in held]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(of, "item long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "item_id", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each row of ``items`` (id_col, text), all of score above 0.

    Equal scores go by ascending doc_id, null last. A null or empty text, or one without terms, is found by nothing and
    finds nothing. Repeated rows of ``docs`` are documents of their own; each row of ``items`` has its own ranks, also
    where ids repeat. Empty tables give no rows. Very long texts are whole, a block of their own at need. Other columns,
    whatever their names, are not read. The result is written before the index is taken away.
    """
    spark = docs.sparkSession
    n_terms = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    n_docs, all_terms = docs.select(n_terms.alias("n")).agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    folder = f"{checkpoint_dir(spark)}/treap-{uuid.uuid4().hex}"
    build_index(docs, n_docs, all_terms).write.parquet(folder)
    index = spark.read.parquet(folder)
    asked = _item_terms(items, id_col)
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    sets = max(1, -(-pairs // SET_TERMS))
    found = None
    for i in range(sets):
        rows = asked.filter(F.pmod("item", F.lit(sets)) == i).collect()  # some SET_TERMS terms
        part = _search_set(index, rows, n_docs, top)
        found = part if found is None else found.unionAll(part)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = cut(found.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return ranked


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS doc, doc_id, translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tokens AS (SELECT doc, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
lengths AS (SELECT doc, count(*) AS n FROM tokens GROUP BY doc),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
tfs AS (SELECT doc, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
    SELECT DISTINCT item_id, term FROM (
        SELECT item_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
scores AS (
    SELECT item_id, doc, doc_id, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN lengths USING (doc) CROSS JOIN whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
