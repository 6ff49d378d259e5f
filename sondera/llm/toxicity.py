"""Toxicity: a subword-bag model with a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, so that a misspelling shares most of its vector with
the word it stands for. A window of consecutive words is the mean of its words; a linear softmax over it gives the
window's log-odds. Labels belong to whole documents and a few words decide them, so a document's log-odds are the soft
maximum over its windows, and the gradient reaches the windows through it: embeddings, softmax and pooling are fitted
together. A logistic curve over the document's pooled log-odds, fitted on a part of the labelled rows that the
embeddings have not seen, turns them into a probability.

Embeddings and softmax are linear, so for scoring they fold into one weight for each n-gram bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import crc_mod, table

ORDERS, BUCKET_BITS, DIMENSIONS, WINDOW = (3, 4, 5, 6), 17, 8, 2
#: Labelled rows that the fit reads, at most: of either label so many, chosen by a hash of their id.
MOST_ROWS_OF_A_LABEL = 3000
EPOCHS, BATCH, RATE, SHARPNESS, DECAY, SEED = 16, 64, 0.2, 1.0, 1e-6, 7
THRESHOLD = 0.7
#: Words scored at a time within a text, and words whose weight a worker remembers.
BLOCK, MEMORY = 1 << 16, 400_000
_WORD = re.compile(r"[^\W_]+(?:[@$*'’-]+[^\W_]+)*")
_MIX = np.uint32(0x9E3779B1)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, number of them for each word) of all n-grams of ``words`` with their borders."""
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(cp))  # characters from here to the word's end
    h, found, owner = np.zeros(len(cp), np.uint32), [], []
    of_word = np.repeat(np.arange(len(words)), lengths)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: max(0, len(cp) - n + 1)] * np.uint32(31) + cp[n - 1 :]) * _MIX + np.uint32(n)
        if n in ORDERS:
            fits = np.flatnonzero(left[: len(h)] >= n)
            found.append((h[fits] * _MIX >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
            owner.append(of_word[fits])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


def bag_means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each run of rows; every run has at least one."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.add.reduceat(values, starts, axis=0) / (counts[:, None] if values.ndim > 1 else counts)


def windows(n: int) -> int:
    return max(1, -(-n // WINDOW))


@dataclass
class Model:
    weight: np.ndarray  # one for each bucket, float32
    bias: float
    slope: float
    offset: float

    def word_weights(self, words: list[str], memory: dict[str, float]) -> np.ndarray:
        new = list({w for w in words if w not in memory})
        if new:
            if len(memory) + len(new) > MEMORY:
                memory.clear()
                new = list(set(words))
            ids, counts = grams(new)
            memory.update(zip(new, bag_means(self.weight[ids], counts).tolist()))
        return np.fromiter(map(memory.__getitem__, words), np.float64, len(words))

    def pooled(self, text: str | None, memory: dict[str, float]) -> float:
        """Soft maximum of the windows' log-odds over a whole text; no words: the bias alone."""
        words = words_of(text or "")
        if not words:
            return self.bias
        sums = []
        for at in range(0, len(words), BLOCK - BLOCK % WINDOW):
            part = self.word_weights(words[at : at + BLOCK - BLOCK % WINDOW], memory)
            starts = np.arange(0, len(part), WINDOW)
            sums.append(np.add.reduceat(part, starts) / np.minimum(WINDOW, len(part) - starts))
        return float(soft_max(np.concatenate(sums) + self.bias))

    def score(self, text: str | None, memory: dict[str, float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.pooled(text, memory) + self.offset, -30, 30))))


def soft_max(z: np.ndarray) -> float:
    """Soft maximum, against a fixed number of windows: a long text isn't diluted by its length."""
    top = z.max()
    return top + np.log(np.exp(SHARPNESS * (z - top)).sum() / min(len(z), WINDOW)) / SHARPNESS


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Train on whole texts; every fifth text is set apart for the logistic curve."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t or "") for t in texts]
    vocabulary: dict[str, int] = {}
    seqs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in d], np.int64) for d in docs]
    if not vocabulary or len(set(labels.tolist())) < 2:
        rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    ids, counts = grams(list(vocabulary))
    starts = np.concatenate(([0], np.cumsum(counts)))
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, DIMENSIONS), -1.0
    g_emb, g_out, g_bias = np.full(1 << BUCKET_BITS, 1e-8), np.full(DIMENSIONS, 1e-8), 1e-8
    usable = np.array([i for i, s in enumerate(seqs) if len(s)])
    apart = usable[usable % 5 == 0]
    train = usable[usable % 5 != 0]
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            picked = train[at : at + BATCH]
            seq = np.concatenate([seqs[i] for i in picked])
            uniq, back = np.unique(seq, return_inverse=True)
            n_grams = counts[uniq]
            first = np.repeat(starts[uniq] - np.concatenate(([0], np.cumsum(n_grams)[:-1])), n_grams)
            g_ids = ids[first + np.arange(n_grams.sum())]
            vec = bag_means(emb[g_ids], n_grams)
            # windows never cross documents
            sizes = np.concatenate([np.append(np.full(len(seqs[i]) // WINDOW, WINDOW), [len(seqs[i]) % WINDOW] if len(seqs[i]) % WINDOW else []) for i in picked]).astype(np.int64)
            per_doc = np.array([windows(len(seqs[i])) for i in picked])
            win = bag_means(vec[back], sizes)
            z = win @ out + bias
            d_start = np.concatenate(([0], np.cumsum(per_doc)[:-1]))
            top = np.maximum.reduceat(z, d_start)
            e = np.exp(SHARPNESS * (z - np.repeat(top, per_doc)))
            total = np.add.reduceat(e, d_start)
            pooled = top + np.log(total / np.minimum(per_doc, WINDOW)) / SHARPNESS
            y = labels[picked]
            p = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
            dz = np.repeat((p - y) / len(picked), per_doc) * e / np.repeat(total, per_doc)
            d_out, d_bias = win.T @ dz, dz.sum()
            d_tok = np.repeat(dz / sizes, sizes)
            d_word = np.bincount(back, d_tok, len(uniq)) / n_grams
            d_gram = np.bincount(g_ids, np.repeat(d_word, n_grams), 1 << BUCKET_BITS)
            has = np.flatnonzero(d_gram)
            step = d_gram[has, None] * out[None, :] + DECAY * emb[has]
            g_emb[has] += (step * step).mean(1)
            emb[has] -= (RATE * step / np.sqrt(g_emb[has])[:, None]).astype(np.float32)
            g_out += d_out * d_out
            out -= RATE * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            bias -= RATE * d_bias / np.sqrt(g_bias)
    model = Model((emb @ out).astype(np.float32), float(bias), 1.0, 0.0)
    memory: dict[str, float] = {}
    curve = apart if len(set(labels[apart].tolist())) == 2 else usable
    model.slope, model.offset = logistic(np.array([model.pooled(" ".join(docs[i]), memory) for i in curve]), labels[curve])
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton's method with a small ridge."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS_OF_A_LABEL) -> Model:
    """Fit on labelled documents: all of a label's rows, or where there are more than ``most``, a seeded choice of ``most``.

    Ids whose label is null, whose labels disagree, or that have no document count as unlabelled.
    """
    spark = docs.sparkSession
    clean = labels.filter("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).filter("y = y2")
    picked, of_all = [], dict(clean.groupBy("y").count().collect())
    for label in (0, 1):
        own = clean.filter(F.col("y") == label).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
        picked += [(r[0], label) for r in own.select("doc_id").collect()]
    if not picked:
        return fit([], np.zeros(0))
    chosen = spark.createDataFrame(picked, "doc_id long, y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    y = rows["y"].to_numpy(np.float64)
    model = fit(rows["text"].tolist(), y)
    if 0 < y.sum() < len(y):  # the choice may hold other shares of the labels than the table
        model.offset += float(np.log(of_all[1] / of_all[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``THRESHOLD`` up). Null, empty and wordless texts get one fixed low score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, float] = {}
        for batch in texts:
            yield pd.Series([shared.value.score(t, memory) for t in batch], dtype="float64")

    scored = docs.withColumn("score", of(text))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    model = train(docs, labels.filter(~held_out))
    return judge(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
