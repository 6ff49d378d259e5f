"""Cropped and edited copies of images by local descriptors.

Corners are found at several scales (Harris response, local maxima). Each gets an orientation from the intensity
centroid around it, and a descriptor of 256 comparisons of two points whose places are turned by that orientation.
Hamming tables: a descriptor goes into several buckets, each named by a different set of its bits, so that a few
flipped bits leave some bucket the same. Bucket mates are candidates. Where that makes many pairs, rounds come first: some
members of each bucket meet all others of it, so that large classes are known. Then all pairs of bucket mates that are
not of one class by then meet, a large bucket in blocks. A candidate pair's descriptors are all compared, and a pair is
linked if enough matches agree on one shift, turn and scale. Linked images form classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import cut, table, with_hot_apart
from sondera.llm.components import components

SCALES, RADIUS, CENTROID, CORNER_SHARE = (1.0, 0.5), 14, 8, 0.02
BITS, TABLES, KEY_BITS, SEED = 256, 6, 60, 11
#: A bucket of more members meets in blocks of about so many, and has so many leaders at most.
CROWD = 256
#: A bucket has one leader in the first round, so that a large class meets it once, and so many times more in each later one.
LEADERS = 16
#: A match differs in so many of the 256 bits at most; a link needs so many matches that agree within so many pixels.
MATCH_BITS, LEAST_AGREE, AGREE_PIXELS, AGREE_TURN = 44, 6, 2.5, 0.3
#: One image's features: a row for each corner. x and y are pixels of the full image.
FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("turn", "<f4"), ("scale", "<f4"), ("bits", "u1", BITS // 8)])


@cache
def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Places of the compared points, and the bits that name a bucket in each table."""
    rng = np.random.default_rng(SEED)
    far, way = (RADIUS - 1) * np.sqrt(rng.random((4 * BITS, 2))), 2 * np.pi * rng.random((4 * BITS, 2))
    at = np.stack([far * np.cos(way), far * np.sin(way)], axis=-1)
    at = at[np.hypot(*(at[:, 0] - at[:, 1]).T) >= RADIUS / 2][:BITS]
    return at, np.stack([rng.permutation(BITS)[:KEY_BITS] for _ in range(TABLES)])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of radius r, edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / n**2


def features(image: np.ndarray) -> np.ndarray:
    """The FEATURE rows of a grey image; none where it is too small or flat."""
    found = [_at_scale(image.astype(np.float64), s) for s in SCALES]
    return np.concatenate(found) if found else np.zeros(0, FEATURE)


def _at_scale(image: np.ndarray, scale: float) -> np.ndarray:
    step = round(1 / scale)
    if step > 1:
        h, w = (n - n % step for n in image.shape)
        image = image[:h, :w].reshape(h // step, step, w // step, step).mean((1, 3))
    margin = RADIUS + 1
    if min(image.shape) <= 2 * margin + 1:
        return np.zeros(0, FEATURE)
    smooth = _box(image, 1)
    gy, gx = np.gradient(smooth)
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    core = corner[margin:-margin, margin:-margin]
    around = np.lib.stride_tricks.sliding_window_view(corner[margin - 2 : -margin + 2, margin - 2 : -margin + 2], (5, 5)).max((2, 3))
    if core.max() <= 1e-9:
        return np.zeros(0, FEATURE)
    y, x = np.nonzero((core == around) & (core >= CORNER_SHARE * core.max()))
    y, x = y + margin, x + margin
    dy, dx = np.mgrid[-CENTROID : CENTROID + 1, -CENTROID : CENTROID + 1]
    inside = np.hypot(dy, dx) <= CENTROID
    patch = smooth[y[:, None] + dy[inside], x[:, None] + dx[inside]]
    patch = patch - patch.mean(1, keepdims=True)
    turn = np.arctan2(patch @ dy[inside], patch @ dx[inside])
    at, _ = _tests()
    cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    px = np.rint(x[:, None, None] + cos * at[..., 0] - sin * at[..., 1]).astype(int)
    py = np.rint(y[:, None, None] + sin * at[..., 0] + cos * at[..., 1]).astype(int)
    wide = _box(smooth, 1)
    seen = wide[np.clip(py, 0, image.shape[0] - 1), np.clip(px, 0, image.shape[1] - 1)]
    out = np.zeros(len(x), FEATURE)
    out["x"], out["y"], out["turn"], out["scale"] = x / scale, y / scale, turn, 1 / scale
    out["bits"] = np.packbits(seen[..., 0] < seen[..., 1], axis=1)
    return out


def bucket_names(found: np.ndarray) -> np.ndarray:
    """(corners, tables): the bucket of each corner in each table, the table in the highest bits."""
    key = np.unpackbits(found["bits"], axis=1)[:, _tests()[1]].astype(np.int64)
    return (key << np.arange(KEY_BITS)).sum(2) | np.arange(TABLES, dtype=np.int64) << np.int64(KEY_BITS)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches of two images' features that agree on one shift, turn and scale."""
    if not len(a) or not len(b):
        return 0
    words_a, words_b = (np.ascontiguousarray(v["bits"]).view("<u8") for v in (a, b))
    apart = np.bitwise_count(words_a[:, None, :] ^ words_b[None, :, :]).sum(2)
    best = apart.argmin(1)
    ok = (apart.min(1) <= MATCH_BITS) & (apart.argmin(0)[best] == np.arange(len(a)))
    if ok.sum() < 2:
        return 0
    p, q = a[ok], b[best[ok]]
    turn = q["turn"].astype(np.float64) - p["turn"]
    grow = q["scale"].astype(np.float64) / p["scale"]
    cos, sin = np.cos(turn) * grow, np.sin(turn) * grow
    sx = q["x"] - (cos * p["x"] - sin * p["y"])
    sy = q["y"] - (sin * p["x"] + cos * p["y"])
    # what each match's transform makes of every other match's place
    x = cos[:, None] * p["x"] - sin[:, None] * p["y"] + sx[:, None]
    y = sin[:, None] * p["x"] + cos[:, None] * p["y"] + sy[:, None]
    same_turn = np.abs(np.angle(np.exp(1j * (turn[:, None] - turn)))) <= AGREE_TURN
    near = (np.hypot(x - q["x"], y - q["y"]) <= AGREE_PIXELS * np.maximum(1, grow[:, None])) & same_turn & (grow[:, None] == grow)
    return int(near.sum(1).max())


def media_features(media: DataFrame) -> DataFrame:
    """(media_id, digest, features) of ``media`` (media_id, height, width, pixels: binary grey rows).

    Null pixels, and pixels that don't fill height x width, have no features.
    """

    @F.pandas_udf("binary")
    def of(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.Series:
        out = []
        for h, w, data in zip(height, width, pixels):
            fits = data is not None and h == h and w == w and h * w == len(data) > 0
            out.append(features(np.frombuffer(data, np.uint8).reshape(int(h), int(w))).tobytes() if fits else b"")
        return pd.Series(out, dtype="object")

    digest = F.sha2(F.concat(F.coalesce("height", F.lit(0)).cast("string").cast("binary"), F.coalesce("pixels", F.lit(b""))), 256)
    return media.select("media_id", digest.alias("digest"), of("height", "width", "pixels").alias("features"))


def bucket_rows(images: DataFrame) -> DataFrame:
    """(bucket, b): the buckets of ``images`` (media_id, features) that hold several images, and these.

    All bucket rows are many and cheap to make: they are made again instead of stored.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for media_id, data in zip(batch["media_id"], batch["features"]):
                yield pd.DataFrame({"bucket": np.unique(bucket_names(np.frombuffer(data, FEATURE))), "b": media_id})

    rows = images.select("media_id", "features").mapInPandas(spread, "bucket long, b long")
    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    return cut(with_hot_apart(rows, sizes, "bucket", "members").filter("members is not null").select("bucket", "b"))


def links(images: DataFrame, leaders: int = 1, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: verified copies among ``images`` (media_id, features; ids differ) that share a bucket.

    Not all links of a class, but enough for its members to be connected: a pair of bucket mates has not met only if
    other links connect it. Rounds of leaders go on while they take fewer pairs than all that are left.
    """
    rows = bucket_rows(images).withColumn("class", F.col("b"))
    found, seats = None, leaders
    while True:
        # a bucket of one class is done
        sizes = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("bucket")
        sizes = sizes.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").cast("long").alias("members"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("apart"))
        several = cut(sizes.filter("classes > 1"))
        members, apart = several.agg(F.sum("members"), F.sum("apart")).first()
        if not members:
            break
        rows = cut(with_hot_apart(rows, several.select("bucket", "members"), "bucket", "members").filter("members is not null"))
        last = seats > crowd or apart <= seats * members
        new = verified(_all_pairs(rows, crowd) if last else _led_pairs(rows, seats), images).select("a", "b")
        found = cut(new if found is None else found.unionByName(new).distinct())
        if last:
            break
        known = components(found).select(F.col("node").alias("b"), F.col("component").alias("class"))
        rows = cut(rows.select("bucket", "b").join(known, "b", "left").select("bucket", "b", F.coalesce("class", "b").alias("class")))
        seats *= LEADERS
    return images.select(F.col("media_id").alias("a"), F.col("media_id").alias("b")).limit(0) if found is None else found


def _led_pairs(rows: DataFrame, seats: int) -> DataFrame:
    """(a, b): so many leaders of each bucket at most, of different classes, with all its members of other classes."""
    seat = F.pmod(F.xxhash64("class", F.lit(seats)), F.lit(seats)).alias("seat")
    leading = rows.groupBy("bucket", seat).agg(F.min(F.struct("b", "class")).alias("lead"), F.count(F.lit(1)).alias("n"))
    leading = cut(leading.groupBy("bucket").agg(F.collect_list("lead").alias("leads"), F.sum("n").alias("members")))
    met = with_hot_apart(rows.drop("members"), leading, "bucket", "members").select("b", "class", F.explode("leads").alias("lead"))
    lead = F.col("lead")
    return met.filter(lead["class"] != F.col("class")).select(F.least(lead["b"], "b").alias("a"), F.greatest(lead["b"], "b").alias("b")).distinct()


def _all_pairs(rows: DataFrame, crowd: int) -> DataFrame:
    """(a, b): all members of each bucket (bucket, b, class, members) that are of different classes.

    Blocks of about ``crowd`` members meet each other, so that no group grows with its bucket.
    """
    blocks = F.ceil(F.col("members") / crowd)
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")))
    left = dealt.select("bucket", F.col("own").alias("low"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("high"), F.col("b").alias("a"), F.col("class").alias("of_a"))
    right = dealt.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("low"), F.col("own").alias("high"), "b", F.col("class").alias("of_b"))
    met = left.join(right, ["bucket", "low", "high"]).filter((F.col("of_a") != F.col("of_b")) & ((F.col("low") < F.col("high")) | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """(a, b, agree): pairs whose features agree on one geometry."""

    @F.pandas_udf("int")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([agreeing(np.frombuffer(x, FEATURE), np.frombuffer(y, FEATURE)) for x, y in zip(left, right)], dtype="int32")

    pairs = cut(pairs)
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    left = sizes.join(images, F.col("a") == F.col("media_id")).select("a", "n", F.col("features").alias("left"))
    both = with_hot_apart(pairs, left, "a", "n").join(images.select(F.col("media_id").alias("b"), F.col("features").alias("right")), "b")
    return both.withColumn("agree", of("left", "right")).filter(F.col("agree") >= LEAST_AGREE).select("a", "b", "agree")


def copies(media: DataFrame) -> DataFrame:
    """One row per image: media_id, class_id (smallest id of its class), n_links, n_corners.

    Images of equal pixels are one node; n_links counts the node's
    verified links to different images, which connect its class but need not be all. Null or broken pixels
    make one class of their own, without corners. Repeated rows give repeated rows. No rows: none. Other columns are
    not read.
    """
    found = cut(media_features(media))
    nodes = cut(found.groupBy("digest").agg(F.min("media_id").alias("media_id"), F.count(F.lit(1)).alias("same"), F.first("features").alias("features")))
    linked = cut(links(nodes.filter(F.octet_length("features") > 0)))
    ends = linked.select(F.col("a").alias("node"), "b").unionByName(linked.select(F.col("b").alias("node"), F.col("a").alias("b")))
    n_links = ends.groupBy("node").agg(F.countDistinct("b").alias("n_links"))
    classed = nodes.join(components(linked), F.col("media_id") == F.col("node"), "left").drop("node").join(n_links, F.col("media_id") == F.col("node"), "left")
    corners = (F.octet_length("features") / FEATURE.itemsize).cast("long")
    named = cut(classed.select("digest", "same", F.coalesce("component", "media_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), corners.alias("n_corners")))
    return with_hot_apart(found.select("media_id", "digest"), named, "digest", "same").select("media_id", "class_id", "n_links", "n_corners")


# The tables hold no images, so the query draws one from each vector, and edited copies of some.

SIDE, CELL = 88, 6
EDITS = ("crop", "light", "noise", "turn")


@cache
def _grid() -> np.ndarray:
    n = -(-SIDE // CELL)
    return np.random.default_rng(5).normal(size=(n * n, 64))


def draw(vector: np.ndarray) -> np.ndarray:
    """A picture of a vector: a mosaic whose cells are mixtures of all its numbers."""
    v = np.zeros(64)
    v[: min(64, len(vector))] = np.nan_to_num(np.asarray(vector, float)[:64])
    cells = _grid() @ (v / (np.linalg.norm(v) or 1.0))
    n = -(-SIDE // CELL)
    image = np.kron(cells.reshape(n, n), np.ones((CELL, CELL)))[:SIDE, :SIDE]
    return np.clip(128 + 45 * image, 0, 255).astype(np.uint8)


def edit(image: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """A cropped, lightened, noisy or turned and cropped copy."""
    rng = np.random.default_rng(seed)
    if kind == "crop":
        y, x = rng.integers(3, 12, 2)
        return image[y:, x:]
    if kind == "light":
        return np.clip(image * 0.8 + 30, 0, 255).astype(np.uint8)
    if kind == "noise":
        return np.clip(image + rng.normal(0, 3, image.shape), 0, 255).astype(np.uint8)
    return np.rot90(image)[:, : SIDE - 6]


def media_of(embeddings: DataFrame) -> DataFrame:
    """(media_id, of_vec, edit, height, width, pixels): an image for each vector (id 2 x vec_id), and for every eighth
    an edited copy (id 2 x vec_id + 1)."""

    def pictures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vec_id, vector in zip(batch["vec_id"], batch["embedding"]):
                image = draw(vector if vector is not None else np.zeros(0))
                rows.append((2 * vec_id, vec_id, "none", *image.shape, image.tobytes()))
                if vec_id % 8 == 5:
                    kind = EDITS[vec_id // 8 % len(EDITS)]
                    copy = np.ascontiguousarray(edit(image, kind, vec_id))
                    rows.append((2 * vec_id + 1, vec_id, kind, *copy.shape, copy.tobytes()))
            yield pd.DataFrame(rows, columns=["media_id", "of_vec", "edit", "height", "width", "pixels"])

    schema = "media_id long, of_vec long, edit string, height int, width int, pixels binary"
    return embeddings.filter("vec_id is not null").select("vec_id", "embedding").mapInPandas(pictures, schema)


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(media_of(table(spark, sf_dir, "embeddings")))
