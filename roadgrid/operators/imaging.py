"""Images: relational grey and Otsu operators, and NumPy kernels for the preprocessing chain."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weights of blue, green and red in grey.
BLUE, GREEN, RED = 0.114, 0.587, 0.299
MIN_HEIGHT = 100
CLIP, TILES = 2.0, 4
PIXELS_A_TASK = 1 << 18


def grey(b: Column, g: Column, r: Column) -> Column:
    """0 to 255, halves up."""
    return F.floor(b * F.lit(BLUE) + g * F.lit(GREEN) + r * F.lit(RED) + 0.5).cast("int")


def otsu_thresholds(pixels: DataFrame, image: str = "image", value: str = "value") -> DataFrame:
    """image, threshold: the first that parts the pixels with the greatest variance between the parts; above it is white.

    Pixels are counted by value before the shuffle; a window then has at most
    256 rows an image. Sums are of integers, so equal variances are found equal.
    """
    bins = pixels.groupBy(image, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("c"))
    run = Window.partitionBy(image).orderBy("v")
    whole = Window.partitionBy(image)
    sums = bins.select(
        image,
        "v",
        F.sum("c").over(run).alias("n0"),
        F.sum(F.col("c") * F.col("v")).over(run).alias("s0"),
        F.sum("c").over(whole).alias("n"),
        F.sum(F.col("c") * F.col("v")).over(whole).alias("s"),
    )
    n1 = F.col("n") - F.col("n0")
    gap = (F.col("s0") * F.col("n") - F.col("s") * F.col("n0")).cast("double")
    between = F.when(n1 > 0, gap * gap / (F.col("n0").cast("double") * n1)).otherwise(F.lit(-1.0))
    best = F.max(F.struct(between.alias("b"), (-F.col("v")).alias("back")))
    return sums.groupBy(image).agg(best.alias("m")).select(image, (-F.col("m.back")).alias("threshold"))


def _dealt(pixels: DataFrame, rows: int) -> DataFrame:
    """pixels, whole images together, in as many partitions as their number of rows asks for: a task's memory doesn't grow with the table."""
    return pixels.repartition(rows // PIXELS_A_TASK + 1, "image")


def _mirrored(at: Column, size: Column) -> Column:
    """The place whose value a place beyond the edge has, by mirroring without the edge itself."""
    turn = F.greatest(2 * (size - 1), F.lit(1))
    back = at % turn
    return F.when(size == 1, F.lit(0)).when(back < size, back).otherwise(turn - back)


def _repeats(at: str, size: str, more: Column) -> Column:
    """All places of the extended side that have the value of the place at, itself included."""
    beyond = F.when(more > 0, F.sequence(F.col(size), F.col(size) + more - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.col(at)), F.filter(beyond, lambda p: _mirrored(p, F.col(size)) == F.col(at)))


def _between(at: str, side: str) -> Column:
    return F.col(at) / F.col(side) - 0.5


def _corners(tiles: int) -> Column:
    """k, tile of the four tiles, top left, top right, low left, low right, between whose levels a pixel lies."""
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), c)).cast("int")
    y, x = F.floor(_between("y", "th")), F.floor(_between("x", "tw"))
    return F.array(*[F.struct(F.lit(k).alias("k"), (inside(y + k // 2) * tiles + inside(x + k % 2)).alias("tile")) for k in range(4)])


def tile_levels(pixels: DataFrame, clip: float = CLIP, tiles: int = TILES) -> DataFrame:
    """image, th, tw (the tiles' sides), y, x, k, level: what each of a pixel's four tiles maps its value to.

    Images are dealt out once and everything else is sorts and windows within
    their partitions: a tile's window holds, by value, the pixels that it counts
    and those that ask for a level. What is above the limit goes to all values
    alike, the rest to values at even distances, and both are known from the
    value alone.
    """
    image = Window.partitionBy("image")
    known = pixels.where("image IS NOT NULL")
    sized = _dealt(known, known.count()).withColumns({"h": F.max("y").over(image) + 1, "w": F.max("x").over(image) + 1})
    n = F.lit(tiles)
    even = (F.col("h") % n == 0) & (F.col("w") % n == 0)
    more = lambda c: F.when(even, F.lit(0)).otherwise(n - F.col(c) % n)
    side = lambda c: F.floor((F.col(c) + more(c)) / n).cast("int")
    sized = sized.withColumns({"th": side("h"), "tw": side("w")})
    whole = lambda p, t: F.floor(p / F.col(t)).cast("int")
    own = F.array(F.struct(F.lit(-1).alias("k"), (whole(F.col("y"), "th") * n + whole(F.col("x"), "tw")).alias("tile")))
    columns = F.transform(_repeats("x", "w", more("w")), lambda p: whole(p, "tw"))
    extended = F.flatten(F.transform(_repeats("y", "h", more("h")), lambda p: F.transform(columns, lambda j: F.struct(F.lit(-1).alias("k"), (whole(p, "th") * n + j).alias("tile")))))
    rows = sized.select("image", "th", "tw", "y", "x", "value", F.inline(F.concat(F.when(even, own).otherwise(extended), _corners(tiles))))
    same = Window.partitionBy("image", "tile", "value").orderBy("k")
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tile = Window.partitionBy("image", "tile")
    limit = F.greatest(F.lit(1), F.floor(F.lit(clip) * F.col("th") * F.col("tw") / 256))
    rows = rows.withColumns({"c": F.count_if(F.col("k") < 0).over(every), "first": F.row_number().over(same) == 1})
    once = lambda v: F.when(F.col("first"), v).otherwise(F.lit(0))
    rows = rows.withColumn("over", F.sum(once(F.greatest(F.col("c") - limit, F.lit(0)))).over(tile))
    rows = rows.withColumn("below", F.sum(once(F.least("c", limit))).over(tile.orderBy("value")))
    share, rest = F.floor(F.col("over") / 256), F.col("over") % 256
    step = F.greatest(F.lit(1), F.floor(256 / F.greatest(rest, F.lit(1))))
    extra = F.least(rest, F.floor(F.col("value") / step) + 1)
    upto = F.col("below") + share * (F.col("value") + 1) + extra
    level = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(upto * (255 / (F.col("th") * F.col("tw"))))))
    return rows.where("k >= 0 AND value IS NOT NULL").select("image", "th", "tw", "y", "x", "k", level.alias("level"))


def equalised(pixels: DataFrame, clip: float = CLIP, tiles: int = TILES) -> DataFrame:
    """image, y, x, value: equalise_tiles() of every image of pixels(image, y, x, value), which has every pixel once."""
    met = tile_levels(pixels, clip, tiles).groupBy("image", "th", "tw", "y", "x")
    four = met.agg(*[F.max(F.when(F.col("k") == k, F.col("level"))).alias(f"m{k}") for k in range(4)])
    y, x = _between("y", "th"), _between("x", "tw")
    fy, fx = y - F.floor(y), x - F.floor(x)
    mixed = lambda a, b: F.col(a) * (1 - fx) + F.col(b) * fx
    value = mixed("m0", "m1") * (1 - fy) + mixed("m2", "m3") * fy
    return four.select("image", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), F.rint(value))).cast("int").alias("value"))


def taps(size: Column, new: Column) -> Column:
    """For each new place, four sources s0 to s3 and their weights w0 to w3; those beyond the edge are the edge."""
    a = -0.75
    near = lambda d: (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = lambda d: a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    exact = F.transform(F.sequence(F.lit(0), new - 1), lambda at: (at + 0.5) * size / new - 0.5)
    based = F.transform(exact, lambda e: F.struct(e.alias("e"), F.floor(e).cast("int").alias("b")))
    apart = F.transform(based, lambda p: F.struct(p["b"].alias("b"), *[F.abs(p["e"] - (p["b"] + (k - 1))).alias(f"d{k}") for k in range(4)]))
    source = lambda p, k: F.greatest(F.lit(0), F.least(size - 1, p["b"] + (k - 1))).alias(f"s{k}")
    weight = lambda p, k: (near if k in (1, 2) else far)(p[f"d{k}"]).alias(f"w{k}")
    return F.transform(apart, lambda p: F.struct(*[f(p, k) for k in range(4) for f in (source, weight)]))


def _values(cells: Column, h: Column, w: Column) -> Column:
    """The values of sorted cells(y, x, value) by y * w + x: sums of those at one place, 0 where there is none."""
    complete = (F.size(cells) == h * w) & F.forall(F.transform(cells, lambda c, i: c["y"] * w + c["x"] == i), lambda ok: ok)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    lines = F.transform(upto(h), lambda y: F.filter(cells, lambda c: c["y"] == y))
    at = lambda line, x: F.aggregate(F.filter(line, lambda c: c["x"] == x), F.lit(0.0), lambda s, c: F.coalesce(s + c["value"], s))
    summed = F.flatten(F.transform(lines, lambda line: F.transform(upto(w), lambda x: at(line, x))))
    return F.when(complete, F.transform(cells, lambda c: c["value"])).otherwise(summed)


def enlarged(pixels: DataFrame, least: int = MIN_HEIGHT) -> DataFrame:
    """image, y, x, value: upscale() of every image of pixels(image, y, x, value), grey values, which has every pixel once.

    Low images become one row each, from which new lines, then their pixels are
    made one by one: nothing larger than the input is grouped or sorted.
    """
    rows, top = pixels.agg(F.count("*"), F.max("y")).first()
    dealt = _dealt(pixels, rows)
    cell = F.struct("y", "x", F.col("value").cast("double").alias("value"))
    whole = dealt.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.sort_array(F.collect_list(F.when(F.col("y") < least, cell))).alias("cells"))
    low = whole.where(F.col("h") < least).withColumn("new_w", F.greatest(F.lit(1), F.floor(F.col("w") * (F.lit(least) / F.col("h")))).cast("int"))
    low = low.select("image", "h", "w", _values(F.col("cells"), F.col("h"), F.col("w")).alias("values"), taps(F.col("w"), F.col("new_w")).alias("across"))
    lines = low.select("image", "w", "values", "across", F.posexplode(taps(F.col("h"), F.lit(least))).alias("y", "down"))
    spots = lines.select("image", "w", "values", "y", "down", F.posexplode("across").alias("x", "over"))
    at = lambda i, j: F.col(f"down.w{i}") * F.get("values", F.col(f"down.s{i}") * F.col("w") + F.col(f"over.s{j}"))
    column = lambda j: F.col(f"over.w{j}") * (at(0, j) + at(1, j) + at(2, j) + at(3, j))
    value = column(0) + column(1) + column(2) + column(3)
    made = spots.select("image", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), F.rint(value))).cast("int").alias("value"))
    if top is None or top < least:
        return made
    sized = dealt.withColumn("h", F.max("y").over(Window.partitionBy("image")) + 1)
    return made.union(sized.where(F.col("h") >= least).select("image", "y", "x", F.col("value").cast("int")))


# --- kernels on arrays of uint8 -------------------------------------------------


def to_grey(image: np.ndarray) -> np.ndarray:
    return np.floor(image @ np.array([BLUE, GREEN, RED]) + 0.5).astype(np.uint8)


def _cubic(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new place, four places and their weights; edges repeat."""
    at = (np.arange(new) + 0.5) * size / new - 0.5
    base = np.floor(at).astype(int)
    d = np.abs(at[:, None] - (base[:, None] + np.arange(-1, 3)))
    a = -0.75
    near = (a + 2) * d**3 - (a + 3) * d**2 + 1
    far = a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
    return np.clip(base[:, None] + np.arange(-1, 3), 0, size - 1), np.where(d <= 1, near, far)


def upscale(image: np.ndarray, least: int = MIN_HEIGHT) -> np.ndarray:
    """Low images are enlarged to the least height, by cubic convolution."""
    h, w = image.shape[:2]
    if h >= least:
        return image
    rows, rw = _cubic(h, least)
    cols, cw = _cubic(w, max(1, int(w * (least / h))))
    x = image.astype(float).reshape(h, w, -1)
    x = np.einsum("ik,ikwc->iwc", rw, x[rows])
    x = np.einsum("jk,hjkc->hjc", cw, x[:, cols])
    return np.clip(np.rint(x), 0, 255).astype(np.uint8).reshape(*x.shape[:2], *image.shape[2:])


def equalise_tiles(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited histogram equalisation by tiles, blended bilinearly.

    Where a side isn't a multiple of the tiles, both are extended, by mirroring
    without the edge itself: each by what it lacks, or by a pixel a tile if it
    lacks nothing. What a tile's histogram has above its limit goes to all
    values alike, and the rest to values at even distances.
    """
    h, w = image.shape
    more = (0, 0) if h % tiles == w % tiles == 0 else (tiles - h % tiles, tiles - w % tiles)
    full = np.pad(image, ((0, more[0]), (0, more[1])), mode="reflect")
    th, tw = full.shape[0] // tiles, full.shape[1] // tiles
    limit = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            bins = np.bincount(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(bins - limit, 0).sum())
            bins = np.minimum(bins, limit) + over // 256
            if rest := over % 256:
                bins[:: max(1, 256 // rest)][:rest] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(bins) * (255 / (th * tw))), 0, 255)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    inside = lambda k: np.clip(k, 0, tiles - 1)
    pick = lambda a, b: maps[inside(a)[:, None], inside(b)[None, :], image]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx
    low = pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    c = np.bincount(image.ravel(), minlength=256).astype(float)
    n0, s0 = np.cumsum(c), np.cumsum(c * np.arange(256))
    n1 = n0[-1] - n0
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where((n0 > 0) & (n1 > 0), (s0 * n0[-1] - s0[-1] * n0) ** 2 / (n0 * n1), -1.0)
    return int(np.argmax(b)) if b.max() >= 0 else int(image.max())


def preprocess(crop: np.ndarray) -> np.ndarray:
    """Enlarged, grey, equalised, black and white; three equal channels."""
    flat = equalise_tiles(to_grey(upscale(crop)))
    black = np.where(flat > otsu(flat), 255, 0).astype(np.uint8)
    return np.repeat(black[:, :, None], 3, axis=2)
