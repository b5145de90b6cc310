"""Rasters as cell tables (aoi_id, row, col, values): composites, filters, thresholds, exclusions, sampling.

Every operator keys on aoi_id, so that many areas run as one job. NaN is turned into NULL on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import classify, geo

KEY = ["aoi_id", "row", "col"]


def nan_to_null(cells: DataFrame, *values: str) -> DataFrame:
    return cells.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in values})


def check_unique(cells: DataFrame) -> DataFrame:
    """Cells, failing on a cell that a scene holds twice."""
    n = F.count("*").over(W.partitionBy(*KEY))
    return cells.withColumn("_n", F.assert_true(n == 1, F.lit("a cell occurs twice"))).where(F.col("_n").isNull()).drop("_n")


def same_grid(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Grids (aoi_id, height, width, min_lon, min_lat, max_lon, max_lat) that disagree, with the reason."""
    edges = ["min_lon", "min_lat", "max_lon", "max_lat"]
    both = a.alias("a").join(b.alias("b"), "aoi_id")
    shape = (F.col("a.height") != F.col("b.height")) | (F.col("a.width") != F.col("b.width"))
    moved = F.greatest(*[F.abs(F.col(f"a.{e}") - F.col(f"b.{e}")) for e in edges]) > tolerance
    return both.select("aoi_id", F.when(shape, "shape").when(moved, "bounds").alias("reason")).where("reason IS NOT NULL")


def median_composite(scenes: DataFrame, values: tuple[str, ...] = ("vv", "vh"), keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """Median of each cell over the scenes, nodata ignored, in single precision."""
    return scenes.groupBy(*keys).agg(*[F.median(v).cast("float").alias(v) for v in values])


def array_median(values: Column) -> Column:
    """Median of an array without nulls; null for an empty one."""
    ranked = F.array_sort(values)
    n = F.size(ranked)
    return F.when(n > 0, (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2)


def neighbourhood(cells: DataFrame, what: Column, reach: int, name: str, key: str = "aoi_id") -> DataFrame:
    """cells with an array of `what` over the square of cells up to `reach` away, the cell itself included.

    Two range windows, along rows and then along columns: a cell is sent twice, however large the square,
    and gaps in the grid need no filling. Nulls are left out.
    """
    along_row = W.partitionBy(key, "row").orderBy("col").rangeBetween(-reach, reach)
    along_col = W.partitionBy(key, "col").orderBy("row").rangeBetween(-reach, reach)
    return cells.withColumn("_line", F.collect_list(what).over(along_row)).withColumn(name, F.flatten(F.collect_list("_line").over(along_col))).drop("_line")


def speckle_filter(cells: DataFrame, value: str, window: int = DEFAULT.flood.speckle_filter_size) -> DataFrame:
    """Median of the window around each cell, nodata ignored; a cell without data stays so.

    An even window counts as the next odd one; a window of 1 or less changes nothing.
    """
    if window <= 1:
        return cells
    found = neighbourhood(cells, F.col(value), window // 2, "_near")
    return found.withColumn(value, F.when(F.col(value).isNotNull(), array_median(F.col("_near")).cast("float"))).drop("_near")


def otsu(cells: DataFrame, value: str, key: str = "aoi_id", bins: int = DEFAULT.flood.otsu_histogram_bins, low: float = DEFAULT.flood.otsu_fallback_min_db, high: float = DEFAULT.flood.otsu_fallback_max_db) -> DataFrame:
    """Per area (threshold, method): the histogram split with the largest between-class variance, lowest bin on ties.

    A split outside [low, high] is clamped and called otsu_fallback; fewer than two values, or equal ones,
    give the middle of the range and fallback_no_data. Two aggregations; the rest works on `bins` rows per area.
    """
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    extent = cells.groupBy(key).agg(F.min(v).alias("mn"), F.max(v).alias("mx"), F.count(v).alias("n"))
    usable = (F.col("n") >= 2) & (F.col("mx") > F.col("mn"))
    width = (F.col("mx") - F.col("mn")) / bins
    binned = cells.select(key, v.alias("v")).where("v IS NOT NULL").join(extent.where(usable), key)
    hist = binned.groupBy(key, "mn", "mx", F.least(F.floor((F.col("v") - F.col("mn")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    # Empty bins repeat the split below them and lose the tie, so they need no rows.
    centre = F.col("mn") + (F.col("bin") + 0.5) * width
    upto, all_ = W.partitionBy(key).orderBy("bin"), W.partitionBy(key)
    hist = hist.withColumn("x", centre).withColumn("w0", F.sum("c").over(upto)).withColumn("s0", F.sum(F.col("c") * F.col("x")).over(upto))
    hist = hist.withColumn("w", F.sum("c").over(all_)).withColumn("s", F.sum(F.col("c") * F.col("x")).over(all_))
    w1 = F.col("w") - F.col("w0")
    apart = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    hist = hist.withColumn("between", F.when(w1 > 0, F.col("w0").cast("double") * w1 * apart * apart))
    best = hist.where("between IS NOT NULL").groupBy(key).agg(F.min_by("x", F.struct(-F.round(F.col("between"), 6), "bin")).alias("split"))
    split = F.col("split")
    return extent.select(key).join(best, key, "left").select(
        key,
        F.when(split.isNull(), (low + high) / 2).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), split))).alias("threshold"),
        F.when(split.isNull(), "fallback_no_data").when((split < low) | (split > high), "otsu_fallback").otherwise("otsu").alias("method"),
    )


def exclusion_waterfall(candidates: DataFrame, reasons: dict[str, Column], key: str = "aoi_id") -> DataFrame:
    """Per area and reason, how many candidates it removes when reasons apply in the order given; `kept` for the rest."""
    named = candidates.select(key, F.coalesce(classify.first_reason(reasons), F.lit("kept")).alias("reason"))
    return named.groupBy(key, "reason").agg(F.count("*").alias("n"))


def point_lookup(points: DataFrame, cells: DataFrame, grid: DataFrame, value: str, x: str = "x", y: str = "y", key: str = "aoi_id") -> DataFrame:
    """points with the value of the cell that holds them; null outside the grid or where there is no data.

    grid: one row per area (origin_x, origin_y, px_w, px_h); areas are few, cells are joined on their numbers.
    """
    g = grid.select(key, *[F.col(c).alias(f"_{c}") for c in ("origin_x", "origin_y", "px_w", "px_h")])
    row, col = geo.cell_of(F.col(x), F.col(y), F.col("_origin_x"), F.col("_origin_y"), F.col("_px_w"), F.col("_px_h"))
    at = points.join(g, key, "left").withColumns({"row": row, "col": col}).drop("_origin_x", "_origin_y", "_px_w", "_px_h")
    return at.join(cells.select(key, "row", "col", value), [key, "row", "col"], "left")


def resample_nearest(cells: DataFrame, source: DataFrame, target: DataFrame, value: str, key: str = "aoi_id") -> DataFrame:
    """Cells of the target grid, each with the value of the source cell that holds its centre; null outside.

    Grids: one row per area (origin_x, origin_y, px_w, px_h; height and width for the target).
    """
    rows = target.withColumn("t_row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("t_col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    x, y = geo.centre_of(F.col("t_row"), F.col("t_col"), F.col("origin_x"), F.col("origin_y"), F.col("px_w"), F.col("px_h"))
    found = point_lookup(rows.select(key, "t_row", "t_col", x.alias("x"), y.alias("y")), cells, source, value, key=key)
    return found.select(key, F.col("t_row").alias("row"), F.col("t_col").alias("col"), value)


def area_km2(n: Column, metres_x: Column, metres_y: Column) -> Column:
    """Area of n pixels of the given size, to six decimals."""
    return F.round(n * metres_x * metres_y / 1e6, 6)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """(by, p: array of a double for each share): exact percentiles, interpolated between neighbours; null without values.

    A first pass counts values in bins of equal width, a second one takes only the bins that a percentile lies in, equal
    values as one: no task keeps a group's values, however many they are. NaN and infinite values must be null.
    """
    own = rows.select(*by, F.col(value).cast("double").alias("_v"))
    known = own.where("_v IS NOT NULL")
    extent = known.groupBy(*by).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), F.count("*").alias("_n"))
    width = (F.col("_mx") - F.col("_mn")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_mn")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = known.join(extent, by).withColumn("_bin", place)
    before = lambda w: F.sum("_c").over(w) - F.col("_c")
    hist = placed.groupBy(*by, "_n", "_bin").agg(F.count("*").alias("_c"))
    hist = hist.withColumn("_before", before(W.partitionBy(*by).orderBy("_bin")))
    at = [F.lit(s) * (F.col("_n") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("slot"), f(x).cast("long").alias("rank")) for i, x in enumerate(at) for k, f in enumerate((F.floor, F.ceil))])
    held = lambda c: F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + c))
    needed = hist.where(F.size(held(F.col("_c"))) > 0).select(*by, "_bin", "_before")
    inner = placed.join(needed, [*by, "_bin"]).groupBy(*by, "_n", "_bin", F.col("_before").alias("_start"), "_v").agg(F.count("*").alias("_c"))
    inner = inner.withColumn("_before", F.col("_start") + before(W.partitionBy(*by, "_bin").orderBy("_v")))
    hit = inner.select(*by, "_n", "_v", F.explode(held(F.col("_c"))).alias("_r"))
    found = hit.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r.slot", "_v"))).alias("_at"))

    def between(i: int) -> Column:
        low, high = F.element_at("_at", F.lit(2 * i)), F.element_at("_at", F.lit(2 * i + 1))
        return F.when(F.floor(at[i]) == F.ceil(at[i]), low).otherwise((F.ceil(at[i]) - at[i]) * low + (at[i] - F.floor(at[i])) * high)

    return own.select(*by).distinct().join(found.select(*by, F.array(*[between(i) for i in range(len(shares))]).alias("p")), by, "left")


def band_stats(cells: DataFrame, bands: tuple[str, ...] = ("vv", "vh"), mask: str | None = "mask", key: str = "scene_id", above_db: float = 10.0) -> DataFrame:
    """Quality of each band: shares of nodata and non-finite pixels, percentiles of the valid ones, share above a level."""
    long = cells.select(key, F.explode(F.array(*[F.struct(F.lit(b.upper()).alias("band"), F.col(b).cast("double").alias("v"), (F.col(mask) if mask else F.lit(1)).alias("m")) for b in bands])).alias("x"))
    v, ok = F.col("x.v"), classify.usable(F.col("x.v"), F.col("x.m"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    found = long.groupBy(key, F.col("x.band").alias("band")).agg(
        F.count("*").alias("pixels"),
        (100 * F.count_if(~ok) / F.count("*")).alias("nodata_pct"),
        (100 * F.count_if(~F.coalesce(finite, F.lit(False))) / F.count("*")).alias("nonfinite_pct"),
        F.coalesce(100 * F.try_divide(F.count_if(ok & (v > above_db)), F.count_if(ok)), F.lit(0.0)).alias("above_pct"),
    )
    middle = percentiles(long.select(key, F.col("x.band").alias("band"), F.when(ok, v).alias("v")), [key, "band"], "v", (0.01, 0.5, 0.99))
    found = found.join(middle.withColumnRenamed("p", "_p"), [key, "band"])
    return found.select(key, "band", "pixels", "nodata_pct", "nonfinite_pct", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p1", "p50", "p99"))], "above_pct")


def band_warnings(stats: DataFrame, nodata: float = 5.0, nonfinite: float = 1.0) -> DataFrame:
    """Bands with too many missing pixels, with the reasons in one text."""
    reason = F.concat_ws(
        "; ",
        F.when(F.col("nodata_pct") > nodata, F.format_string(f"%s nodata=%.1f%%>{nodata:.0f}%%", "band", "nodata_pct")),
        F.when(F.col("nonfinite_pct") > nonfinite, F.format_string(f"%s non-finite=%.2f%%>{nonfinite:.0f}%%", "band", "nonfinite_pct")),
    )
    return stats.withColumn("reason", reason).where("reason != ''")


def log_ratio_stats(post: DataFrame, pre: DataFrame, bands: tuple[str, ...] = ("vv", "vh"), mask: str = "mask", key: str = "aoi_id", drop_db: float = -3.0, tolerance_db: float = 1.0) -> DataFrame:
    """Change of each band where both scenes are valid: overlap, percentiles, share of strong drops, floor shares, warning."""
    both = post.alias("b").join(pre.alias("a"), [key, "row", "col"])
    long = both.select(key, F.explode(F.array(*[F.struct(F.lit(b.upper()).alias("band"), F.col(f"b.{b}").cast("double").alias("post"), F.col(f"a.{b}").cast("double").alias("pre"), F.col(f"b.{mask}").alias("mb"), F.col(f"a.{mask}").alias("ma")) for b in bands])).alias("x")).select(key, "x.*")
    ok = classify.usable(F.col("post"), F.col("mb")) & classify.usable(F.col("pre"), F.col("ma"))
    d = F.when(ok, F.col("post") - F.col("pre"))
    share = lambda c: F.try_divide(100 * F.count_if(c), F.count("*"))
    found = long.groupBy(key, "band").agg(
        share(ok).alias("overlap_pct"),
        F.coalesce(100 * F.try_divide(F.count_if(d < drop_db), F.count(d)), F.lit(0.0)).alias("below_drop_pct"),
        share(F.col("post") <= classify.FLOOR_DB).alias("floor_post_pct"), share(F.col("pre") <= classify.FLOOR_DB).alias("floor_pre_pct"),
    )
    middle = percentiles(long.select(key, "band", d.alias("v")), [key, "band"], "v", (0.01, 0.5, 0.99))
    found = found.join(middle.withColumnRenamed("p", "_p"), [key, "band"])
    found = found.select(key, "band", "overlap_pct", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p1", "p50", "p99"))], "below_drop_pct", "floor_post_pct", "floor_pre_pct")
    return found.withColumn("warn", F.coalesce(F.abs("p50") > tolerance_db, F.lit(True)))


def scl_histogram(cells: DataFrame, key: str = "scene_id", scl: str = "scl") -> DataFrame:
    """Per scene all twelve scene classes with their counts, zero included, and total, valid and valid_pct."""
    counted = cells.groupBy(key).agg(*[F.count_if(F.col(scl) == k).alias(f"c{k}") for k in range(12)], F.count(scl).alias("total"), F.count_if(F.col(scl) != 0).alias("valid"))
    classes = F.array(*[F.struct(F.lit(k).alias("scl"), F.col(f"c{k}").alias("n")) for k in range(12)])
    return counted.select(key, "total", "valid", F.round(100 * F.try_divide(F.col("valid"), F.col("total")), 2).alias("valid_pct"), F.inline(classes))


def cloud_cover(cells: DataFrame, key: str = "scene_id", scl: str = "scl") -> DataFrame:
    return cells.groupBy(key).agg(classify.cloud_pct(F.col(scl)).alias("cloud_pct"))
