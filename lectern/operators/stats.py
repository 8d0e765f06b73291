"""Statistics of an alignment: counts, pace, outliers and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.times import per, z_score

# Bounds of the outlier rules, and characters in a length bin.
FAST_Z, SLOW_Z, LONG_Z, SHORT_Z, FASTEST_WORD, SHORTEST, BIN = -3.0, 11.0, 11.0, -1.5, 0.15, 0.15, 12
# What a unit scores, the first that holds.
WEIGHTS = (("fast", 0.0), ("slow", 0.0), ("short", 0.1), ("long", 0.3), ("rebuilt", 0.4), ("interpolated", 0.5), ("recoverable", 0.8), ("skipped", 0.9))
# Kinds of matches, those that succeeded first.
MATCHES = ("exact", "trimmedLeading", "ignoringEndsPunctuation", "ignoringAllPunctuation", "nearest")
MISSES = ("interpolated", "recoverable")


def median_mad(df: DataFrame, by: list[str], x: Column, prefix: str = "") -> DataFrame:
    """Exact median and median absolute deviation of x per group (of all rows without one).

    Equal values are counted before anything else, so each step sees distinct values with their counts: of times in whole milliseconds there are few.
    """
    d = df.groupBy(*by, x.cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    middle = lambda c: F.percentile(c, F.lit(0.5), F.col("_n"))
    m = d.groupBy(*by).agg(middle(F.col("_x")).alias(f"{prefix}median"))
    d = d.join(m, by) if by else d.crossJoin(F.broadcast(m))  # m is one row
    return d.groupBy(*by, f"{prefix}median").agg(middle(F.abs(F.col("_x") - F.col(f"{prefix}median"))).alias(f"{prefix}mad"), F.sum("_n").alias("n"))


def interior(df: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Units but for the first (0) and the last of their chapter."""
    last = F.max("unit_id").over(Window.partitionBy(chapter))
    return df.withColumn("_last", last).filter("unit_id <> 0 and unit_id <> _last").drop("_last")


def binned(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.floor(F.length("text") / BIN).cast("int")).withColumn("pace", per(F.col("duration"), F.length("text")))


def pace_bins(df: DataFrame) -> DataFrame:
    """(bin, median, mad, n) of seconds per character over interior units; bins without deviation are left out."""
    return median_mad(binned(interior(df)), ["bin"], F.col("pace")).filter("mad > 0")


def outliers(df: DataFrame, pace: bool = True, span: bool = True) -> DataFrame:
    """Units with their z-scores of pace (null where the bin has no deviation) and of duration, and the flags fast, slow, short and long that follow.

    The statistics are one row a length bin and one row in all, joined once; the flags are one projection. Without pace or span the flags of the other alone.
    """
    d = binned(df).withColumn("_last", F.max("unit_id").over(Window.partitionBy("chapter_id")))
    inner = (F.col("unit_id") != 0) & (F.col("unit_id") != F.col("_last"))
    d = d.withColumn("_inner", inner).drop("_last")
    sure = lambda c: F.coalesce(c, F.lit(False))
    if pace:
        bins = median_mad(d.filter("_inner"), ["bin"], F.col("pace")).filter("mad > 0").drop("n")
        d = d.join(bins, "bin", "left").withColumn("zscore", F.when(F.col("mad").isNotNull(), z_score(F.col("pace"), F.col("median"), F.col("mad")))).drop("median", "mad")
        quick = F.col("zscore").isNotNull() & ((F.col("zscore") < FAST_Z) | (per(F.col("duration"), F.col("n_words")) < FASTEST_WORD))
        d = d.withColumns({"fast": sure(quick), "slow": sure(F.col("_inner") & (F.col("zscore") > SLOW_Z))})
    if span:
        m = median_mad(d.filter("_inner"), [], F.col("duration")).select("median", "mad")
        d = d.crossJoin(F.broadcast(m))  # one row
        z = z_score(F.col("duration"), F.col("median"), F.col("mad"))
        d = d.withColumns({"zspan": z, "short": sure((F.col("mad") > 0) & ((z < SHORT_Z) | (F.col("duration") < SHORTEST))), "long": sure(F.col("_inner") & (z > LONG_Z))}).drop("median", "mad")
        if pace:
            d = d.withColumns({"short": F.col("short") & ~F.col("fast"), "long": F.col("long") & ~F.col("slow")})
    return d.drop("_inner", "bin", "pace")


def fast(df: DataFrame) -> DataFrame:
    return outliers(df, span=False).filter("fast").select("chapter_id", "unit_id", "zscore")


def slow(df: DataFrame) -> DataFrame:
    return outliers(df, span=False).filter("slow").select("chapter_id", "unit_id", "zscore")


def long(df: DataFrame) -> DataFrame:
    return outliers(df).filter("long").select("chapter_id", "unit_id", F.col("zspan").alias("zscore"))


def short(df: DataFrame) -> DataFrame:
    return outliers(df).filter("short").select("chapter_id", "unit_id", F.col("zspan").alias("zscore"))


def flagged(df: DataFrame) -> DataFrame:
    """Units with their flags, one column each, of all outlier rules."""
    return outliers(df).drop("zscore", "zspan")


def weight(present: list[str]) -> Column:
    out = F.lit(1.0)
    for name, w in reversed(WEIGHTS):
        if name in present:
            out = F.when(F.col(name), w).otherwise(out)
    return out


def chapter_scores(df: DataFrame, chapters: list[str] = ("chapter_id",)) -> DataFrame:
    """(chapter, n, score): 100 times the mean weight of all of its units; flags that are absent do not hold."""
    return df.groupBy(*chapters).agg(F.count(F.lit(1)).alias("n"), (F.sum(weight(df.columns)) * 100 / F.count(F.lit(1))).alias("score"))


def book_score(scores: DataFrame) -> DataFrame:
    """The chapters' scores weighted by their units, to two places; 0 without units."""
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return scores.agg(n.alias("n"), F.coalesce(F.round(F.sum(F.round(F.col("score") * F.col("n") * 10)) / 10 / F.sum("n") * 100) / 100, F.lit(0.0)).alias("score"))


def match_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts per match type, skipped and missing units and words, by group; match_type is null for missing units, `skipped` for skipped ones."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)
    t = F.col("match_type")
    kinds = [n(t == k, k) for k in (*MATCHES, *MISSES, "skipped")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.sum("n_words").cast("long").alias("n_words"), *kinds, n(t.isNull(), "missing"))


def match_rollup(stats: DataFrame) -> DataFrame:
    """The book's counts from the chapters', with what was examined, succeeded and missed and its percentages; null of nothing."""
    s = stats.agg(*[F.sum(c).cast("long").alias(c) for c in ("units", "n_words", *MATCHES, *MISSES, "skipped", "missing")])
    total = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    s = s.withColumns({"succeeded": total(MATCHES), "missed": total((*MISSES, "missing"))}).withColumn("examined", F.col("succeeded") + F.col("missed"))
    return s.withColumn("percent", F.round(F.try_divide(F.col("succeeded") * 10000.0, F.col("examined"))) / 100)


def segment_stats(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments, gaps at either end, fast ones, mean and median seconds a word, mean seconds per voice length."""
    words = F.size(F.split("text", " "))
    pace = (F.col("end") - F.col("start")) / words
    some = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    return segments.withColumn("_p", pace).groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), some(F.col("start_gap") != 0, "start_gaps"), some(F.col("end_gap") != 0, "end_gaps"), some(F.col("_p") < FASTEST_WORD, "fast"), F.round(F.avg("_p"), 6).alias("average_pace"), F.round(F.median("_p"), 6).alias("median_pace"), F.round(F.avg(per(F.col("end") - F.col("start"), F.col("vlen"))), 6).alias("per_voice"))


def weighted_mean(value: Column, weight_: Column) -> Column:
    """Mean by weight over positive weights; 0 without any."""
    w = F.when(weight_ > 0, weight_)
    return F.coalesce(F.sum(value * w) / F.sum(w), F.lit(0.0))


def outlier_report(df: DataFrame, outliers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per chapter its outliers as an array of structs in order; chapters without any are left out."""
    d = outliers.join(df.select("chapter_id", "unit_id", "text", "duration"), ["chapter_id", "unit_id"])
    d = d.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "text", "duration", "zscore"))).alias("sentences"))
    return d.join(names, "chapter_id", "left") if names is not None else d


def merged_transcriptions(stats: DataFrame) -> DataFrame:
    """One row from segment_stats() rows: counts summed, means weighted by segments; medians do not merge."""
    n = F.sum("segments")
    mean = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("segments")), n), 6).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return stats.agg(*[total(c) for c in ("segments", "start_gaps", "end_gaps", "fast")], mean("average_pace"), mean("per_voice"))


def chapter_states(units: DataFrame, aligned: DataFrame, skipped: DataFrame) -> DataFrame:
    """(chapter_id, aligned, skipped, missing, missed, empty): counts; a chapter is missed whose units are all missing, empty with nothing aligned."""
    count = lambda d, name: d.groupBy("chapter_id").agg(F.count(F.lit(1)).alias(name))
    d = units.select("chapter_id").distinct()
    for x, name in ((aligned, "aligned"), (skipped, "skipped"), (missing(units, aligned, skipped), "missing")):
        d = d.join(count(x, name), "chapter_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return d.withColumns({"missed": (F.col("missing") > 0) & (F.col("aligned") == 0) & (F.col("skipped") == 0), "empty": F.col("aligned") == 0})


def missing(units: DataFrame, aligned: DataFrame, skipped: DataFrame) -> DataFrame:
    key = ["chapter_id", "unit_id"]
    return units.join(aligned.select(*key), key, "left_anti").join(skipped.select(*key), key, "left_anti")
