"""Operators over ordered timelines: rows of one track in order, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import all_punctuation, is_separator


def order_of(track: list[str], order: list[str]):
    return Window.partitionBy(*track).orderBy(*order)


def numbered(df: DataFrame, track: list[str], order: list[str], name: str = "idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(order_of(track, order)) - 1)


def offsets(df: DataFrame, track: list[str], order: list[str], length: Column, start: str = "off_start", end: str = "off_end") -> DataFrame:
    """Half-open character ranges: exclusive running sums of the lengths."""
    before = F.coalesce(F.sum(length).over(order_of(track, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(start, before).withColumn(end, F.col(start) + length)


def with_previous(df: DataFrame, track: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = order_of(track, order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def contiguous(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Each start becomes the end, as it was, of the row before."""
    return df.withColumn("start", F.coalesce(F.lag("end").over(order_of(track, order)), F.col("start")))


def overlaps(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Rows that begin before the one before them ends."""
    return with_previous(df, track, order, ["end"]).filter("start < prev_end")


def backward(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Rows that end before they start, the last of a track left out."""
    last = F.lead("start").over(order_of(track, order)).isNull()
    return df.withColumn("_last", last).filter("not _last and `end` < start").drop("_last")


def repeated_spans(df: DataFrame, track: list[str], order: list[str], n: int = 3) -> DataFrame:
    """Rows with which n equal spans in a row begin; as n rows must follow, a track's final window is not tested."""
    w = order_of(track, order)
    same = [F.lead("start", i).over(w).eqNullSafe(F.col("start")) & F.lead("end", i).over(w).eqNullSafe(F.col("end")) for i in range(1, n)]
    hit = F.lead("start", n).over(w).isNotNull()
    for s in same:
        hit = hit & s
    return df.withColumn("_hit", hit).filter("_hit").drop("_hit")


def islands(df: DataFrame, track: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """Numbers runs; a row for which `begins` holds starts one, and so does a track's first."""
    w = order_of(track, order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_b", F.when(first | F.coalesce(begins, F.lit(False)), 1).otherwise(0)).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_b")


def changes(track: list[str], order: list[str], *columns: str) -> Column:
    w = order_of(track, order)
    out = F.lit(False)
    for c in columns:
        out = out | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return out


def merged(df: DataFrame, by: list[str], order: list[str], flags: list[str] = ()) -> DataFrame:
    """One row per island: tokens joined in order, least start, greatest end, flags or-ed; where there are off_start and off_end their least and greatest, those below 0 aside."""
    token = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "token"))), lambda t: t["token"]), "")
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    offsets = [F.coalesce(f(known(c)), F.lit(-1)).alias(c) for c, f in (("off_start", F.min), ("off_end", F.max)) if c in df.columns]
    return df.groupBy(*by).agg(token.alias("token"), F.min("start").alias("start"), F.max("end").alias("end"), *offsets, *[F.bool_or(c).alias(c) for c in flags], F.count(F.lit(1)).alias("n"))


def words_begin(track: list[str], order: list[str], token: str = "token") -> Column:
    """Whether a recogniser's token begins a word: it is empty, begins with a separator, or follows one that ends with a separator; the commas of a number separate nothing."""
    t, prev = F.col(token), F.lag(token).over(order_of(track, order))
    edge = (t == "") | is_separator(F.left(t, F.lit(1))) | F.coalesce(is_separator(F.right(prev, F.lit(1))), F.lit(False))
    number = lambda c: F.trim(c).rlike(r"^[0-9,]*$")
    comma, after = F.startswith(t, F.lit(",")), F.endswith(prev, F.lit(","))
    inside = (comma != after) & ~prev.rlike(r"\s$") & ~t.rlike(r"^\s") & F.when(comma, number(prev)).otherwise(number(t))
    return edge & ~F.coalesce(inside, F.lit(False))


def word_kind(token: Column) -> Column:
    """What a word may be in its sentence: nothing but blanks and punctuation, its end, its beginning, or other."""
    said = F.trim(token)
    return F.when(all_punctuation(token), "punctuation").when(F.endswith(said, F.lit(".")), "end").when(said.rlike(r"^\p{Lu}"), "begin").otherwise("other")


def tokens_to_words(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Words of a recogniser's tokens (token, start, end), empty ones left out, each with its kind."""
    i = islands(df, track, order, words_begin(track, order))
    return merged(i, [*track, "island"], order).filter("token <> ''").withColumn("kind", word_kind(F.col("token")))


def punctuation_joined(df: DataFrame, track: list[str], order: list[str], segment: str) -> DataFrame:
    """Stamps that are punctuation alone join the one before them in their segment; a segment's first stays."""
    w = order_of(track, order)
    begins = ~all_punctuation(F.col("token")) | ~F.lag(segment).over(w).eqNullSafe(F.col(segment))
    return merged(islands(df, track, order, begins), [*track, "island"], order)


def run_duration(df: DataFrame, track: list[str], order: list[str], run: str) -> DataFrame:
    """Per track the sum over runs of equal `run` of last end less first start."""
    i = islands(df, track, order, changes(track, order, run))
    key = F.struct(*order)
    per = i.groupBy(*track, "island").agg(F.min_by("start", key).alias("first"), F.max_by("end", key).alias("last"))
    return per.groupBy(*track).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("last") - F.col("first")).alias("duration"))


def nearest(df: DataFrame, track: list[str], order: list[str], found: Column, value: str) -> DataFrame:
    """prev_ and next_ value of the nearest rows, other than this, for which `found` holds."""
    w = order_of(track, order)
    v = F.when(found, F.col(value))
    return df.withColumns({f"prev_{value}": F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), f"next_{value}": F.first(v, True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def filled(df: DataFrame, track: list[str], order: list[str], weight: Column, least: int) -> DataFrame:
    """Rows without start and end share the gap between their found neighbours by weight.

    A gap at the head starts at 0; one at the tail, or that is not positive, is `least` long. Adds fill_start and fill_end.
    """
    w = order_of(track, order)
    d = df.withColumn("_w", weight).withColumn("_found", F.col("start").isNotNull())
    d = d.withColumn("_run", F.sum(F.when(F.col("_found"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_from", F.coalesce(F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_to", F.first("start", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    d = d.withColumn("_gap", F.when(F.col("_to").isNull() | (F.col("_to") <= F.col("_from")), F.lit(least)).otherwise(F.col("_to") - F.col("_from")))
    run = Window.partitionBy(*track, "_run", "_found")
    total = F.sum("_w").over(run)
    upto = F.sum("_w").over(run.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda x: F.col("_from") + F.floor(F.col("_gap") * x / total)
    d = d.withColumn("fill_start", F.when(F.col("_found"), F.col("start")).otherwise(at(upto - F.col("_w")))).withColumn("fill_end", F.when(F.col("_found"), F.col("end")).otherwise(at(upto)))
    return d.drop("_w", "_found", "_run", "_from", "_to", "_gap")


def retimed(df: DataFrame, segment: list[str], order: list[str], weight: Column) -> DataFrame:
    """Rows of a segment share its span by weight: adds new_start and new_end."""
    d = df.withColumn("_w", weight)
    part = Window.partitionBy(*segment)
    lo, hi, total = F.min("start").over(part), F.max("end").over(part), F.sum("_w").over(part)
    upto = F.sum("_w").over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda x: lo + F.floor((hi - lo) * x / total)
    return d.withColumns({"new_start": at(upto - F.col("_w")), "new_end": at(upto)}).drop("_w")


def out_of_proportion(df: DataFrame, segment: list[str], order: list[str], weight: Column, off: float, share: float = 0.8, least: int = 5) -> DataFrame:
    """Whether so large a share of a segment's rows, rounded down, lies further than `off` from its share of the span that all are to be retimed."""
    d = retimed(df, segment, order, weight)
    part = Window.partitionBy(*segment)
    bad = F.sum(F.when(F.greatest(F.abs(F.col("start") - F.col("new_start")), F.abs(F.col("end") - F.col("new_end"))) > off, 1).otherwise(0)).over(part)
    n = F.count(F.lit(1)).over(part)
    return d.withColumn("retime", (n >= least) & (bad >= F.floor(n * share)))


def interpolated(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """k rows over [lo, hi]: row i gets lo + (hi - lo) * i / k to the next."""
    i, k = F.row_number().over(order_of(track, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*track))
    lo, hi = F.min("start").over(Window.partitionBy(*track)), F.max("end").over(Window.partitionBy(*track))
    return df.withColumns({"new_start": lo + (hi - lo) * i / k, "new_end": lo + (hi - lo) * (i + 1) / k})


def clamped(df: DataFrame, track: list[str], order: list[str], lo: Column, hi: Column) -> DataFrame:
    """The first row starts and the last one ends where the unit does."""
    w, back = order_of(track, order), Window.partitionBy(*track).orderBy(*[F.desc(c) for c in order])
    return df.withColumns({"start": F.when(F.row_number().over(w) == 1, lo).otherwise(F.col("start")), "end": F.when(F.row_number().over(back) == 1, hi).otherwise(F.col("end"))})


def midpoints(df: DataFrame, track: list[str], order: list[str], at: str) -> DataFrame:
    """Boundaries half-way between neighbouring marks, kept within each row's own span at the ends."""
    w = order_of(track, order)
    return df.withColumns({"start": F.coalesce((F.lag(at).over(w) + F.col(at)) / 2, F.col("start")), "end": F.coalesce((F.lead(at).over(w) + F.col(at)) / 2, F.col("end"))})


def split_gaps(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Half of each gap between neighbours goes to either side, or up to the segment's edge where their `segment_edge` says so."""
    w = order_of(track, order)
    edge = lambda e, n: F.when(F.col("segment_edge").isNotNull() & (F.col("segment_edge") >= e) & (F.col("segment_edge") <= n), F.col("segment_edge")).otherwise((e + n) / 2)
    nxt, prev, prev_edge = F.lead("start").over(w), F.lag("end").over(w), F.lag("segment_edge").over(w)
    before = F.when(prev_edge.isNotNull() & (prev_edge >= prev) & (prev_edge <= F.col("start")), prev_edge).otherwise((prev + F.col("start")) / 2)
    return df.withColumns({"new_start": F.when(prev < F.col("start"), before).otherwise(F.col("start")), "new_end": F.when(nxt > F.col("end"), edge(F.col("end"), nxt)).otherwise(F.col("end"))})


def closed(df: DataFrame, chapters: list[str], order: list[str], track_end: Column) -> DataFrame:
    """Chapter ends meet: a track's first row starts at 0, a chapter's first row where the row before ended, a track's last row ends with the track."""
    w = order_of(["track_id"], order)
    new_chapter = ~F.lag(F.struct(*chapters)).over(w).eqNullSafe(F.struct(*chapters))
    prev, nxt = F.lag("end").over(w), F.lead("start").over(w)
    return df.withColumns({"new_start": F.when(prev.isNull(), F.lit(0)).when(new_chapter, F.least(prev, "start")).otherwise(F.col("start")), "new_end": F.when(nxt.isNull(), track_end).otherwise(F.col("end"))})


def fast_merged(df: DataFrame, track: list[str], order: list[str], least: float) -> DataFrame:
    """Segments (text, start, end) without duration or under `least` seconds a word join both neighbours and are marked for repair.

    Which segments are fast is seen before any is joined, so a segment begins a new one if neither it nor the one before it is fast: islands.
    """
    words, length = F.size(F.split("text", " ")), F.col("end") - F.col("start")
    d = df.withColumn("_fast", (length <= 0) | (length / words < least))
    d = islands(d, track, order, ~F.col("_fast") & ~F.lag("_fast").over(order_of(track, order)))
    key = F.struct(*order)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda t: t["text"]), "")
    first = [F.min(key).getField(c).alias(c) for c in order]
    repair = (F.count(F.lit(1)) > 1) | F.min_by("_fast", key)
    return d.groupBy(*track, "island").agg(*first, text.alias("text"), F.min_by("start", key).alias("start"), F.max("end").alias("end"), repair.alias("needs_repair")).drop("island")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that which comes first."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in df.columns if c not in keys])


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as often as they are missing from the other side, with the side that has them."""
    left, right = (x.exceptAll(y).select(F.lit(side).alias("side"), "*") for x, y, side in ((a, b, "left"), (b, a, "right")))
    return left.unionByName(right)


def asof(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, step: int) -> DataFrame:
    """Points with the half-open interval that holds them: an equi-join on buckets of `step`, then the range test, so that nothing is compared with all."""
    b = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / step))))
    return points.withColumn("_b", F.floor(F.col(at) / step)).join(b, [*on, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def contained(rows: DataFrame, windows: DataFrame, track: str, step: int) -> DataFrame:
    """Rows that lie wholly in a window of the same track, with it; windows are bucketed as in asof()."""
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("w_start") / step), F.floor(F.col("w_end") / step))))
    return rows.withColumn("_b", F.floor(F.col("start") / step)).join(w, [track, "_b"]).filter("start >= w_start and `end` <= w_end").drop("_b")


def selected(df: DataFrame, order: list[str], on: Column, off: Column) -> DataFrame:
    """Rows from one for which `on` holds up to, not with, one for which `off` holds (tested first); all rows where `on` never holds.

    The state changes at rows where either holds and some other held before. These alone come in order, with the state they begin, and each row takes that of the
    last one up to it: rows are dealt by ranges of the order, and the state in which a range begins is that in which the ranges before it end.
    """
    d = df.withColumn("_s", F.when(off, False).when(on, True)).repartitionByRange(*order).withColumn("_r", F.spark_partition_id())
    # Which rows are in which range must not change from one use to the next, so the ranges are cut by the rows that begin them, one a range.
    first = [r.k for r in d.groupBy("_r").agg(F.min(F.struct(*order)).alias("k")).orderBy("k").collect()]
    if not first or not df.filter(on).head(1):
        return df
    k = F.struct(*order)
    cut = F.lit(0)
    for x in first[1:]:
        cut = cut + F.when(k >= F.struct(*[F.lit(x[c]).cast(df.schema[c].dataType).alias(c) for c in order]), 1).otherwise(0)
    d = df.withColumn("_s", F.when(off, False).when(on, True)).withColumn("_r", cut)
    ends = d.filter("_s is not null").groupBy("_r").agg(F.max_by("_s", k).alias("_e"))
    after = ends.select(F.col("_r").alias("_q"), "_e")
    ranges = df.sparkSession.range(len(first)).select(F.col("id").cast("int").alias("_q")).join(after, "_q", "left")
    before = F.last("_e", True).over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    state = F.last("_s", True).over(Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(F.broadcast(ranges.select(F.col("_q").alias("_r"), before.alias("_b"))), "_r")
    return d.withColumn("_on", F.coalesce(state, "_b", F.lit(False))).filter("_on").select(*df.columns)
