"""Times of units from the stamps of a transcript: end stamps, stamps left over, offsets of what is missing, suspicious spans rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.timeline import order_of

# Seconds around a chapter in which stamps are sought, characters of a word that may be added to a match, seconds a word below which an interpolated unit is suspicious.
REACH, EXTRA_WORD, SUSPICIOUS = 60.0, 4, 0.1


def end_stamps(matches: DataFrame, stamps: DataFrame) -> DataFrame:
    """The stamp at which each match ends: (track, unit_id, first_idx, last_idx).

    matches: (track, unit_id, first_idx, match), the text matched from stamp first_idx on; stamps: (track, idx, token, off_start, off_end), offsets in the
    track's text, of which `begins` and `ends` say whether they begin or end a sentence. The end is the last stamp before the first that starts at or beyond the match's last character; the first stamp itself where there
    is none such. One short word more is taken, unless a sentence ends there, if with it the stamps' text is the match. Both sides are brought in order by offset once, so
    no match is compared with all stamps.
    """
    w = order_of(["track"], ["idx"])
    s = stamps.withColumns({"last_off": F.max("off_start").over(Window.partitionBy("track")), "next_token": F.lead("token").over(w), "next_begins": F.lead("begins").over(w)})
    s = s.withColumn("said", F.lower("token"))
    start = s.select("track", F.col("idx").alias("first_idx"), F.col("off_start").alias("from"))
    m = matches.join(start, ["track", "first_idx"]).withColumn("at", F.col("from") + F.length("match") - 1)
    # As-of: stamps and match ends in one order; a match end comes before a stamp at the same offset.
    both = s.select("track", F.col("off_start").alias("o"), F.lit(1).alias("k"), F.struct("idx", "off_start", "last_off", "ends", "next_token", "next_begins").alias("s"), F.lit(None).cast("struct<unit_id:bigint,first_idx:bigint,from:bigint,match:string>").alias("m"))
    both = both.unionByName(m.select("track", F.col("at").alias("o"), F.lit(0).alias("k"), F.lit(None).cast(both.schema["s"].dataType).alias("s"), F.struct(F.col("unit_id").cast("long").alias("unit_id"), F.col("first_idx").cast("long").alias("first_idx"), F.col("from").cast("long").alias("from"), "match").alias("m")))
    seen = F.last("s", True).over(Window.partitionBy("track").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0))
    d = both.withColumn("e", seen).filter("k = 0").select("track", "o", "m.*", "e")
    inside = F.col("e").isNotNull() & (F.col("e.idx") >= F.col("first_idx")) & (F.col("e.last_off") >= F.col("o"))
    d = d.withColumn("last", F.when(inside, F.col("e.idx")).otherwise(F.col("first_idx")))
    # The text from the first stamp to the last, of these few stamps alone.
    spans = d.select("track", "unit_id", F.explode(F.sequence("first_idx", "last")).alias("idx")).join(s.select("track", "idx", "said"), ["track", "idx"])
    text = spans.groupBy("track", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "said"))), lambda x: x["said"]), "").alias("text"))
    d = d.join(text, ["track", "unit_id"])
    match, text = F.trim(F.lower("match")), F.trim("text")
    more = inside & (F.length(F.trim("e.next_token")) <= EXTRA_WORD) & ~F.col("e.ends") & ~F.coalesce(F.col("e.next_begins"), F.lit(False))
    more = more & (text != match) & (F.concat(F.rtrim(F.col("text")), F.lit(" "), F.trim(F.lower("e.next_token"))) == match)
    return d.select("track", "unit_id", "first_idx", F.when(F.coalesce(more, F.lit(False)), F.col("last") + 1).otherwise(F.col("last")).alias("last_idx"))


def unassigned(stamps: DataFrame, units: DataFrame, reach: float = REACH) -> DataFrame:
    """Stamps (track, idx, start, end) that no unit (chapter_id, track, unit_id, first_idx, last_idx, start) holds, each with the chapters that they lie in or within `reach` of."""
    held = units.select("track", F.explode(F.sequence("first_idx", "last_idx")).alias("idx")).distinct()
    near = units.groupBy("chapter_id", "track").agg(F.greatest(F.min("start") - F.lit(reach), F.lit(0)).alias("lo"), (F.max("start") + F.lit(reach)).alias("hi"))
    free = stamps.join(held, ["track", "idx"], "left_anti")
    return free.join(near, "track").filter("start >= lo and `end` <= hi").drop("lo", "hi")


def filled_offsets(units: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Units without offsets get those between their neighbours: the k-th of a run the k-th character after the unit before the run, and the last of it up to the unit behind. Adds fill_start and fill_end."""
    w = order_of(track, order)
    lost = F.col("off_start").isNull()
    before = F.coalesce(F.last("off_end", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    run = F.sum(F.when(lost, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = units.withColumns({"_p": before, "_run": run, "_lost": lost, "_n": F.lead("off_start").over(w)})
    at = F.col("_p") + F.row_number().over(Window.partitionBy(*track, "_run", "_lost").orderBy(*order))
    d = d.withColumn("fill_start", F.when(F.col("_lost"), at).otherwise(F.col("off_start")))
    d = d.withColumn("fill_end", F.when(~F.col("_lost"), F.col("off_end")).when(F.col("_n") > 0, F.col("_n") - 1).otherwise(F.col("fill_start")))
    return d.drop("_p", "_run", "_lost", "_n")


def suspicious(shared: Column, interpolated: Column, start: Column, end: Column, n_words: Column, least: float = SUSPICIOUS) -> Column:
    """Times shared with another unit, or interpolated and too short for the words: under `least` a word, in the unit of start and end. Whole milliseconds are exact, seconds are as near as doubles are."""
    return shared | interpolated & ((end - start) / F.greatest(n_words, F.lit(1)) < least)


def rebuilt(units: DataFrame, track: list[str], order: list[str], vlen: Column) -> DataFrame:
    """Units (start, end, shared, interpolated, suspect) with new_start, new_end and rebuilt.

    Found units are neither shared nor interpolated. Where the gap between two found neighbours holds a suspicious unit, all from the first to the second
    share the time from the first one's start to the second one's end by voice length; gaps in a row that do so share as one. A gap without a found unit at both its ends stays.
    """
    w, upto = order_of(track, order), order_of(track, order).rowsBetween(Window.unboundedPreceding, 0)
    d = units.withColumns({"_found": ~F.col("shared") & ~F.col("interpolated"), "_v": vlen})
    d = d.withColumn("_gap", F.sum(F.when(F.col("_found"), 1).otherwise(0)).over(upto))  # the gap behind the _gap-th found unit
    gaps = d.groupBy(*track, "_gap").agg(F.max(F.col("suspect") & ~F.col("_found")).alias("_bad"))
    ends = d.groupBy(*track).agg(F.max("_gap").alias("_most"))
    gaps = gaps.join(ends, track).withColumn("_bad", F.col("_bad") & (F.col("_gap") > 0) & (F.col("_gap") < F.col("_most"))).drop("_most")
    g = Window.partitionBy(*track).orderBy("_gap")
    gaps = gaps.withColumn("_was", F.coalesce(F.lag("_bad").over(g), F.lit(False)))
    chain = F.sum(F.when(F.col("_bad") & ~F.col("_was"), 1).otherwise(0)).over(g.rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(gaps.withColumn("_chain", chain), [*track, "_gap"])
    # A found unit ends the gap before it too; the last of a chain belongs to it though the gap behind is good.
    d = d.withColumn("rebuilt", F.col("_bad") | F.col("_found") & F.col("_was"))
    part = Window.partitionBy(*track, "_chain", "rebuilt")
    lo, hi, total = F.min("start").over(part), F.max("end").over(part), F.sum("_v").over(part)
    so_far = F.sum("_v").over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda x: lo + F.floor((hi - lo) * x / total)
    d = d.withColumns({"new_start": F.when(F.col("rebuilt"), at(so_far - F.col("_v"))).otherwise(F.col("start")), "new_end": F.when(F.col("rebuilt"), at(so_far)).otherwise(F.col("end"))})
    return d.drop("_found", "_v", "_gap", "_bad", "_was", "_chain")


def respelled(stamps: DataFrame, track: list[str], order: list[str], spelled: Column) -> DataFrame:
    """Stamps with numbers spelled: token, off_start and off_end, each moved by what the tokens before it have grown; offsets below 0 stay -1."""
    grown = F.length("_s") - F.length("token")
    before = F.coalesce(F.sum(grown).over(order_of(track, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("_d")).otherwise(-1).alias(c)
    d = stamps.withColumn("_s", spelled).withColumn("_d", before)
    return d.select(*[F.col("_s").alias("token") if c == "token" else moved(c) if c in ("off_start", "off_end") else F.col(c) for c in stamps.columns])
