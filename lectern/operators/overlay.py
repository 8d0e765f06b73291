"""Media overlays: rows, checks of pace and length, overlaps, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import all_punctuation, sentences

# The checker's bounds in seconds, words and characters.
LONG_WORD, LONG, SLOW, EXTRA, MOST_SENTENCES = 3.5, 45.0, 3.5, 4.0, 3
SHORT_WORD, SHORT, FAST_FEW, FAST, CHARS_SLOW, CHARS_SLOW_END, CHARS_FAST = 0.1, 0.3, 0.05, 0.14, 3.0, 0.3, 100.0


def par(df: DataFrame) -> Column:
    """One `par` of an overlay: a text reference and a clip."""
    return F.format_string('<par id="%s-%d"><text src="%s#%s-sentence%d"/><audio src="%s" clipBegin="%.3fs" clipEnd="%.3fs"/></par>', "chapter_id", "unit_id", "href", "chapter_id", "unit_id", "track", "start", "end")


def rows(df: DataFrame) -> DataFrame:
    """Overlay rows of all ranges that last."""
    return df.filter("`end` <> start").withColumn("par", par(df))


def documents(df: DataFrame) -> DataFrame:
    """One overlay document per chapter, its pars in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "par"))), lambda x: x["par"]), "\n")
    head = '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>\n'
    return rows(df).groupBy("chapter_id").agg(F.concat(F.lit(head), body, F.lit("\n</body></smil>")).alias("smil"), F.sum(F.col("end") - F.col("start")).alias("duration"))


def issues(clips: DataFrame) -> DataFrame:
    """Clips (smil, idx, clip_begin, clip_end, text) with `issue` (null if none) and `many_sentences`; the first rule that holds counts."""
    file = Window.partitionBy("smil")
    order = file.orderBy("idx")
    n, d = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")), F.col("clip_end") - F.col("clip_begin")
    c = clips.withColumns({"_n": n, "_d": d, "_edge": F.lag("idx").over(order).isNull() | F.lead("idx").over(order).isNull(), "_last": F.col("clip_end") == F.max("clip_end").over(file)})
    if "boundary" not in c.columns:
        c = c.crossJoin(F.broadcast(clips.agg(F.min("smil").alias("_first"), F.max("smil").alias("_final"))))  # one row
    boundary = F.col("boundary") if "boundary" in clips.columns else (F.col("smil").isin(F.col("_first"), F.col("_final"))) & F.col("_last")
    extra = F.when((F.col("_n") < 3) & F.col("_edge"), EXTRA).otherwise(0.0)
    words, length, chars = F.col("_n"), F.col("_d"), F.length("text")
    issue = (
        F.when(F.trim("text") == "", "empty fragment")
        .when(all_punctuation(F.col("text")), None)
        .when(words == 0, "no words")
        .when((length > F.when(words < 2, LONG_WORD).otherwise(LONG) + extra) & ~boundary, "long duration")
        .when((length / words > SLOW + extra) & ~boundary, "slow pace")
        .when(length < F.when((words < 2) | (chars < 6), SHORT_WORD).otherwise(SHORT), "short duration")
        .when(length / words < F.when(words <= 3, FAST_FEW).otherwise(FAST), "fast pace")
        .when(chars / length < F.when(extra > 0, CHARS_SLOW_END).otherwise(CHARS_SLOW), None)
        .when(chars / length > CHARS_FAST, "fast characters")
    )
    c = c.withColumn("issue", issue).withColumn("many_sentences", F.size(sentences(F.col("text"))) > MOST_SENTENCES)
    return c.drop(*[x for x in c.columns if x.startswith("_")])


def issue_counts(clips: DataFrame) -> DataFrame:
    c = issues(clips)
    each = F.filter(F.array(F.col("issue"), F.when(F.col("many_sentences"), "too many sentences")), lambda x: x.isNotNull())
    return c.select(F.explode(each).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def overlapping(clips: DataFrame) -> DataFrame:
    """Clips that begin before the one before them on their track ends."""
    w = Window.partitionBy("track").orderBy("clip_begin", "idx")
    return clips.withColumn("prev_end", F.lag("clip_end").over(w)).filter("clip_begin < prev_end")
