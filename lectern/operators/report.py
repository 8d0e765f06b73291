"""The report on an alignment: its rows, as JSON and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.times import clock, per

# Stages in the order in which they run.
STAGES = ("epub", "audio", "transcribe", "align", "xml", "export", "report")
#: Kinds of outliers in the order in which they are reported, and what each is called.
KINDS = {"rebuilt": "Rebuilt sentences", "fast": "Fast-pace sentences", "slow": "Slow-pace sentences", "short": "Short-duration sentences", "long": "Long-duration sentences"}


def stage_order(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def run_time(stages: DataFrame) -> DataFrame:
    """One row: seconds of all stages (stage, began, ended) but the report."""
    return stages.filter("stage <> 'report'").agg(F.coalesce(F.sum(F.col("ended") - F.col("began")), F.lit(0.0)).alias("runtime"))


def outliers(flags: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(kind, chapter_id, chapter_name, sentences): each chapter's outliers of each kind, in order, with pace and z-score; chapters without any are left out.

    flags: units (chapter_id, unit_id, text, duration, n_words, zscore, zspan) with a column for each kind that there is.
    """
    kinds = [k for k in KINDS if k in flags.columns]
    z = lambda k: {"fast": F.col("zscore"), "slow": F.col("zscore"), "short": F.col("zspan"), "long": F.col("zspan")}.get(k, F.lit(None)).cast("double")
    each = F.filter(F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("kind"), F.round(z(k), 2).alias("zscore"))) for k in kinds]), lambda x: x.isNotNull())
    pace = F.round(per(F.col("duration"), F.col("n_words")), 2)
    d = flags.withColumn("_z", F.col("zscore")).select("chapter_id", "unit_id", "text", F.round("duration", 3).alias("duration"), pace.alias("pace"), F.explode(each).alias("o")).select("*", "o.kind", "o.zscore")
    d = d.groupBy("kind", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "text", "duration", "pace", "zscore"))).alias("sentences"))
    if names is not None:
        d = d.join(names.select("chapter_id", F.col("name").alias("chapter_name")), "chapter_id", "left")
    else:
        d = d.withColumn("chapter_name", F.col("chapter_id").cast("string"))
    return d.select("kind", "chapter_id", "chapter_name", "sentences")


def as_json(d: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object a row, its keys sorted, nulls left out."""
    return d.select(F.to_json(F.struct(*sorted(columns))).alias("value"))


def as_text(found: DataFrame) -> DataFrame:
    """(section, line, value): the lines of an outlier report, to be written in this order, a title and its rule before each kind, a name and its rule before each chapter."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    title = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    rule = lambda c, mark: F.repeat(F.lit(mark), F.length(c))
    said = F.transform("sentences", lambda s: F.concat(F.lit("    sentence #"), s["unit_id"].cast("string"), F.lit(" -- pace: "), s["pace"].cast("string"), F.lit(" -- duration: "), s["duration"].cast("string"), F.when(s["zscore"].isNotNull(), F.concat(F.lit(" -- modzscore: "), s["zscore"].cast("string"))).otherwise(""), F.lit(" -- "), s["text"]))
    first = F.row_number().over(Window.partitionBy("kind").orderBy("chapter_id")) == 1
    d = found.withColumns({"_t": title, "_first": first})
    lines = F.concat(F.when(F.col("_first"), F.array(F.col("_t"), rule(F.col("_t"), "-"))).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("    "), "chapter_name"), F.concat(F.lit("    "), rule(F.col("chapter_name"), "-"))), said, F.array(F.lit("")))
    d = d.withColumn("section", F.array_position(kinds, F.col("kind")).cast("int"))
    return d.select("section", "chapter_id", F.posexplode(lines).alias("line", "value"))


def head(title: Column, runtime: Column, score: Column) -> Column:
    """The report's first lines: what made it, how long it took, and the score."""
    rule = F.repeat(F.lit("="), F.length(title))
    return F.concat_ws("\n", rule, F.concat(F.lit("Build:    "), title), F.concat(F.lit("Run time: "), clock(runtime, False)), F.concat(F.lit("Score:    "), score.cast("string")), rule)
