"""Every query by name, with its SQL where SQL can express it.

Inputs stand in for what an aligner has: `documents` are chapters whose sentences are units with synthetic times, `conversations`
are segments of tracks, `events` a timeline with gaps and overlaps, `pages` XHTML, `benchmark` passages to be found. Times are whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import times as tm
from lectern.operators import align, folds, overlay, similarity, stats, timeline, words
from lectern.sources import book

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def synthetic(df: DataFrame, track: str, idx: str) -> DataFrame:
    """Adds vlen (hundredths), dur, start and end in ms: voice length at 80 ms, varied by position, every 97th far too fast, every 89th far too slow, every 83rd at half its length."""
    t, i = F.col(track), F.col(idx)
    d = df.withColumn("vlen", tx.voice_length100(F.col("text")))
    rate = F.when((t * 7 + i) % 97 == 0, 2).when((t * 5 + i) % 89 == 0, 4000).when((t * 3 + i) % 83 == 0, 50).otherwise(100)
    d = d.withColumn("dur", F.floor(F.col("vlen") * 8 * (70 + ((t * 31 + i * 17) % 13) * 5) * rate / 100000).cast("long"))
    w = Window.partitionBy(track).orderBy(idx)
    d = d.withColumn("end", F.sum("dur").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("start", F.col("end") - F.col("dur"))


def units(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("unit_id", "text"))
    return synthetic(u, "doc_id", "unit_id")


def segments(spark: SparkSession, d: str) -> DataFrame:
    return synthetic(read(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.coalesce("text", F.lit("")).alias("text")), "conv_id", "turn")


def events(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select(F.col("user_id").alias("track"), "event_id", F.col("event_type").alias("token"), at.alias("start"), (at + F.floor(F.coalesce("value", F.lit(0.0)) * 60).cast("long")).alias("end"))


def paced(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select(F.col("doc_id").alias("chapter_id"), "unit_id", "text", F.size(F.split("text", " ")).alias("n_words"), (F.col("dur") / 1000).alias("duration"))


def segment_words(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("conv_id", "turn", "start", "end", F.posexplode(tx.tokens(F.col("text"))).alias("word_idx", "token"))
    return timeline.retimed(s, ["conv_id", "turn"], ["word_idx"], F.length("token")).drop("start", "end").withColumnsRenamed({"new_start": "start", "new_end": "end"})


VLEN = "(100*length(text) - 99*(length(text)-length(regexp_replace(text,' ','','g'))) + 100*(length(text)-length(regexp_replace(text,',','','g'))) + 200*(length(text)-length(regexp_replace(text,'[.!?0-9]','','g'))))::bigint"
SPLIT = "string_split(regexp_replace(trim(text),'([.!?]+)[ \n\t\r]+','\\1'||chr(1),'g'),chr(1))"


def timed(src: str, t: str, i: str) -> str:
    return f"""v as (select *, {VLEN} vlen from {src}), w as (select *, floor(vlen*8*(70+(({t}*31+{i}*17)%13)*5)*(case when ({t}*7+{i})%97=0 then 2 when ({t}*5+{i})%89=0 then 4000 when ({t}*3+{i})%83=0 then 50 else 100 end)/100000.0)::bigint dur from v),
{{}} as (select *, (sum(dur) over (partition by {t} order by {i} rows unbounded preceding))::bigint as "end", (sum(dur) over (partition by {t} order by {i} rows unbounded preceding) - dur)::bigint as start from w)"""


U = f"with r as (select doc_id, generate_subscripts(p,1)-1 unit_id, unnest(p) as text from (select doc_id, {SPLIT} p from documents)), " + timed("r", "doc_id", "unit_id").format("u")
S = "with r as (select conv_id, turn::int turn, coalesce(text,'') as text from conversations), " + timed("r", "conv_id", "turn").format("s")
E = "with e as (select user_id track, event_id, event_type token, floor(epoch(ts))::bigint start, (floor(epoch(ts)) + floor(coalesce(value,0)*60))::bigint as \"end\" from events)"
P = U + ", p as (select doc_id chapter_id, unit_id, text, len(string_split(text,' ')) n_words, dur/1000.0::double duration from u)"
SW = S + r""", t as (select conv_id, turn, start, "end", list_filter(regexp_split_to_array(lower(text),'[ \t\n\r]+'), lambda x: x<>'') ws from s), ww as (select conv_id, turn, start s0, "end" e0, generate_subscripts(ws,1)-1 word_idx, unnest(ws) token from t),
x as (select *, sum(length(token)) over (partition by conv_id,turn order by word_idx rows unbounded preceding) upto, sum(length(token)) over (partition by conv_id,turn) total from ww),
sw as (select conv_id, turn, word_idx, token, (s0+floor((e0-s0)*(upto-length(token))/total))::bigint start, (s0+floor((e0-s0)*upto/total))::bigint as "end" from x)"""
SPOKEN = r"regexp_replace(text, '[\s\p{P}$+<=>^`|~]', '', 'g')"


@query(U + " select doc_id, unit_id::int unit_id, text from u")
def unit_rows(spark, d):
    return units(spark, d).select("doc_id", "unit_id", "text")


@query(U + r""" select doc_id, unit_id::int unit_id, greatest(len(list_filter(regexp_extract_all(text, '[^ \t\n\r—,;!?|]*[ \t\n\r—,;!?|]+|[^ \t\n\r—,;!?|]+'), lambda x: not regexp_matches(x, '^[\s\p{P}]*$'))), case when length(text)>0 then 1 else 0 end)::int n_words from u""")
def word_counts(spark, d):
    return units(spark, d).select("doc_id", "unit_id", tx.count_words(F.col("text")).alias("n_words"))


@query(U + " select count(*) n, max(length(text))::int longest, avg(length(text))::int mean, round(median(length(text)),3) median from u")
def unit_length_stats(spark, d):
    n = F.length("text")
    return units(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest"), F.round(F.avg(n)).cast("int").alias("mean"), F.round(F.median(n), 3).alias("median"))


@query(U + " select doc_id, unit_id::int unit_id, vlen from u")
def voice_length(spark, d):
    return units(spark, d).select("doc_id", "unit_id", "vlen")


@query(U + r""" select doc_id, unit_id::int unit_id, trim(regexp_replace(regexp_replace(replace(translate(text,'‘’‚‛“”„‟«»〝〞‐‑‒–―‹›',repeat('''',4)||repeat('"',8)||repeat('-',4)||'—<>'),'--','—'),'\p{P}','','g'),'[ \t\n\r]+',' ','g')) plain from u""")
def punct_normalized(spark, d):
    return units(spark, d).select("doc_id", "unit_id", tx.collapsed(tx.without_punctuation(tx.plain_punctuation(F.col("text")))).alias("plain"))


@query(S + r""" select conv_id, turn, regexp_replace(lower(text), '\b(i|you|he|she|it|we|they)''(ll|re|ve|d|m)\b', '\1', 'g') stem from s""")
def contraction_stems(spark, d):
    return segments(spark, d).select("conv_id", "turn", tx.contraction_stems(F.lower("text")).alias("stem"))


@query("""with v as (select doc_id, ['','I','II','III','IV','V','VI','VII','VIII','IX'] o, ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'] t, ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'] h, 10 + doc_id%990 as value from documents),
w as (select doc_id, h[value//100+1]||t[value//10%10+1]||o[value%10+1] roman, value from v) select doc_id, roman, case when length(roman)>1 then value end::int as value from w""")
def roman_values(spark, d):
    n = F.lit(10) + F.col("doc_id") % 990
    digit = lambda names, x: F.element_at(F.array(*[F.lit(s) for s in names]), (x + 1).cast("int"))
    roman = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    r = F.concat(digit(roman("C", "D", "M"), F.floor(n / 100)), digit(roman("X", "L", "C"), F.floor(n / 10) % 10), digit(roman("I", "V", "X"), n % 10))
    return read(spark, d, "documents").select("doc_id", r.alias("roman")).withColumn("value", tx.roman_value(F.col("roman")))


@query(U + rf""" select doc_id, unit_id::int unit_id, length({SPOKEN})=0 blank, length({SPOKEN})<=3 short, regexp_matches(text,'^[\s\p{{P}}]*$') punctuation from u""")
def blank_or_short_units(spark, d):
    said = F.length(F.regexp_replace("text", r"[\s\p{P}$+<=>^`|~]", ""))
    return units(spark, d).select("doc_id", "unit_id", tx.unspoken(F.col("text")).alias("blank"), (said <= align.TOO_SHORT).alias("short"), tx.all_punctuation(F.col("text")).alias("punctuation"))


@query(U + """, c as (select doc_id, unit_id, (start//10)::bigint cs from u) select doc_id, unit_id::int unit_id, printf('%02d:%02d:%02d.%02d', cs//360000, cs//6000%60, cs//100%60, cs%100) clock, cs//100*1.0::double "seconds" from c""")
def clock_format(spark, d):
    s = F.col("start") / 1000
    u = units(spark, d).select("doc_id", "unit_id", tm.clock(s).alias("clock"), tm.clock(s, False).alias("whole"))
    return u.select("doc_id", "unit_id", "clock", tm.seconds_of(F.concat("whole", F.lit("s"))).alias("seconds"))


@query(U + """ select doc_id, unit_id::int unit_id, (row_number() over (partition by doc_id order by unit_id)-1)::int idx, (sum(length(text)) over (partition by doc_id order by unit_id rows unbounded preceding)-length(text))::bigint off_start, (sum(length(text)) over (partition by doc_id order by unit_id rows unbounded preceding))::bigint off_end from u""")
def char_offsets(spark, d):
    u = timeline.numbered(units(spark, d), ["doc_id"], ["unit_id"])
    return timeline.offsets(u, ["doc_id"], ["unit_id"], F.length("text").cast("long")).select("doc_id", "unit_id", "idx", "off_start", "off_end")


@query(S + """, q as (select *, (("end"-start)/1000.0::double)/len(string_split(text,' ')) pace from s) select conv_id, count(*) segments, count(*) filter (turn%3<>0) start_gaps, count(*) filter (turn%4<>0) end_gaps, count(*) filter (pace<0.15) fast, round(avg(pace),6) average_pace, round(median(pace),6) median_pace, round(avg(case when vlen>0 then (("end"-start)/1000.0::double)/vlen else 0 end),6) per_voice from q group by 1""")
def segment_pace(spark, d):
    s = segments(spark, d).withColumns({"start_gap": F.col("turn") % 3, "end_gap": F.col("turn") % 4})
    return stats.segment_stats(s.withColumns({"start": F.lit(0.0), "end": (F.col("end") - F.col("start")) / 1000}), ["conv_id"])


BINS = P + """, i as (select *, (length(text)//12)::int bin, case when length(text)>0 then duration/length(text) else 0.0 end pace, max(unit_id) over (partition by chapter_id) last from p),
b as (select bin, median(pace) median, mad(pace) mad, count(*) n from i where unit_id<>0 and unit_id<>last group by 1 having mad(pace)>0),
z as (select i.*, median, mad, (pace-median)*0.6745/mad zscore from i left join b using (bin)),
fast as (select chapter_id, unit_id, zscore from z where mad is not null and (zscore < -3.0 or duration/n_words < 0.15)),
slow as (select chapter_id, unit_id, zscore from z where zscore > 11.0 and unit_id<>0 and unit_id<>last),
g as (select median(duration) m, mad(duration) md from i where unit_id<>0 and unit_id<>last),
y as (select i.*, case when md>0 then (duration-m)*0.6745/md else 0.0 end zd, md from i, g),
long_ as (select chapter_id, unit_id, zd zscore from y where zd > 11.0 and unit_id<>0 and unit_id<>last and (chapter_id,unit_id) not in (select chapter_id,unit_id from slow)),
short as (select chapter_id, unit_id, zd zscore from y where md>0 and (zd < -1.5 or duration < 0.15) and (chapter_id,unit_id) not in (select chapter_id,unit_id from fast))"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(BINS + " select bin, round(median,6) median, round(mad,6) mad, n from b")
def pace_bins(spark, d):
    return rounded(stats.pace_bins(paced(spark, d)), "median", "mad")


@query(BINS + " select chapter_id, unit_id::int unit_id, round(zscore,6) zscore from fast")
def fast_pace(spark, d):
    return rounded(stats.fast(paced(spark, d)), "zscore")


@query(BINS + " select chapter_id, unit_id::int unit_id, round(zscore,6) zscore from slow")
def slow_pace(spark, d):
    return rounded(stats.slow(paced(spark, d)), "zscore")


@query(BINS + " select chapter_id, unit_id::int unit_id, round(zscore,6) zscore from long_")
def long_duration(spark, d):
    return rounded(stats.long(paced(spark, d)), "zscore")


@query(BINS.replace("dur/1000.0::double duration", "round(cbrt(dur/1000.0::double),3) duration") + " select chapter_id, unit_id::int unit_id, round(zscore,6) zscore from short")
def short_duration(spark, d):
    """Of durations that vary less than the units' own, which none falls short of."""
    u = paced(spark, d)
    return rounded(stats.short(u.withColumn("duration", F.round(F.cbrt("duration"), 3))), "zscore")


SCORED = BINS + """, sc as (select i.chapter_id, count(*) n, sum(case when (i.chapter_id,i.unit_id) in (select chapter_id,unit_id from fast) then 0 when (i.chapter_id,i.unit_id) in (select chapter_id,unit_id from slow) then 0
 when (i.chapter_id,i.unit_id) in (select chapter_id,unit_id from short) then 0.1 when (i.chapter_id,i.unit_id) in (select chapter_id,unit_id from long_) then 0.3 else 1 end::double)*100/count(*) score from i group by 1)"""


@query(SCORED + " select chapter_id, n, round(score,6) score from sc")
def chapter_scores(spark, d):
    return rounded(stats.chapter_scores(stats.flagged(paced(spark, d))), "score")


@query(SCORED + " select sum(n)::bigint n, round(sum(round(score*n*10))/10/sum(n)*100)/100 score from sc")
def book_score(spark, d):
    return stats.book_score(stats.chapter_scores(stats.flagged(paced(spark, d))))


KINDS = ["exact", "trimmedLeading", "ignoringEndsPunctuation", "ignoringAllPunctuation", "nearest", "interpolated", "recoverable", "skipped"]
KIND_SQL = ", k as (select doc_id, unit_id, len(string_split(text,' ')) n_words, [" + ",".join(f"'{k}'" for k in KINDS) + "][(doc_id*13+unit_id*7)%9+1] match_type from u)"


def with_kinds(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), ((F.col("doc_id") * 13 + F.col("unit_id") * 7) % 9).cast("int"))
    return units(spark, d).select("doc_id", "unit_id", F.size(F.split("text", " ")).alias("n_words"), kind.alias("match_type"))


MATCH = "count(*) units, sum(n_words)::bigint n_words, " + ", ".join(f"(count(*) filter (match_type='{k}'))::bigint \"{k}\"" for k in KINDS) + ", (count(*) filter (match_type is null))::bigint missing"


@query(U + KIND_SQL + f" select doc_id, {MATCH} from k group by 1")
def match_stats(spark, d):
    return stats.match_stats(with_kinds(spark, d), ["doc_id"])


@query(U + KIND_SQL + f", a as (select {MATCH} from k), b as (select *, (exact+\"trimmedLeading\"+\"ignoringEndsPunctuation\"+\"ignoringAllPunctuation\"+nearest)::bigint succeeded, (interpolated+recoverable+missing)::bigint missed from a) select *, (succeeded+missed)::bigint examined, round(succeeded*10000.0/(succeeded+missed))/100 \"percent\" from b")
def match_rollup(spark, d):
    return stats.match_rollup(stats.match_stats(with_kinds(spark, d), ["doc_id"]))


EW = "partition by track order by start, event_id"


@query(E + f""", o as (select *, lag("end") over ({EW}) prev_end from e) select track, event_id, start, "end", prev_end from o where start < prev_end""")
def overlaps(spark, d):
    return timeline.overlaps(events(spark, d), ["track"], ["start", "event_id"]).select("track", "event_id", "start", "end", "prev_end")


@query(E + f""", o as (select track, event_id, start//3600 start, "end"//3600 as "end" from e), l as (select *, lead(start,1) over (partition by track order by start, event_id) a, lead("end",1) over (partition by track order by start, event_id) b, lead(start,2) over (partition by track order by start, event_id) c, lead("end",2) over (partition by track order by start, event_id) f, lead(start,3) over (partition by track order by start, event_id) g from o)
select track, event_id from l where a=start and b="end" and c=start and f="end" and g is not null""")
def duplicate_spans(spark, d):
    hours = events(spark, d).withColumns({"start": F.floor(F.col("start") / 3600), "end": F.floor(F.col("end") / 3600)})
    return timeline.repeated_spans(hours, ["track"], ["start", "event_id"]).select("track", "event_id")


@query(E + f""", o as (select *, lead(start) over ({EW}) nxt, start + 600 - ("end"-start) as e2 from e) select track, event_id from o where nxt is not null and e2 < start""")
def backward_spans(spark, d):
    e = events(spark, d).withColumn("end", F.col("start") + 600 - (F.col("end") - F.col("start")))
    return timeline.backward(e, ["track"], ["start", "event_id"]).select("track", "event_id")


@query(E + f""" select track, event_id, coalesce(lag("end") over ({EW}), start) start, "end" from e""")
def contiguous_spans(spark, d):
    return timeline.contiguous(events(spark, d), ["track"], ["start", "event_id"]).select("track", "event_id", "start", "end")


RUNS = E + f""", c as (select *, case when lag(token) over ({EW}) is distinct from token or row_number() over ({EW})=1 then 1 else 0 end b from e), r as (select *, sum(b) over ({EW} rows unbounded preceding) run from c),
x as (select track, run, string_agg(token, '' order by start, event_id) token, min(start) start, max("end") as "end", count(*) n, arg_min(start, (start,event_id)) f, arg_max("end", (start,event_id)) l from r group by 1,2)"""


@query(RUNS + " select track, count(*) runs, sum(l-f)::bigint duration from x group by 1")
def run_durations(spark, d):
    return timeline.run_duration(events(spark, d), ["track"], ["start", "event_id"], "token")


@query(RUNS + " select track, (run-1)::bigint island, token, start, \"end\", n from x")
def islands_merge(spark, d):
    e, order = events(spark, d), ["start", "event_id"]
    i = timeline.islands(e, ["track"], order, timeline.changes(["track"], order, "token"))
    return timeline.merged(i.withColumnRenamed("start", "s").withColumn("start", F.col("s")), ["track", "island"], ["s", "event_id"])


@query(SW + " select conv_id, turn, word_idx::int word_idx, token, start, \"end\" from sw")
def proportional_retime(spark, d):
    return segment_words(spark, d).select("conv_id", "turn", "word_idx", "token", "start", "end")


@query(S + """, n as (select conv_id, turn, row_number() over (partition by conv_id order by turn)-1 i, count(*) over (partition by conv_id) k, min(start) over (partition by conv_id) lo, max("end") over (partition by conv_id) hi from s) select conv_id, turn, round(lo+(hi-lo)*i/k::double,3) new_start, round(lo+(hi-lo)*(i+1)/k::double,3) new_end from n""")
def interpolated_spans(spark, d):
    s = timeline.interpolated(segments(spark, d), ["conv_id"], ["turn"])
    return s.select("conv_id", "turn", F.round("new_start", 3).alias("new_start"), F.round("new_end", 3).alias("new_end"))


@query(U + """, h as (select doc_id, unit_id, vlen w, case when unit_id%5<>2 then start end s, case when unit_id%5<>2 then "end" end f from u),
g as (select *, s is not null found, sum(case when s is not null then 1 else 0 end) over (partition by doc_id order by unit_id rows unbounded preceding) run, coalesce(last_value(f ignore nulls) over (partition by doc_id order by unit_id rows between unbounded preceding and 1 preceding),0) a, first_value(s ignore nulls) over (partition by doc_id order by unit_id rows between 1 following and unbounded following) b from h),
q as (select *, case when b is null or b<=a then 250 else b-a end gap, sum(w) over (partition by doc_id,run,found) total, sum(w) over (partition by doc_id,run,found order by unit_id rows unbounded preceding) upto from g)
select doc_id, unit_id::int unit_id, case when found then s else (a+floor(gap*(upto-w)/total::double))::bigint end fill_start, case when found then f else (a+floor(gap*upto/total::double))::bigint end fill_end from q""")
def gap_fill(spark, d):
    gone = F.col("unit_id") % 5 == 2
    u = units(spark, d).withColumns({"start": F.when(~gone, F.col("start")), "end": F.when(~gone, F.col("end"))})
    return timeline.filled(u, ["doc_id"], ["unit_id"], F.col("vlen"), 250).select("doc_id", "unit_id", "fill_start", "fill_end")


@query(U + """, f as (select *, case when (doc_id+unit_id)%4=0 then start end s from u) select doc_id, unit_id::int unit_id, last_value(s ignore nulls) over (partition by doc_id order by unit_id rows between unbounded preceding and 1 preceding) prev_start, first_value(s ignore nulls) over (partition by doc_id order by unit_id rows between 1 following and unbounded following) next_start from f""")
def nearest_found(spark, d):
    return timeline.nearest(units(spark, d), ["doc_id"], ["unit_id"], (F.col("doc_id") + F.col("unit_id")) % 4 == 0, "start").select("doc_id", "unit_id", "prev_start", "next_start")


@query(U + """, o as (select doc_id, unit_id, sum(length(text)) over (partition by doc_id order by unit_id rows unbounded preceding) z, length(text) n from u), p as (select doc_id, unnest(generate_series(0, length(text)::bigint, 1000)) off from documents) select p.doc_id, off, unit_id::int unit_id from p join o on o.doc_id=p.doc_id and off>=z-n and off<z""")
def asof_offset(spark, d):
    o = timeline.offsets(units(spark, d), ["doc_id"], ["unit_id"], F.length("text").cast("long")).select("doc_id", "unit_id", "off_start", "off_end")
    p = read(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(1000).cast("long"))).alias("off"))
    return timeline.asof(p, o, ["doc_id"], "off", "off_start", "off_end", 1000).select("doc_id", "off", "unit_id")


@query(E + """, w as (select distinct track, start//3600*3600 w_start, start//3600*3600+3600 w_end from e) select e.track, event_id, w_start from e join w on e.track=w.track and start>=w_start and "end"<=w_end""")
def interval_contains(spark, d):
    e = events(spark, d)
    w = e.select("track", (F.floor(F.col("start") / 3600) * 3600).alias("w_start")).distinct().withColumn("w_end", F.col("w_start") + 3600)
    return timeline.contained(e, w, "track", 3600).select("track", "event_id", "w_start")


TOK = r"list_filter(regexp_split_to_array(lower(text),'[ \t\n\r]+'), lambda x: x<>'')"
GRAMS = f"""with dt as (select doc_id, {TOK} w from documents), bt as (select item_id, {TOK} w from benchmark),
dg as (select doc_id, i-1 pos, array_to_string(w[i:i+5],' ') g from (select doc_id, w, unnest(generate_series(1, len(w)-5)) i from dt where len(w)>=6)),
bg as (select distinct item_id, array_to_string(w[i:i+5],' ') g from (select item_id, w, unnest(generate_series(1, len(w)-5)) i from bt where len(w)>=6)),
h as (select distinct item_id, doc_id, pos from dg join bg using (g))"""


@query(GRAMS + " select item_id, doc_id, pos::int pos from h")
def ngram_candidates(spark, d):
    return similarity.candidates(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id")


@query(GRAMS + ", l as (select *, lag(pos) over (partition by item_id, doc_id order by pos) p from h) select item_id, doc_id, pos::int pos from l where p is null or pos-p>6")
def candidate_thinning(spark, d):
    return similarity.thinned(ngram_candidates(spark, d), ["item_id", "doc_id"], "pos", similarity.GRAM)


@query()
def locate_passages(spark, d):
    return similarity.located(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id")


# A text without punctuation, capitals, contractions and runs of blanks.
PLAIN = r"""regexp_replace(trim(regexp_replace(lower(replace(translate(regexp_replace({0}, '\b(i|you|he|she|it|we|they)''(ll|re|ve|d|m)\b', '\1', 'g'),'‘’‚‛“”„‟«»〝〞‐‑‒–―‹›',repeat('''',4)||repeat('"',8)||repeat('-',4)||'—<>'),'--','—')),'\p{{P}}','','g')), '\s+', ' ', 'g')"""
KIND_OF = (
    r"""case when starts_with(text, q) then 'exact' when starts_with(text, ' '||q) then 'trimmedLeading' when b<>'' and starts_with(regexp_replace(text,'^[\s\p{P}]+',''), b) then 'ignoringEndsPunctuation'
 when """
    + PLAIN.format("q") + " <> '' and starts_with(" + PLAIN.format("text") + ", " + PLAIN.format("q") + r""") then 'ignoringAllPunctuation' end match_type
from (select *, regexp_replace(regexp_replace(q,'^[\s\p{P}]+',''),'[\s\p{P}]+$','') b from (select *, """
)


@query(S + " select conv_id, turn, " + KIND_OF + """case when turn%3=0 then left(text,20) when turn%3=1 then '"'||left(text,20)||'"' else 'zzz' end q from s))""")
def prefix_match_type(spark, d):
    q = F.when(F.col("turn") % 3 == 0, F.left("text", F.lit(20))).when(F.col("turn") % 3 == 1, F.concat(F.lit('"'), F.left("text", F.lit(20)), F.lit('"'))).otherwise("zzz")
    kind = similarity.prefix_match(q, F.col("text"))
    return segments(spark, d).select("conv_id", "turn", kind.alias("match_type"))


@query(S + ' select conv_id, turn, q as "query", text, ' + KIND_OF + "translate(replace(left(text, 20), ' ', ', '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') q from s))")
def prefix_match_kinds(spark, d):
    """Queries in capitals with commas in them, which only the last step of the cascade finds."""
    q = F.translate(F.regexp_replace(F.left("text", F.lit(20)), " ", ", "), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return segments(spark, d).select("conv_id", "turn", q.alias("query"), "text", similarity.prefix_match(q, F.col("text")).alias("match_type"))


@query(f"""with t as (select doc_id, [regexp_replace(x,'[^a-z]','','g') for x in {TOK}] w from documents), p as (select doc_id, unnest(w[:-2]) a, unnest(w[2:]) b from t where len(w)>1) select distinct a, b from p where a=b or (length(a)>=4 and length(b)>=3 and abs(length(a)-length(b))<=greatest(length(a)//4,1) and levenshtein(a,b)<=greatest(length(a)//4,1))""")
def near_words(spark, d):
    w = F.transform(tx.tokens(F.col("text")), lambda x: F.regexp_replace(x, "[^a-z]", ""))
    p = read(spark, d, "documents").select(w.alias("w")).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p")).select("p.*").filter("b is not null")
    return p.filter(similarity.near_words(F.col("a"), F.col("b"))).distinct()


@query()
def aligned_units(spark, d):
    """Each document's sentences are heard with every seventh left out and the marks gone."""
    u = units(spark, d).select(F.col("doc_id").alias("chapter_id"), "unit_id", "text")
    heard = u.filter("unit_id % 7 <> 3").select("chapter_id", F.col("unit_id").alias("sent_idx"), F.regexp_replace("text", "[,;]", "").alias("text"))
    heard = timeline.offsets(heard, ["chapter_id"], ["sent_idx"], (F.length("text") + 1).cast("long"))
    return align.aligned(u, heard.select("chapter_id", "sent_idx", "text", "off_start"))


def cased_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct blank-separated words of the texts as they are written: Roman numerals are capital."""
    return read(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("word")).filter("word <> ''").distinct()


@query()
def spelled_numbers(spark, d):
    return cased_words(spark, d).withColumn("spelled", tx.spelled(F.col("word")))


@query()
def roman_words(spark, d):
    """The texts' words that spelled_word reads as Roman numerals, marks around them aside."""
    digits = F.regexp_extract("word", r"(?sU)^\W*?([IVXLCDM]{2,})%?(?:[^\w%].*)?$", 1)
    return cased_words(spark, d).withColumn("value", tx.roman_value(digits)).filter("value is not null")


PHRASES = r"""list_reduce(list_prepend({'done': []::varchar[], 'open': '', 'k': 0, 'i': 0}, list_transform(ws, lambda w: {'done': []::varchar[], 'open': w, 'k': 0, 'i': 0})), lambda s, w:
 case when s.k+1>=2 and s.i < len(ws)-2 and regexp_matches(w.open, '[,:;—]\s*$') then {'done': list_append(s.done, s.open||w.open), 'open': '', 'k': 0, 'i': s.i+1} else {'done': s.done, 'open': s.open||w.open, 'k': s.k+1, 'i': s.i+1} end)"""


@query(U + r""", pc as (select doc_id, unit_id, list_transform(regexp_extract_all(text, '[^ \t\n\r—,;!?|]*[ \t\n\r—,;!?|]+|[^ \t\n\r—,;!?|]+'), lambda p: [p]) ps from u),
wd as (select doc_id, unit_id, list_reduce(ps, lambda a, b: case when regexp_matches(b[1], '^[\s\p{P}]*$') or regexp_matches(a[-1], '^[\s\p{P}]*$') then list_append(a[:-2], a[-1]||b[1]) else list_concat(a, b) end) ws from pc where len(ps)>0),
ph as (select doc_id, unit_id, """ + PHRASES + """ st from wd)
select doc_id, unit_id::int unit_id, unnest(case when st.open<>'' then list_append(st.done, st.open) else st.done end) phrase from ph""")
def phrases(spark, d):
    return units(spark, d).select("doc_id", "unit_id", F.explode(tx.phrases(tx.words(F.col("text")))).alias("phrase"))


@query()
def word_groups(spark, d):
    w = segment_words(spark, d).select("conv_id", "turn", "word_idx", F.concat("token", F.lit(" ")).alias("token"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    from pyspark.sql import types as T

    return folds.per_group(w, ["conv_id", "turn"], ["word_idx"], folds.word_groups, T.StructType.fromDDL("conv_id long, turn int, group_idx int, token string, start double, end double, n_words int"))


@query("with recursive " + E.removeprefix("with ") + """, n as (select *, row_number() over (partition by track order by start, event_id) i from e),
f as (select track, event_id, i, start::double start, greatest("end", start)::double + case when "end" <= start then 0.001 else 0 end "end" from n where i=1
 union all select n.track, n.event_id, n.i, greatest(n.start, f."end"), case when n."end" > greatest(n.start, f."end") then n."end"::double else greatest(n.start, f."end") + 0.001 end from f join n on n.track=f.track and n.i=f.i+1)
select track, event_id, round(start,6) start, round("end",6) "end" from f""")
def overlap_repair(spark, d):
    from pyspark.sql import types as T

    e = events(spark, d).select("track", "event_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return rounded(folds.per_group(e, ["track"], ["start", "event_id"], folds.repaired, T.StructType.fromDDL("track long, event_id long, start double, end double")), "start", "end")


@query(S + """, fw as (select conv_id, turn, text, start/1000.0::double a, "end"/1000.0::double z, "end"<=start or (("end"/1000.0::double - start/1000.0::double)/len(string_split(text,' '))) < 0.15 q from s),
fv as (select *, case when row_number() over (partition by conv_id order by turn)=1 or (not q and not lag(q) over (partition by conv_id order by turn)) then 1 else 0 end b from fw),
fg as (select *, sum(b) over (partition by conv_id order by turn rows unbounded preceding) k from fv)
select conv_id, min(turn) turn, string_agg(text, '' order by turn) as text, round(arg_min(a, turn),6) start, round(max(z),6) "end", count(*)>1 or arg_min(q, turn) needs_repair from fg group by conv_id, k""")
def fast_segments_merged(spark, d):
    s = segments(spark, d).select("conv_id", "turn", "text", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return rounded(timeline.fast_merged(s, ["conv_id"], ["turn"], stats.FASTEST_WORD), "start", "end")


@query()
def word_anchors(spark, d):
    s = segment_words(spark, d).select("conv_id", "turn", F.col("word_idx").alias("idx"), "token", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return words.word_stamps(s.select("conv_id", "turn", F.col("idx").alias("word_idx"), F.col("token").alias("word")), s.filter("idx % 5 <> 3"), ["conv_id", "turn"])


PAGE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?is)^.*?<body[^>]*>|</body>.*$','','g'),'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>','','g'),'(?i)</(p|div|h[1-6]|li|ul|ol|tr|td|table|section|article|nav|blockquote|header|footer)>',chr(10),'g'),'<[^>]*>','','g'),chr(10)||'+',chr(10),'g')"


@query(f"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace({PAGE},'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&apos;',''''),'&amp;','&'),chr(10)||'+',chr(10),'g')) as text from pages")
def page_text(spark, d):
    return read(spark, d, "pages").select("page_id", tx.text_of_html(F.col("html")).alias("text"))


@query(r"""select page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) href from pages""")
def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query()
def page_units(spark, d):
    return book.page_units(read(spark, d, "pages"))


@query()
def page_tagged(spark, d):
    return book.tagged(read(spark, d, "pages").select(F.col("page_id").alias("chapter_id"), F.col("html").alias("xml")))


@query("""with c as (select doc_id spine_idx, doc_id, quality=1 as o, toxic=1 as f from documents left join labels using (doc_id)), s as (select *, max(case when o then 1 else 0 end) over () h, last_value(case when f then false when o then true end ignore nulls) over (order by spine_idx rows unbounded preceding) st from c) select doc_id from s where h=0 or st""")
def selected_chapters(spark, d):
    c = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return timeline.selected(c, ["doc_id"], F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))).select("doc_id")


CLIPS = U + r""", c as (select doc_id, unit_id, text, (start/1000.0)::double a, ("end"/1000.0)::double b from u),
k as (select *, b-a d, len(list_filter(regexp_split_to_array(trim(text),'\s+'), lambda x: x<>'')) n, lag(unit_id) over (partition by doc_id order by unit_id) is null or lead(unit_id) over (partition by doc_id order by unit_id) is null edge, b = max(b) over (partition by doc_id) fin, doc_id = min(doc_id) over () or doc_id = max(doc_id) over () rim from c),
x as (select *, case when n<3 and edge then 4.0 else 0.0 end extra, rim and fin as bound from k),
i as (select doc_id, unit_id, case when trim(text)='' then 'empty fragment' when regexp_matches(text,'^[\s\p{P}]*$') then null when n=0 then 'no words' when d > (case when n<2 then 3.5 else 45 end)+extra and not bound then 'long duration' when d/n > 3.5+extra and not bound then 'slow pace' when d < (case when n<2 or length(text)<6 then 0.1 else 0.3 end) then 'short duration' when d/n < (case when n<=3 then 0.05 else 0.14 end) then 'fast pace' when length(text)/d < (case when extra>0 then 0.3 else 3.0 end) then null when length(text)/d > 100 then 'fast characters' end issue from x)"""


def clips(spark, d):
    return units(spark, d).select(F.col("doc_id").alias("smil"), F.col("unit_id").alias("idx"), F.lit("a").alias("track"), "text", (F.col("start") / 1000).alias("clip_begin"), (F.col("end") / 1000).alias("clip_end"))


@query(CLIPS + " select issue, count(*) n from i where issue is not null group by 1")
def overlay_checks(spark, d):
    return overlay.issues(clips(spark, d)).filter("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(U + """ select doc_id, unit_id::int unit_id, printf('<par id="%s-%d"><text src="%s#%s-sentence%d"/><audio src="%s" clipBegin="%.3fs" clipEnd="%.3fs"/></par>', doc_id::varchar, unit_id, doc_id::varchar||'.xhtml', doc_id::varchar, unit_id, 'a.m4a', start/1000.0::double, "end"/1000.0::double) par from u where start<>"end" """)
def smil_rows(spark, d):
    u = units(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("chapter_id"), "unit_id", F.concat(F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("href"), F.lit("a.m4a").alias("track"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return overlay.rows(u).select("doc_id", "unit_id", "par")


@query(U + " select doc_id, sha256(string_agg(text, chr(10) order by unit_id)) checksum from u group by 1")
def content_checksum(spark, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "text"))), lambda x: x["text"]), "\n")
    return units(spark, d).groupBy("doc_id").agg(F.sha2(joined, 256).alias("checksum"))


@query(U + """ select doc_id, unit_id::int unit_id from u where not ((doc_id*5+unit_id)%4=0) and not ((doc_id+unit_id*3)%5=0)""")
def missing_units(spark, d):
    """Of all units those neither aligned nor skipped; subsets of the units stand in for these two tables."""
    u = units(spark, d).withColumnRenamed("doc_id", "chapter_id")
    a, s = aligned_and_skipped(u)
    return stats.missing(u, a, s).select(F.col("chapter_id").alias("doc_id"), "unit_id")


def aligned_and_skipped(u: DataFrame) -> tuple[DataFrame, DataFrame]:
    return u.filter((F.col("chapter_id") * 5 + F.col("unit_id")) % 4 == 0), u.filter((F.col("chapter_id") + F.col("unit_id") * 3) % 5 == 0)


@query(E + """ select track, round(coalesce(sum((event_id%100)::double*(case when "end">start then "end"-start end))/sum(case when "end">start then "end"-start end),0),6) confidence, list_sort(list_distinct(list(token))) kinds from e group by 1""")
def weighted_confidence(spark, d):
    e = events(spark, d)
    return e.groupBy("track").agg(F.round(stats.weighted_mean((F.col("event_id") % 100).cast("double"), F.col("end") - F.col("start")), 6).alias("confidence"), F.array_sort(F.collect_set("token")).alias("kinds"))


@query(U + """ select doc_id, text as concatenation from (select doc_id, string_agg(text, ' ' order by unit_id) as text from u group by 1)""")
def transcript_text(spark, d):
    return units(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "text"))), lambda x: x["text"]), " ").alias("concatenation"))


def quoted(c: Column) -> Column:
    return tx.escaped(c)


@query(S + """ select conv_id, turn, replace(replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&apos;') escaped from s""")
def escaped_text(spark, d):
    return segments(spark, d).select("conv_id", "turn", quoted(F.col("text")).alias("escaped"))


@query(r"""select page_id, split_part(url,'#',1) plain, regexp_extract(split_part(url,'#',1), '\.([^./]+)$', 1) extension from pages""")
def url_parts(spark, d):
    p = tx.without_fragment(F.col("url"))
    return read(spark, d, "pages").select("page_id", p.alias("plain"), tx.extension(p).alias("extension"))
