"""Queries on retiming, reports, transcripts, predicates and tables, added to those of the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import times as tm
from lectern.operators import overlay, report, retime, stats, timeline
from lectern.plans.registry import BINS, CLIPS, SCORED, SW, E, S, U, aligned_and_skipped, clips, events, paced, query, read, segment_words, segments, units
from lectern.sources import book

# Stamps of a track (a conversation): its words in order, with offsets in their text; a turn's words are a sentence.
STAMPS = SW + """, st as (select conv_id track, turn, word_idx, row_number() over (partition by conv_id order by turn, word_idx)-1 idx, token||' ' token, start, "end", word_idx=0 as begins, lead(turn) over (partition by conv_id order by turn, word_idx) is distinct from turn as ends,
 (sum(length(token)+1) over (partition by conv_id order by turn, word_idx rows unbounded preceding) - length(token)-1)::bigint off_start, (sum(length(token)+1) over (partition by conv_id order by turn, word_idx rows unbounded preceding) - 2)::bigint off_end from sw)"""


def stamps(spark, d) -> DataFrame:
    w = segment_words(spark, d).withColumn("token", F.concat("token", F.lit(" "))).withColumnRenamed("conv_id", "track")
    order = ["turn", "word_idx"]
    w = timeline.offsets(timeline.numbered(w, ["track"], order), ["track"], order, F.length("token").cast("long"))
    last = ~F.lead("turn").over(timeline.order_of(["track"], order)).eqNullSafe(F.col("turn"))
    return w.withColumns({"off_end": F.col("off_end") - 2 + 0, "begins": F.col("word_idx") == 0, "ends": last, "idx": F.col("idx").cast("long")})


# Each turn is matched from its first word on: as it is, cut before its last word, or with a blank behind it.
MATCHED = STAMPS + """, ma as (select track, turn::bigint unit_id, min(idx) first_idx, min(off_start) f, string_agg(token, '' order by word_idx) s, count(*) n, any_value(turn) turn from st group by track, turn),
mb as (select track, unit_id, first_idx, f, case when turn%3=0 then trim(s) when turn%3=1 then s else trim(left(s, greatest(length(s)-6, 1)::bigint)) end "match" from ma)"""


@query(
    MATCHED
    + """, lo as (select track, max(off_start) last_off from st group by 1),
e as (select mb.*, f + length("match") - 1 as tgt, last_off from mb join lo using (track)),
l as (select e.*, (select max(idx) from st where st.track=e.track and st.off_start < e.tgt) i from e),
k as (select l.*, case when i is not null and i >= first_idx and last_off >= tgt then i else first_idx end last_i, coalesce(i >= first_idx and last_off >= tgt, false) inside from l),
xt as (select k.*, (select string_agg(lower(token), '' order by idx) from st where st.track=k.track and st.idx between k.first_idx and k.last_i) txt from k),
yt as (select xt.*, a.ends, b.token nt, b.begins nb from xt join st a on a.track=xt.track and a.idx=xt.last_i left join st b on b.track=xt.track and b.idx=xt.last_i+1)
select track, unit_id, first_idx, case when coalesce(inside and length(trim(nt))<=4 and not ends and not coalesce(nb,false) and trim(txt)<>trim(lower("match")) and rtrim(txt)||' '||trim(lower(nt))=trim(lower("match")), false) then last_i+1 else last_i end last_idx from yt"""
)
def end_stamps(spark, d):
    s = stamps(spark, d)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "token"))), lambda t: t["token"]), "")
    m = s.groupBy("track", "turn").agg(F.min("idx").alias("first_idx"), whole.alias("s"))
    cut = F.expr("trim(left(s, cast(greatest(length(s) - 6, 1) as int)))")
    m = m.select("track", F.col("turn").cast("long").alias("unit_id"), "first_idx", F.when(F.col("turn") % 3 == 0, F.trim("s")).when(F.col("turn") % 3 == 1, F.col("s")).otherwise(cut).alias("match"))
    return retime.end_stamps(m, s).select("track", "unit_id", "first_idx", "last_idx")


@query(
    STAMPS
    + """, un as (select track, turn unit_id, min(idx) fi, max(idx) li, min(start) start from st where turn%3<>1 group by 1,2), ne as (select track, greatest(min(start)-60000,0) lo, max(start)+60000 hi from un group by 1)
select st.track, st.idx, st.track chapter_id from st join ne using (track) where not exists (select 1 from un where un.track=st.track and st.idx between fi and li) and st.start>=lo and st."end"<=hi"""
)
def unassigned_stamps(spark, d):
    s = stamps(spark, d)
    u = s.filter("turn % 3 <> 1").groupBy("track", F.col("turn").alias("unit_id")).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("start").alias("start")).withColumn("chapter_id", F.col("track"))
    return retime.unassigned(s, u, 60000).select("track", "idx", "chapter_id")


OFFSETS = U + """, o as (select doc_id, unit_id, case when unit_id%4<>2 and unit_id%4<>3 then sum(length(text)) over w - length(text) end off_start, case when unit_id%4<>2 and unit_id%4<>3 then sum(length(text)) over w - 1 end off_end from u window w as (partition by doc_id order by unit_id rows unbounded preceding))"""


@query(
    OFFSETS
    + """, p as (select *, coalesce(last_value(off_end ignore nulls) over (partition by doc_id order by unit_id rows between unbounded preceding and 1 preceding), -1) b, sum(case when off_start is null then 0 else 1 end) over (partition by doc_id order by unit_id rows unbounded preceding) r, lead(off_start) over (partition by doc_id order by unit_id) n from o),
q as (select *, b + row_number() over (partition by doc_id, r, off_start is null order by unit_id) tgt from p)
select doc_id, unit_id::int unit_id, coalesce(off_start, tgt)::bigint fill_start, case when off_start is not null then off_end when n>0 then n-1 else tgt end::bigint fill_end from q"""
)
def offset_fill(spark, d):
    u = timeline.offsets(units(spark, d), ["doc_id"], ["unit_id"], F.length("text").cast("long"))
    known = F.col("unit_id") % 4 < 2
    u = u.select("doc_id", "unit_id", F.when(known, F.col("off_start")).alias("off_start"), F.when(known, F.col("off_end") - 1).alias("off_end"))
    return retime.filled_offsets(u, ["doc_id"], ["unit_id"]).select("doc_id", "unit_id", "fill_start", "fill_end")


@query(
    U
    + """, a as (select doc_id, unit_id, vlen+1 v, start, "end", (doc_id+unit_id)%7=0 sh, (doc_id+unit_id)%5=0 ip, len(string_split(text,' ')) n from u),
b as (select *, not sh and not ip f, sh or (ip and ("end"-start)/n < 100) su from a),
c as (select *, sum(case when f then 1 else 0 end) over (partition by doc_id order by unit_id rows unbounded preceding) g from b),
gg as (select doc_id, g, bool_or(su and not f) bad from c group by 1,2), mo as (select doc_id, max(g) m from c group by 1),
h as (select gg.doc_id, gg.g, bad and gg.g>0 and gg.g<m bad from gg join mo using (doc_id)),
i as (select *, coalesce(lag(bad) over (partition by doc_id order by g), false) was from h),
j as (select *, sum(case when bad and not was then 1 else 0 end) over (partition by doc_id order by g rows unbounded preceding) ch from i),
k as (select c.*, ch, bad or (f and was) re from c join j on c.doc_id=j.doc_id and c.g=j.g),
l as (select *, min(start) over p lo, max("end") over p hi, sum(v) over p t, sum(v) over (partition by doc_id, ch, re order by unit_id rows unbounded preceding) up from k window p as (partition by doc_id, ch, re))
select doc_id, unit_id::int unit_id, re rebuilt, case when re then (lo+floor((hi-lo)*(up-v)/t::double))::bigint else start end new_start, case when re then (lo+floor((hi-lo)*up/t::double))::bigint else "end" end new_end from l"""
)
def rebuilt_spans(spark, d):
    n = F.size(F.split("text", " "))
    u = units(spark, d).withColumns({"shared": (F.col("doc_id") + F.col("unit_id")) % 7 == 0, "interpolated": (F.col("doc_id") + F.col("unit_id")) % 5 == 0})
    u = u.withColumn("suspect", retime.suspicious(F.col("shared"), F.col("interpolated"), F.col("start"), F.col("end"), n, 100))
    return retime.rebuilt(u, ["doc_id"], ["unit_id"], F.col("vlen") + 1).select("doc_id", "unit_id", "rebuilt", "new_start", "new_end")


@query(U + """, c as (select doc_id, count(*) n, any_value(text) t from u group by 1) select doc_id from c where n>1 or len(string_split(t,' '))>=4""")
def worthwhile_chapters(spark, d):
    """Chapters of more than one sentence, or of one with four words."""
    c = read(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return c.filter((F.size("s") > 1) | (F.size(F.split(F.get("s", F.lit(0)), " ")) >= 4)).select("doc_id")


ODD = "case event_id%6 when 0 then '[_TT_'||event_id||']' when 1 then '<unk>' when 2 then '[_BEG_]' when 3 then '[BLANK_AUDIO]' else event_type end"


@query(f"""with t as (select event_id, {ODD} token from events) select event_id, token from t where not starts_with(token,'[_') and token<>'<unk>'""")
def spoken_tokens(spark, d):
    n, e = F.col("event_id") % 6, F.col("event_id").cast("string")
    token = F.when(n == 0, F.concat(F.lit("[_TT_"), e, F.lit("]"))).when(n == 1, "<unk>").when(n == 2, "[_BEG_]").when(n == 3, "[BLANK_AUDIO]").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", token.alias("token")).filter(~tx.special_token(F.col("token")))


@query(
    U
    + """, x as (select doc_id chapter_id, unit_id, doc_id%4<>3 and (doc_id*5+unit_id)%4=0 a, doc_id%4<>3 and doc_id%4<>2 and (doc_id+unit_id*3)%5=0 s from u),
y as (select chapter_id, (count(*) filter (a))::bigint aligned, (count(*) filter (s))::bigint skipped, (count(*) filter (not a and not s))::bigint missing from x group by 1) select *, missing>0 and aligned=0 and skipped=0 missed, aligned=0 as empty from y"""
)
def chapter_states(spark, d):
    u = units(spark, d).withColumnRenamed("doc_id", "chapter_id")
    a, s = aligned_and_skipped(u)
    return stats.chapter_states(u, a.filter("chapter_id % 4 <> 3"), s.filter("chapter_id % 4 not in (2, 3)"))


@query(
    S
    + """, q as (select *, (("end"-start)/1000.0::double)/len(string_split(text,' ')) pace from s), g as (select conv_id, count(*) segments, count(*) filter (turn%3<>0) start_gaps, count(*) filter (turn%4<>0) end_gaps, count(*) filter (pace<0.15) fast, round(avg(pace),6) average_pace, round(avg(case when vlen>0 then (("end"-start)/1000.0::double)/vlen else 0.0 end),6) per_voice from q group by 1)
select sum(segments)::bigint segments, sum(start_gaps)::bigint start_gaps, sum(end_gaps)::bigint end_gaps, sum(fast)::bigint fast, round(sum(average_pace*segments)/sum(segments),6) average_pace, round(sum(per_voice*segments)/sum(segments),6) per_voice from g"""
)
def merged_transcriptions(spark, d):
    s = segments(spark, d).withColumns({"start_gap": F.col("turn") % 3, "end_gap": F.col("turn") % 4})
    per = stats.segment_stats(s.withColumns({"start": F.lit(0.0), "end": (F.col("end") - F.col("start")) / 1000}), ["conv_id"])
    return stats.merged_transcriptions(per)


@query(U + """ select doc_id, sum("end"-start)::bigint duration from u where start<>"end" group by rollup(doc_id)""")
def media_durations(spark, d):
    """Of each chapter's overlay, and, with no chapter, of all."""
    return units(spark, d).filter("`end` <> start").rollup("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("duration"))


@query(CLIPS.replace("select doc_id, unit_id, case when trim(text)=''", "select doc_id, unit_id, text, case when trim(text)=''") + """, m as (select doc_id, unit_id, string_split(regexp_replace(trim(text),'([.!?]+)[ \n\t\r]+','\\1'||chr(1),'g'),chr(1)) p from u), z as (select issue from i where issue is not null union all select 'too many sentences' from m where len(p)>3) select issue, count(*) n from z group by 1""")
def issue_counts(spark, d):
    return overlay.issue_counts(clips(spark, d))


@query(E + """, o as (select *, lag("end") over (partition by track order by start, event_id) prev_end from e) select track, event_id, prev_end from o where start < prev_end""")
def overlapping_clips(spark, d):
    c = events(spark, d).select("track", F.col("event_id").alias("idx"), F.col("start").alias("clip_begin"), F.col("end").alias("clip_end"))
    return overlay.overlapping(c).select("track", F.col("idx").alias("event_id"), "prev_end")


REPORT = BINS + """, rp as (select 'fast' kind, chapter_id, unit_id from fast union all select 'slow', chapter_id, unit_id from slow union all select 'short', chapter_id, unit_id from short union all select 'long', chapter_id, unit_id from long_)"""


@query(REPORT + " select kind, chapter_id, count(*)::int n, string_agg(unit_id::varchar, ',' order by unit_id) units from rp group by 1, 2")
def outlier_report(spark, d):
    r = report.outliers(stats.outliers(paced(spark, d)))
    return r.select("kind", "chapter_id", F.size("sentences").alias("n"), F.array_join(F.transform("sentences", lambda s: s["unit_id"].cast("string")), ",").alias("units"))


@query(REPORT + """, n as (select kind, chapter_id, count(*) n from rp group by 1, 2) select kind, sum(n)::bigint sentences, (sum(n) + 3*count(*) + 2)::bigint lines from n group by 1""")
def report_lines(spark, d):
    t = report.as_text(report.outliers(stats.outliers(paced(spark, d))))
    kind = F.element_at(F.array(*[F.lit(k) for k in report.KINDS]), F.col("section"))
    return t.groupBy(kind.alias("kind")).agg(F.count(F.when(F.startswith("value", F.lit("    sentence #")), 1)).alias("sentences"), F.count(F.lit(1)).alias("lines"))


@query(SCORED + """ select '{"chapter_id":'||chapter_id||',"n":'||n||'}' as value from sc""")
def report_json(spark, d):
    return report.as_json(stats.chapter_scores(stats.flagged(paced(spark, d))), ["n", "chapter_id"])


@query("""with t as (select * from (values ('epub', 0.0, 2.5), ('align', 10.0, 31.25), ('report', 40.0, 41.0), ('audio', 3.0, 4.0)) v(stage, began, ended)) select sum(ended-began)::double runtime from t where stage<>'report'""")
def run_time(spark, d):
    return report.run_time(spark.createDataFrame([("epub", 0.0, 2.5), ("align", 10.0, 31.25), ("report", 40.0, 41.0), ("audio", 3.0, 4.0)], "stage string, began double, ended double"))


@query(
    U
    + r""" select doc_id, unit_id::int unit_id, substr(text, 4, 7) middle, left(text,128) head, right(text,128) tail, regexp_matches(text,'^\s') starts_blank, regexp_matches(text,'\s$') ends_blank, regexp_matches(text,'\S') has_text, regexp_full_match(left(text,2),'[0-9]+') digits, contains(text,'qu') or contains(text,'!') has_any from u"""
)
def text_predicates(spark, d):
    t = F.col("text")
    return units(spark, d).select("doc_id", "unit_id", tx.clamped(t, F.lit(3), F.lit(10)).alias("middle"), tx.head(t).alias("head"), tx.tail(t).alias("tail"), tx.starts_blank(t).alias("starts_blank"), tx.ends_blank(t).alias("ends_blank"), tx.has_text(t).alias("has_text"), tx.all_digits(F.left(t, F.lit(2))).alias("digits"), tx.contains_any(t, ["qu", "!"]).alias("has_any"))


@query(r"""with c as (select distinct unnest(string_split(text, '')) c from documents) select c, regexp_full_match(c, '[\s\p{P}]') and c not in ('''','-','.','%','·','•') sep from c where c<>''""")
def separators(spark, d):
    c = read(spark, d, "documents").select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").distinct()
    return c.select("c", tx.is_separator(F.col("c")).alias("sep"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') iso, strftime(ts, '%Y%m%d-%H%M') name, strftime(ts, '%H:%M:%S') clock from events""")
def timestamps(spark, d):
    return read(spark, d, "events").select("event_id", *[c.alias(n) for c, n in zip(tm.stamped(F.col("ts")), ("iso", "name", "clock"), strict=True)])


def word_table(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "word"))


TOKENS = r"with t as (select doc_id, list_filter(regexp_split_to_array(lower(text),'[ \t\n\r]+'), lambda x: x<>'') w from documents), x as (select doc_id, unnest(w) word, generate_subscripts(w,1)-1 pos from t)"


@query(TOKENS + " select doc_id, word, min(pos)::int pos from x group by 1, 2")
def distinct_words(spark, d):
    """Distinct words of each document by where they come first."""
    return timeline.first_of_each(word_table(spark, d), ["doc_id", "word"], ["pos"]).select("doc_id", "word", "pos")


@query(TOKENS + ", o as (select *, sum(length(word)+1) over (partition by doc_id order by pos rows unbounded preceding) - length(word) - 1 off, count(*) over (partition by doc_id) n from x) select doc_id, pos::int pos, off::bigint off from o where pos+6<=n")
def gram_offsets(spark, d):
    """Where each six-word gram begins, in words and in characters of the text with single blanks."""
    return read(spark, d, "documents").select("doc_id", F.explode(tx.gram_offsets(tx.tokens(F.col("text")), 6)).alias("g")).select("doc_id", "g.pos", "g.off")


@query("""with p as (select doc_id, text, unnest(generate_series(1, length(text)::bigint)) i from documents) select doc_id, (i-1)::int pos from p where substr(text, i, 2)='an'""")
def exact_occurrences(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(tx.occurrences(F.col("text"), "an")).alias("pos"))


@query("""with a as (select source, lang, n_chars%7 k from documents), b as (select source, lang, n_chars%5 k from documents) select 'left' side, * from (select * from a except all select * from b) union all select 'right', * from (select * from b except all select * from a)""")
def table_diff(spark, d):
    a, b = (read(spark, d, "documents").select("source", "lang", (F.col("n_chars") % n).alias("k")) for n in (7, 5))
    return timeline.diff(a, b)


@query("""select conv_id, turn::int turn, role, text from conversations""")
def json_round_trip(spark, d):
    """Rows through JSON and back by an explicit schema."""
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    return c.select(F.to_json(F.struct(*c.columns)).alias("j")).select(F.from_json("j", c.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(",", ", ").replace(":", " ")).alias("r")).select("r.*")


@query("""select o_custkey, arg_min(o_totalprice, o_orderkey) "first", count(*)::int n from orders group by 1""")
def map_by_key(spark, d):
    """Lists as maps by key: a customer's totals by order."""
    m = read(spark, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("m"))
    return m.select("o_custkey", F.element_at("m", F.array_min(F.map_keys("m"))).alias("first"), F.size("m").alias("n"))


@query(E + """, o as (select *, lag("end") over (partition by track order by start, event_id) pe, lead(start) over (partition by track order by start, event_id) ns from e)
select track, event_id, case when pe < start then (pe+start)/2.0::double else start::double end new_start, case when ns > "end" then ("end"+ns)/2.0::double else "end"::double end new_end from o""")
def gap_split(spark, d):
    g = timeline.split_gaps(events(spark, d).withColumn("segment_edge", F.lit(None).cast("long")), ["track"], ["start", "event_id"])
    return g.select("track", "event_id", F.col("new_start").cast("double").alias("new_start"), F.col("new_end").cast("double").alias("new_end"))


@query(E + """, o as (select *, event_id%10 ch, lag(event_id%10) over w pc, lag("end") over w pe, lead(start) over w ns from e window w as (partition by track order by start, event_id))
select track, event_id, case when pe is null then 0 when pc is distinct from ch then least(pe, start) else start end new_start, case when ns is null then 4000000000 else "end" end new_end from o""")
def closed_boundaries(spark, d):
    e = events(spark, d).withColumn("track_id", F.col("track")).withColumn("ch", F.col("event_id") % 10)
    return timeline.closed(e, ["ch"], ["start", "event_id"], F.lit(4000000000)).select("track", "event_id", "new_start", "new_end")


@query(E + """, o as (select *, lag(start) over w p, lead(start) over w n from e window w as (partition by track order by start, event_id)) select track, event_id, coalesce((p+start)/2.0::double, start) start, coalesce((n+start)/2.0::double, "end") "end" from o""")
def midpoint_spans(spark, d):
    m = timeline.midpoints(events(spark, d).withColumn("at", F.col("start")), ["track"], ["at", "event_id"], "at")
    return m.select("track", "event_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


@query(SW + """, b as (select conv_id, turn, min(start) lo, max("end") hi from sw group by 1,2), rr as (select sw.*, row_number() over (partition by conv_id, turn order by word_idx) i, count(*) over (partition by conv_id, turn) n, lo, hi from sw join b using (conv_id, turn)) select conv_id, turn, word_idx::int word_idx, case when i=1 then lo-5 else start end start, case when i=n then hi+5 else "end" end "end" from rr""")
def clamped_words(spark, d):
    w = segment_words(spark, d)
    b = w.groupBy("conv_id", "turn").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    c = timeline.clamped(w.join(b, ["conv_id", "turn"]), ["conv_id", "turn"], ["word_idx"], F.col("lo") - 5, F.col("hi") + 5)
    return c.select("conv_id", "turn", "word_idx", "start", "end")


@query(U + """, c as (select doc_id spine_idx, case when doc_id%3=0 then sum(length(text)) else 0 end off from u group by 1), o as (select *, nullif(off,0) v from c) select spine_idx, last_value(v ignore nulls) over (order by spine_idx rows between unbounded preceding and 1 preceding)::bigint prev_off, first_value(v ignore nulls) over (order by spine_idx rows between 1 following and unbounded following)::bigint next_off from o""")
def head_bounds(spark, d):
    from lectern.operators import align

    c = units(spark, d).groupBy(F.col("doc_id").alias("spine_idx")).agg(F.sum(F.length("text")).alias("n"))
    c = c.withColumn("off", F.when(F.col("spine_idx") % 3 == 0, F.col("n")).otherwise(0))
    return align.head_bounds(c).select("spine_idx", "prev_off", "next_off")


@query()
def clip_texts(spark, d):
    """Each overlay row's fragment looked up in the tagged page."""
    p = read(spark, d, "pages").select(F.col("page_id").alias("chapter_id"), F.col("html").alias("xml"))
    tagged = book.tagged(p).select(F.concat(F.col("chapter_id").cast("string"), F.lit(".xhtml")).alias("href"), "xml")
    u = book.page_units(read(spark, d, "pages")).withColumn("c", F.col("page_id").cast("string"))
    ref = F.concat("c", F.lit(".xhtml#"), "c", F.lit("-sentence"), F.col("unit_id").cast("string"))
    return book.with_text(u.select("page_id", "unit_id", "text", ref.alias("text_href")), tagged).select("page_id", "unit_id", "text", "frag_text")


def granularities(t: Column) -> dict[str, Column]:
    """Units of a text by the granularity that a reader asks for."""
    return {"sentence": tx.sentences(t), "phrase": tx.phrases(tx.words(t)), "word": tx.words(t), "chunk": tx.chunks(t, 80)}


@query()
def granular_units(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    each = F.array(*[F.struct(F.lit(k).alias("granularity"), v.alias("units")) for k, v in granularities(F.col("text")).items()])
    return t.select("conv_id", "turn", F.explode(each).alias("g")).select("conv_id", "turn", "g.granularity", F.posexplode("g.units").alias("unit_id", "text"))


# A recogniser's tokens: pieces of three letters at most with a blank before them, numbers cut at their commas, single marks.
PIECES = S + r""", pc as (select conv_id, turn, regexp_extract_all(text || ' 1,250,000, ' || turn || ',7.', ' ?[A-Za-z]{1,3}|[0-9]{1,3}|.') ps from s),
tk as (select conv_id, turn, generate_subscripts(ps,1)-1 i, unnest(ps) token from pc)"""
SEP = r"(regexp_full_match({0}, '[\s\p{{P}}]') and {0} not in (chr(39),'-','.','%','·','•'))"


@query(
    PIECES
    + ", pv as (select *, lag(token) over (partition by conv_id, turn order by i) p from tk), ed as (select *, (token='' or "
    + SEP.format("left(token,1)") + " or coalesce(" + SEP.format("right(p,1)")
    + r""", false)) and not coalesce(starts_with(token,',') <> ends_with(p,',') and not regexp_matches(p,'\s$') and not regexp_matches(token,'^\s') and case when starts_with(token,',') then regexp_matches(trim(p),'^[0-9,]*$') else regexp_matches(trim(token),'^[0-9,]*$') end, false) b from pv),
ru as (select *, sum(case when b or p is null then 1 else 0 end) over (partition by conv_id, turn order by i rows unbounded preceding) - 1 k from ed),
wo as (select conv_id, turn, k island, string_agg(token,'' order by i) token, count(*) n from ru group by 1,2,3)
select conv_id, turn, island::bigint island, token, n, case when regexp_matches(token,'^[\s\p{P}]*$') then 'punctuation' when ends_with(trim(token),'.') then 'end' when regexp_matches(trim(token),'^\p{Lu}') then 'begin' else 'other' end kind from wo where token<>''"""
)
def token_words(spark, d):
    text = F.concat("text", F.lit(" 1,250,000, "), F.col("turn").cast("string"), F.lit(",7."))
    t = segments(spark, d).select("conv_id", "turn", F.posexplode(F.regexp_extract_all(text, F.lit(r"( ?[A-Za-z]{1,3}|[0-9]{1,3}|.)"), F.lit(1))).alias("i", "token"))
    t = t.withColumns({"start": F.col("i"), "end": F.col("i")})
    return timeline.tokens_to_words(t, ["conv_id", "turn"], ["i"]).select("conv_id", "turn", "island", "token", "n", "kind")


@query(
    STAMPS
    + r""", od as (select track, idx, case when idx%4=3 then '-- ' when idx%9=5 then '! ' else token end token, start, "end", idx//6 seg from st),
fl as (select *, case when not regexp_matches(token,'^[\s\p{P}]*$') or lag(seg) over (partition by track order by idx) is distinct from seg then 1 else 0 end b from od),
gr as (select *, sum(b) over (partition by track order by idx rows unbounded preceding)-1 k from fl)
select track, k::bigint island, string_agg(token,'' order by idx) token, min(start) start, max("end") "end", count(*) n from gr group by 1,2"""
)
def punctuation_stamps(spark, d):
    token = F.when(F.col("idx") % 4 == 3, "-- ").when(F.col("idx") % 9 == 5, "! ").otherwise(F.col("token"))
    s = stamps(spark, d).withColumn("token", token).withColumn("seg", F.floor(F.col("idx") / 6))
    return timeline.punctuation_joined(s.select("track", "idx", "token", "start", "end", "seg"), ["track"], ["idx"], "seg")


@query(
    STAMPS
    + """, od as (select track, idx//3 k, idx, token, start, "end", case when idx%5=0 then -1 else off_start end os, case when idx%5=0 then -1 else off_end end oe, idx%7=0 rebuilt from st)
select track, k::bigint island, string_agg(token,'' order by idx) token, min(start) start, max("end") "end", coalesce(min(case when os>=0 then os end),-1)::bigint off_start, coalesce(max(case when oe>=0 then oe end),-1)::bigint off_end, bool_or(rebuilt) rebuilt, count(*) n from od group by 1,2"""
)
def stamps_merged(spark, d):
    lost = F.col("idx") % 5 == 0
    s = stamps(spark, d).withColumns({"off_start": F.when(lost, -1).otherwise(F.col("off_start")), "off_end": F.when(lost, -1).otherwise(F.col("off_end")), "rebuilt": F.col("idx") % 7 == 0, "island": F.floor(F.col("idx") / 3)})
    return timeline.merged(s, ["track", "island"], ["idx"], ["rebuilt"])


@query(
    E
    + """, ix as (select *, row_number() over (partition by track order by start, event_id)-1 i from e), sg as (select *, i//4 seg from ix), se as (select track, seg, max("end") edge from sg group by 1,2),
j as (select sg.*, edge from sg join se using (track, seg)), o as (select *, lag("end") over w pe, lead(start) over w ns, lag(edge) over w pg from j window w as (partition by track order by start, event_id))
select track, event_id, case when pe < start then case when pg >= pe and pg <= start then pg::double else (pe+start)/2.0::double end else start::double end new_start, case when ns > "end" then case when edge >= "end" and edge <= ns then edge::double else ("end"+ns)/2.0::double end else "end"::double end new_end from o"""
)
def gap_split_at_segments(spark, d):
    """Gaps are split where the segment of the row before them ends, looked up by its index."""
    e = timeline.numbered(events(spark, d), ["track"], ["start", "event_id"]).withColumn("seg", F.floor(F.col("idx") / 4))
    e = e.join(e.groupBy("track", "seg").agg(F.max("end").alias("segment_edge")), ["track", "seg"])
    g = timeline.split_gaps(e, ["track"], ["start", "event_id"])
    return g.select("track", "event_id", F.col("new_start").cast("double").alias("new_start"), F.col("new_end").cast("double").alias("new_end"))
