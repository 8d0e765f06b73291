"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, fingerprints, katz, langid, mixing, near, repeats, secrets, sharding, warc
from lectern.llm.common import scratch, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.removed(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.linked(table(spark, sf_dir, "documents"), k=3, similarity=(85, 100))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("long").alias("taken"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out(F.col("doc_id"), 5, 1)
    got = katz.scored(table(spark, sf_dir, "documents"), ~out)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.write(table(spark, sf_dir, "documents"), f"{scratch(spark)}/shards")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return got.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(secrets.merged(F.col("base"), F.col("added"))).alias("spans"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.filter(~out))
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_repeats, op3_near, op4_mix, op5_katz, op6_shard, op7_secrets, op8_fingerprint, op9_warc, op10_language)}


WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
TOKENS = WORDS.format("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPLIT = WORDS.format("text", r"[^\x20\x09-\x0D]+")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": f"""
with iw as (select item_id, {TOKENS} w from benchmark),
iwin as (select distinct item_id, least(len(w), 10) l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) i from iw where len(w) > 0)),
lens as (select distinct l from iwin),
dw as (select doc_id, {TOKENS} w from documents),
dwin as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') g
  from (select doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) i from dw, lens where len(w) >= l)),
hits as (select doc_id, i, l, item_id from dwin join iwin using (l, g)),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + l - 1)) p from hits) group by 1),
hi as (select doc_id, count(distinct item_id) n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) items_sha256 from hits group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hw using (doc_id) left join hi using (doc_id)""",
        "op2_repeats": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) g from (select doc_id, h, unnest(generate_series(0, (length(h) // 2 - 400)::bigint)) i from d where length(h) >= 800)),
r as (select doc_id, i from (select *, count(*) over (partition by g) c from p) where c > 1),
s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end b from r),
t as (select doc_id, i, sum(b) over (partition by doc_id order by i rows unbounded preceding) k from s),
u as (select doc_id, k, min(i) a, max(i) + 400 z from t group by 1, 2),
v as (select doc_id, count(*) n_spans, sum(z - a) n_removed from u group by 1),
x as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) f, a e from u union all select doc_id, max(z), null from u group by 1),
y as (select x.doc_id, string_agg(substr(h, (2 * f + 1)::bigint, (2 * (coalesce(e, length(h) // 2) - f))::bigint), '' order by f) kept from x join d using (doc_id) group by 1)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join v using (doc_id) left join y using (doc_id)""",
        "op3_near": f"""
with recursive d as (select doc_id, {SPLIT} w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
both_ as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as root from documents union select both_.b, r.root from r join both_ on both_.a = r.doc_id)
select doc_id, coalesce(max(n.n), 0)::bigint n_shingles, min(root) component_id, doc_id = min(root) kept from r left join n using (doc_id) group by doc_id""",
        "op4_mix": f"""
with d as (select doc_id, source, len({SPLIT})::bigint size from documents),
k as (select source, count(*) n_rows, sum(size)::bigint source_size, row_number() over (order by source nulls last) k from d group by source),
t as (select *, [3.0, 1.0, 2.0][(k - 1) % 3 + 1]::double weight, source_size * 2.0::double as most from k),
o as (select *, coalesce(sum(most) over (order by most / weight, k rows between unbounded preceding and 1 preceding), 0.0)::double before, sum(weight) over (order by most / weight, k rows between current row and unbounded following)::double left_ from t),
l as (select *, ((sum(source_size) over ())::double * 1.5 - before) / left_ as level from o),
f as (select *, max(case when level * weight <= most then level end) over () found from l),
g as (select source, source_size, n_rows, least(most, coalesce(found, 'infinity'::double) * weight)::double target from f),
h as (select *, case when source_size > 0 then target / source_size else 0.0 end rate, ceil(n_rows / 20000.0) strata, ('0x' || md5('mix:' || coalesce(source, chr(0)))[1:8])::bigint::double / 4294967296.0 shift from g),
j as (select doc_id, d.source, size, source_size, target, rate, shift, floor(('0x' || md5('mix:' || coalesce(doc_id::varchar, ''))[1:8])::bigint::double / 4294967296.0 * strata) stratum from d join h on d.source is not distinct from h.source),
m as (select *, row_number() over (partition by source order by stratum, size, md5(doc_id::varchar), doc_id) pos from j)
select doc_id, size, source_size, target, ((floor(shift + rate * pos) - floor(shift + rate * (pos - 1))) * size)::bigint taken from m""",
        "op5_katz": f"""
with d as (select doc_id, list_append({SPLIT}, chr(0)) w, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) crc from documents),
t as (select doc_id, xor(crc, 4294967295) % 5 = 1 held_out, unnest(w) w, generate_subscripts(w, 1) i from d),
g as (select *, coalesce(lag(w) over (partition by doc_id order by i), chr(1)) a from t),
c1 as (select w, count(*) c from g where not held_out group by 1), c2 as (select a, w, count(*) c from g where not held_out group by 1, 2),
n1 as (select sum(c) n, count(*) v from c1),
o1 as (select r, (select count(*) from c1 where c = r) n from range(1, 7) x(r)), o2 as (select r, (select count(*) from c2 where c = r) n from range(1, 7) x(r)),
a1 as (select case when max(case when r = 1 then n end) > 0 then 6.0 * max(case when r = 6 then n end) / max(case when r = 1 then n end) else 1.0 end::double a from o1),
a2 as (select case when max(case when r = 1 then n end) > 0 then 6.0 * max(case when r = 6 then n end) / max(case when r = 1 then n end) else 1.0 end::double a from o2),
e1 as (select x.r, case when x.n > 0 and a < 1 then (((x.r + 1) * y.n)::double / (x.r * x.n) - a) / (1 - a) else 0.0 end k from o1 x join o1 y on y.r = x.r + 1, a1),
e2 as (select x.r, case when x.n > 0 and a < 1 then (((x.r + 1) * y.n)::double / (x.r * x.n) - a) / (1 - a) else 0.0 end k from o2 x join o2 y on y.r = x.r + 1, a2),
d1 as (select r, case when k > 0 and k < 1 then k else (r - 0.5) / r end::double k from e1), d2 as (select r, case when k > 0 and k < 1 then k else (r - 0.5) / r end::double k from e2),
m1 as (select w, c, c * coalesce(k, 1.0) m from c1 left join d1 on r = c), m2 as (select a, w, c, c * coalesce(k, 1.0) m from c2 left join d2 on r = c),
s1 as (select sum(m) / max(n) share, greatest(1 - sum(m) / max(n), 1 / (max(n) + 1.0)) rest, max(n) n, max(v) v from m1, n1),
p1 as (select w, c, (1 - rest) / share * m / n p from m1, s1),
h as (select a, sum(m2.c) total, sum(m) / sum(m2.c) share, greatest(1 - sum(m) / sum(m2.c), 1 / (sum(m2.c) + 1.0)) rest, sum(p) lower_ from m2 join p1 using (w) group by a),
q as (select g.doc_id, held_out, p1.c c, coalesce(p1.p, rest_) pu, case when h.a is null then coalesce(p1.p, rest_) when m2.m is not null then (1 - h.rest) / h.share * m2.m / h.total else h.rest / greatest(1 - h.lower_, 1e-12) * coalesce(p1.p, rest_) end p
  from g left join p1 on p1.w = g.w left join h on h.a = g.a left join m2 on m2.a = g.a and m2.w = g.w, (select rest rest_ from s1))
select doc_id, held_out, count(*) n_tokens, count(c) n_known, max(n)::bigint train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) base_score, round(sum(log10(p)), 6) score from q, s1 group by 1, 2""",
        "op9_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha1(encode(coalesce(html, ''))) payload_digest from pages),
b as (select *, max(page_id) over (partition by payload_digest) best from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and best <> page_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and best <> page_id then best end refers_to from b""",
    }
