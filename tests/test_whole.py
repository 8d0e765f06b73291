"""Registered queries do the whole job: what their input holds reaches the operator."""

import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import align, similarity
from lectern.plans import more, registry  # noqa: F401  both add their queries

SF = "/root/testdata/sf0.001"


def test_missing_units_of_all(spark):
    units = {(r.doc_id, r.unit_id) for r in registry.QUERIES["unit_rows"](spark, SF).collect()}
    got = [(r.doc_id, r.unit_id) for r in registry.QUERIES["missing_units"](spark, SF).collect()]
    assert sorted(got) == sorted((c, u) for c, u in units if (c * 5 + u) % 4 and (c + u * 3) % 5)
    assert any((c + u) % 3 for c, u in got)


def test_numbers_of_the_texts(spark, tmp_path):
    texts = ["Chapter XIV of\nMMXXV. had 7% or 100 % word I", "(XX) XI's xiv 42 ix", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {w: tx.spelled_word(w) for t in texts for w in (t or "").split()}
    got = {r.word: r.spelled for r in registry.QUERIES["spelled_numbers"](spark, str(tmp_path)).collect()}
    assert got == want and (got["XIV"], got["MMXXV."], got["%"]) == ("fourteen", "two thousand twenty-five.", "percent")
    assert {r.word: r.value for r in registry.QUERIES["roman_words"](spark, str(tmp_path)).collect()} == {"XIV": 14, "MMXXV.": 2025, "(XX)": 20, "XI's": 11}


def test_passages_without_a_shared_gram(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(5, 9))) for _ in range(400)]
    item = [words[i] for i in range(30)]
    typos = [w[:2] + "z" + w[3:] if i % 5 == 2 else w for i, w in enumerate(item)]
    noise = lambda n: " ".join(rng.choices(words[60:], k=n))
    queries = [(1, " ".join(item)), (2, "lone heron"), (3, None), (4, "q"), (5, noise(8)), (6, " ".join(words[40:52]))]
    texts = [(1, noise(40) + " " + " ".join(typos) + " " + noise(40)), (2, "a Lone  herron here"), (3, noise(60)), (4, None), (5, " ".join(words[38:60])), (6, "")]
    got = similarity.located(*[spark.createDataFrame(x, f"{k} long, text string") for x, k in ((queries, "q"), (texts, "t"))], "q", "t").collect()
    plain = lambda x: " ".join((x or "").lower().split())
    want = {}
    for q, needle in queries:
        for t, text in texts:
            n, h = plain(needle), plain(text)
            m = similarity.nearest_match(n, h, max(1, len(n) // 10)) if n and h else None
            if m:
                want[q, t] = m[2]
    assert {(r.q, r.t): r.distance for r in got} == want and len(got) == len(want) and {(1, 1), (2, 2), (6, 5)} <= set(want)


def test_prefix_match_reaches_the_last_step(spark):
    bare = lambda x: "".join(c for c in x if unicodedata.category(c)[0] != "P")
    plain = lambda x: re.sub(r"\s+", " ", bare(x.lower()).strip(" "))
    ends = lambda x: re.sub(r"^[\s!-/:-@\[-`{-~]+", "", x)
    rows = registry.QUERIES["prefix_match_kinds"](spark, SF).collect()
    for r in rows:
        first = r.text.startswith(r.query) or r.text.startswith(" " + r.query) or ends(r.query).rstrip(" ,.") and ends(r.text).startswith(ends(r.query).rstrip(" ,.!?"))
        if not first and "'" not in r.text:
            assert r.match_type == ("ignoringAllPunctuation" if plain(r.query) and plain(r.text).startswith(plain(r.query)) else None)
    assert any(r.match_type == "ignoringAllPunctuation" for r in rows)


def same_as_sql(spark, path, texts: dict, name):
    """The query's rows over documents of these texts, which are those of its SQL."""
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    df = registry.QUERIES[name](spark, str(path))
    got = sorted(tuple(r) for r in df.collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLES[name]).select(*[f'"{c}"' for c in df.columns]).fetchall())
    return got


def test_spans_of_just_the_least_time(spark, tmp_path):
    # 231's 55th unit, interpolated, has 200 ms from 36810 ms on for two words; as seconds the two doubles differ by less.
    assert (231, 54, False, 36810, 37010) in same_as_sql(spark, tmp_path, {k: "a b. " * 60 + "a b." for k in (82, 231, 352)}, "rebuilt_spans")


def test_phrases_of_broken_lines(spark, tmp_path):
    texts = {1: "of, of,\nLicensed under it.", 2: "One, two;\t\r\n three of, \f four five.", 3: "a, b;\x0bc d e", 4: "a b;\u2028, c d e", 5: "\xa0 a,\u3000b c.\xa0", 6: None, 7: ""}
    got = same_as_sql(spark, tmp_path, texts, "phrases")
    assert {(1, 0, "of, of,\n"), (1, 0, "Licensed under it."), (2, 0, "One, two;\t\r\n "), (3, 0, "a, b;"), (5, 0, "a,\u3000b c.")} <= set(got)


@pytest.mark.parametrize("books,span", [(1, 4), (3, 4), (1, 4096)])
def test_head_bounds_of_ranges(spark, monkeypatch, books, span):
    monkeypatch.setattr(align, "SPINE", span)
    rng = random.Random(books * span)
    rows = [(b or None, i, rng.choice([0, 0, 0, 0, 0, 0, None, b * 1000 + i + 7])) for b in range(books) for i in range(-20, 60, 1 + b)]
    chapters = spark.createDataFrame(rows, "path int, spine_idx long, off long")
    d = align.head_bounds(chapters if books > 1 else chapters.drop("path"))
    want = set()
    for b, i, off in rows:
        used = [(j, x) for c, j, x in rows if c == b and x]
        want.add((*[b] * (books > 1), i, off, max([u for u in used if u[0] < i], default=(0, None))[1], min([u for u in used if u[0] > i], default=(0, None))[1]))
    got = [tuple(r) for r in d.collect()]
    assert set(got) == want and len(got) == len(want)
    # A frame up to the last row is read again for every row, so its time grows with the square of the rows.
    assert "unboundedfollowing" not in d._jdf.queryExecution().toString().lower()


def test_head_bounds_of_many_chapters(spark):
    n = 300_000
    d = align.head_bounds(spark.range(n).select(F.col("id").alias("spine_idx"), F.when(F.col("id") % 90_000 == 5, F.col("id")).otherwise(0).alias("off")))
    got = d.agg(F.count(F.lit(1)), F.count("prev_off"), F.sum("prev_off"), F.count("next_off"), F.sum("next_off")).first()
    used = range(5, n, 90_000)
    assert tuple(got) == (n, n - 6, sum(u * (min(u + 90_000, n - 1) - u) for u in used), used[-1], sum(u * (u - max(u - 90_000, 0)) for u in used))
