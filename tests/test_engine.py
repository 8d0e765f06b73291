"""Every query against its SQL, the text functions' cases, and properties of the folds."""

import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lectern.functions import text as tx
from lectern.functions import times as tm
from lectern.operators import align, folds, similarity, words
from lectern.plans import registry
from lectern.sources import book

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, sql = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert canonical(got) == canonical(sql.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("word,want", [("58", "fifty-eight"), ("0019;", "nineteen;"), ("260", "two hundred sixty"), ("MCMLX!", "one thousand nine hundred sixty!"), (".75,", "point seventy-five,"), ("1.20.3", "one point twenty point three"), ("%;", "percent;"), ("64%…", "sixty-four percent…"), ("XLII", "forty-two"), ("31%", "thirty-one percent"), ("V", "V"), ("word", "word"), ("", ""), (None, None)])
def test_spelled_word(word, want):
    assert tx.spelled_word(word) == want


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_words_and_phrases(spark):
    assert one(spark, " Rain fell softly.", tx.words) == [" Rain ", "fell ", "softly."]
    assert one(spark, "He ran to town, then home again.", lambda c: tx.phrases(tx.words(c))) == ["He ran to town, ", "then home again."]
    for t in ("", "—", "a — b", "one, two; three! four?", "no end"):
        assert "".join(one(spark, t, tx.words)) == t
        assert "".join(one(spark, t, lambda c: tx.phrases(tx.words(c)))) == t


def test_times(spark):
    assert one(spark, "1:02:03.5", tm.seconds_of) == 3723.5
    assert one(spark, "12.25s", tm.seconds_of) == 12.25
    assert one(spark, "1:2:3:4", tm.seconds_of) is None


def test_prefix_match(spark):
    rows = spark.createDataFrame([("abc", "abc d"), ("abc", " abc d"), ('"abc"', "abc d"), ("a, b'c", "a b c"), ("x", "abc")], "q string, t string")
    got = [r.m for r in rows.select(similarity.prefix_match(F.col("q"), F.col("t")).alias("m")).collect()]
    assert got[:3] == ["exact", "trimmedLeading", "ignoringEndsPunctuation"] and got[4] is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("needle,text", [("kitten", "a sitting cat"), ("abc", "xxabyy"), ("hello", "hell hallo"), ("a", "b"), ("öäü", "xöauy")])
def test_nearest_match_is_least(needle, text):
    best = min(edits(needle, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    got = similarity.nearest_match(needle, text, len(needle))
    assert got[2] == best and edits(needle, got[0]) == best and text[got[1] :].startswith(got[0])
    assert similarity.nearest_match(needle, text, best - 1) is None


def test_alignment_is_monotone():
    units = ["One two three.", "Missing words here entirely.", "Four five six.", "Seven eigt nine."]
    heard, at = [], 0
    for s in ["One two three.", "Four five six.", "Seven eight nine."]:
        heard.append((s, at))
        at += len(s) + 1
    rows = align.align_units(list(enumerate(units)), heard)
    assert [r[2] for r in rows] == ["exact", "skipped", "exact", "nearest"]
    starts = [r[4] for r in rows if r[4] is not None]
    assert starts == sorted(starts)
    assert [r[2] for r in align.align_units([(0, "—"), (1, "x")], [])] == ["skipped", "skipped"]


def test_folds():
    rows = [{"start": s, "end": e, "token": "ab ", "text": "a b"} for s, e in [(0, 2), (1, 1.5), (1.2, 3), (3, 3)]]
    fixed = folds.repaired(rows)
    assert all(a["end"] <= b["start"] and b["end"] > b["start"] for a, b in zip(fixed, fixed[1:], strict=False))
    assert all(r["end"] > r["start"] for r in folds.given_time(rows))
    same = folds.spread([{"start": 1.0, "end": 1.0, "token": "a"}, {"start": 1.0, "end": 1.0, "token": "bbb"}, {"start": 2.0, "end": 3.0, "token": "c"}])
    assert math.isclose(same[1]["end"], 2.0) and math.isclose(same[0]["end"], 1.25)
    groups = folds.word_groups([{"start": i * 0.01, "end": i * 0.01 + 0.01, "token": f"w{i} "} for i in range(200)])
    assert sum(g["n_words"] for g in groups) == 200 and max(g["n_words"] for g in groups) <= 2 * folds.MOST_WORDS
    assert folds.shares(10, [1, 1, 1]) == [4, 3, 3] and sum(folds.shares(7, [0.2, 5, 1])) == 7


def test_word_times():
    spans = words.timed(["One ", "two ", "three "], [("one", 0.0, 1.0), ("2", 1.0, 2.0), ("three", 2.0, 3.0)])
    assert spans == [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0)]
    assert len(words.timed(["a", "b"], [])) == 2 and words.timed([], []) == []


def test_epub_round_trip(spark, tmp_path):
    opf = '<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c1"/></spine></package>'
    files = [("META-INF/container.xml", b'<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'), ("OEBPS/p.opf", opf.encode()), ("OEBPS/nav.xhtml", b'<html><body><nav><a href="c1.xhtml#x">First</a></nav></body></html>'), ("OEBPS/c1.xhtml", b"<html><body><p>One <i>is. Two</i> is.</p><p>!</p></body></html>")]
    book.write_epub([*files, ("mimetype", b"")], str(tmp_path / "a.epub"))
    (tmp_path / "b.epub").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "a.epub") as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    books = {r.path.rpartition("/")[2]: r for r in book.read_books(spark, str(tmp_path)).collect()}
    assert books["a.epub"].title == "T" and books["a.epub"].error is None and books["b.epub"].error
    chapters = book.read_chapters(spark, str(tmp_path)).collect()
    assert [(c.chapter_id, c.name, c.spine_idx) for c in chapters] == [("c1", "First", 0)]
    xml, n = book.tag_units(chapters[0].xml, "c1")
    assert n >= 2 and xml.count('id="c1-sentence0"') == 1 and xml.count('id="c1-sentence1"') == 1
    assert book.units_of("<p>A b. C d.</p><p>E</p>") == ["A b.", "C d.", "E"]
