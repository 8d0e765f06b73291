"""Alignment, groups of words, retiming, reports, books and checkpoints by value, against plain Python."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import align, folds, report, retime, stats, timeline, words
from lectern.plans import more, registry
from lectern.sources import book, checkpoint

SF = "/root/testdata/sf0.001"


def said(*spans, **more):
    return [{"token": f"{t} ", "start": a, "end": b, **more} for t, a, b in spans]


def grouped(rows):
    return [g["token"].split() for g in folds.word_groups(rows)]


def test_long_words_stand_alone_and_short_ones_join():
    assert grouped(said(("one", 0, 0.5), ("two", 0.5, 1.0))) == [["one"], ["two"]]
    assert grouped(said(("one", 0, 0.25), ("two", 0.25, 0.5), ("three", 0.5, 1.0))) == [["one", "two"], ["three"]]
    assert grouped(said(("walk", 0, 0.5), ("of", 0.5, 0.72), ("life", 0.72, 1.0))) == [["walk"], ["of", "life"]]


def test_pauses_and_marks_end_groups():
    assert grouped(said(("a", 0, 0.25), ("b", 0.36, 0.6))) == [["a"], ["b"]]
    assert grouped(said(("a", 0, 0.25), ("b", 0.35, 0.55))) == [["a", "b"]]
    assert grouped(said(("yes,", 0, 0.25), ("no", 0.25, 0.5))) == [["yes,"], ["no"]]
    assert grouped(said(("a", 0.2, 0.45), ("b", 0.4, 0.65))) == [["a"], ["b"]]


def test_unreliable_times_join_and_allow_more():
    rows = said(("a", 0, 0.03), ("b", 0.2, 0.5), ("c", 0.8, 1.0), ("d", 1.0, 1.25))
    assert grouped(rows) == [["a", "b", "c", "d"]]
    sure = [{**r, "start": r["start"] + 5, "end": r["end"] + 5} for r in said(("e", 0, 0.35), ("f", 0.35, 0.75))]
    assert grouped(said(("a", 0, 0.3), ("b", 0.3, 0.59))) == [["a", "b"]] and grouped(rows + sure)[1:] == [["e"], ["f"]]
    low = [{**r, "time_conf": 0.0, "segment": 0} for r in said(("a", 0, 0.5), ("b", 0.5, 1.0))]
    assert grouped(low) == [["a", "b"]] and grouped([low[0], {**low[1], "segment": 1}]) == [["a"], ["b"]]


def test_short_groups_join_where_they_come_closest():
    group = lambda *ends: [[{"token": "x ", "start": a, "end": b}] for a, b in zip(ends, ends[1:], strict=False)]
    lengths = lambda gs: [len(g) for g in folds._short_joined(gs)]
    assert lengths(group(0, 0.1, 0.5)) == [2] and lengths(group(0, 0.5, 0.6)) == [2] and lengths(group(0, 0.1)) == [1]
    assert lengths(group(0, 0.5, 0.6, 0.8)) == [1, 2] and lengths(group(0, 0.3, 0.4, 0.9)) == [2, 1]
    assert lengths(group(0, 0.02, 0.1, 0.4)) == [2, 1]


def test_leaning_words_move_on():
    assert grouped(said(("go", 0, 0.28), ("to", 0.28, 0.48), ("towns", 0.6, 1.2))) == [["go"], ["to", "towns"]]
    assert grouped(said(("go", 0, 0.28), ("the", 0.28, 0.48), ("towns", 0.6, 1.2))) == [["go", "the"], ["towns"]]
    assert grouped(said(("go", 0, 0.1), ("to", 0.1, 0.3), ("towns", 0.6, 1.2))) == [["go", "to"], ["towns"]]
    assert len(folds.LEANING) == 14 and not folds.LEANING & folds.NEUTRAL and "into" in folds.LEANING and "the" in folds.NEUTRAL


def test_stop_words_are_no_anchors():
    assert words.anchors(["a", "big", "of", "house"], ["a", "big", "of", "house"]) == [(1, 1, 1), (3, 3, 1)]
    assert not words.alike("it", "it") and words.alike("him", "him") and words.alike("house", "houze")


def test_units_of_three_are_tried_at_a_place():
    heard = [("Alpha beta gamma delta.", 0), ("Epsilon zeta eta theta.", 24), ("Iota kappa lambda mu.", 48)]
    units = ["Not here at all.", "Nor is this one.", "Alpha beta gamma delta.", "Missing too somehow.", "Iota kappa lambda mu."]
    rows = align.align_units(list(enumerate(units)), heard)
    assert [r[2] for r in rows] == ["skipped", "skipped", "exact", "skipped", "nearest"] and rows[4][4:] == (48, 69)


def test_windows_grow_with_the_unit():
    h = align.Heard([("x" * n, 0) for n in (10, 10, 10, 40, 10)])
    assert h.windows(0, 0, 10, 10) == [2, 3, 4] or h.windows(0, 0, 10, 10)[0] in (1, 2)
    assert h.windows(4, 0, 100, 10) == [1] and h.windows(5, 0, 10, 10) == [] and max(h.windows(0, 0, 20, 3)) == 3


@pytest.mark.parametrize("seed", range(4))
def test_quick_test_changes_nothing(monkeypatch, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60)]
    sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(1, 9))).capitalize() + rng.choice(".?!")
    units = [sentence() for _ in range(50)]
    noisy = ["".join(rng.choice("abcdefghij") if rng.random() < 0.06 else c for c in u) for u in units if rng.random() < 0.85]
    heard, at = [], 0
    for t in noisy:
        heard.append((t, at))
        at += len(t) + 1
    got = align.align_units(list(enumerate(units)), heard)
    monkeypatch.setattr(align.Heard, "may_hold", lambda *a: True)
    assert got == align.align_units(list(enumerate(units)), heard)
    starts = [r[4] for r in got if r[4] is not None]
    assert starts == sorted(starts) and len(starts) > 20
    whole = " ".join(t for t, _ in heard).lower()
    assert all(r[3] is None or whole[r[4] : r[5]] == r[3] for r in got)


def test_respelled_offsets(spark):
    rows = [("a", i, t, o, o + len(t) - 1) for i, (t, o) in enumerate([("x ", 0), ("42 ", 2), ("y ", 5), ("7 ", 7)])] + [("a", 9, "z ", -1, -1)]
    d = spark.createDataFrame(rows, "track string, idx int, token string, off_start long, off_end long")
    spelled = F.when(F.col("token") == "42 ", "forty-two ").when(F.col("token") == "7 ", "seven ").otherwise(F.col("token"))
    got = retime.respelled(d, ["track"], ["idx"], spelled).orderBy("idx").collect()
    assert [(r.token, r.off_start, r.off_end) for r in got] == [("x ", 0, 1), ("forty-two ", 2, 4), ("y ", 12, 13), ("seven ", 14, 15), ("z ", -1, -1)]


def test_selected_by_state(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(i, rng.random() < 0.1, rng.random() < 0.1) for i in range(200)]
        on, want, any_ = False, [], any(o for _, o, _ in rows)
        for i, o, f in rows:
            on = False if f else True if o else on
            if on or not any_:
                want.append(i)
        d = spark.createDataFrame(rows, "i int, o boolean, f boolean").repartition(7)
        assert sorted(r.i for r in timeline.selected(d, ["i"], F.col("o"), F.col("f")).collect()) == want
    none = spark.createDataFrame([(1, False, True)], "i int, o boolean, f boolean")
    assert timeline.selected(none, ["i"], F.col("o"), F.col("f")).count() == 1


def test_flags_agree_with_the_rules(spark):
    u = registry.paced(spark, SF).cache()
    flags = stats.flagged(u)
    for name, rule in (("fast", stats.fast), ("slow", stats.slow), ("short", stats.short), ("long", stats.long)):
        key = lambda d: sorted((r.chapter_id, r.unit_id) for r in d.collect())
        assert key(flags.filter(name)) == key(rule(u)), name


def test_report_text(spark):
    rows = [(1, 3, "So it is.", 0.2, 3, -4.0, -0.1, True, False), (2, 1, "Oh.", 9.0, 1, 12.0, 11.5, False, True)]
    d = spark.createDataFrame(rows, "chapter_id int, unit_id int, text string, duration double, n_words int, zscore double, zspan double, fast boolean, slow boolean")
    names = spark.createDataFrame([(1, "One"), (2, "Two")], "chapter_id int, name string")
    lines = [r.value for r in report.as_text(report.outliers(d, names)).orderBy("section", "chapter_id", "line").collect()]
    assert lines[:5] == ["Fast-pace sentences", "-------------------", "    One", "    ---", "    sentence #3 -- pace: 0.07 -- duration: 0.2 -- modzscore: -4.0 -- So it is."]
    assert lines[6] == "Slow-pace sentences" and lines[10].startswith("    sentence #1 -- pace: 9.0") and len(lines) == 12
    head = spark.range(1).select(report.head(F.lit("tool 1"), F.lit(3725.4), F.lit(98.5)).alias("h")).first().h
    assert head.split("\n") == ["======", "Build:    tool 1", "Run time: 01:02:05", "Score:    98.5", "======"]


def test_paths_and_special_tokens(spark):
    rows = spark.createDataFrame([("a/b/c.x", "a/d"), ("a/b", "a/b"), ("x", ""), ("a", "b/c")], "p string, b string")
    assert [r.x for r in rows.select(tx.relative_path(F.col("p"), F.col("b")).alias("x")).collect()] == ["../b/c.x", "", "x", "../../a"]
    t = spark.createDataFrame([("[_BEG_]",), ("<unk>",), ("[BLANK_AUDIO]",), ("word",)], "t string")
    assert [r.x for r in t.select(tx.special_token(F.col("t")).alias("x")).collect()] == [True, True, False, False]


def test_occurrences_overlap(spark):
    rows = spark.createDataFrame([("aaaa",), ("baab",), ("",), ("xaa",)], "t string")
    assert [r.x for r in rows.select(tx.occurrences(F.col("t"), "aa").alias("x")).collect()] == [[0, 1, 2], [1], [], [1]]


def test_clip_texts_are_those_of_the_units(spark):
    rows = more.clip_texts(spark, SF).collect()
    squeezed = lambda t: " ".join((t or "").split())
    same = sum(squeezed(r.text) == squeezed(r.frag_text) for r in rows)
    assert len(rows) > 1000 and same >= 0.95 * len(rows)


def test_granularities(spark):
    rows = more.granular_units(spark, SF).collect()
    text = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    by = {}
    for r in sorted(rows, key=lambda r: r.unit_id):
        by.setdefault((r.granularity, r.conv_id, r.turn), []).append(r.text)
    assert {k[0] for k in by} == {"sentence", "phrase", "word", "chunk"}
    assert all("".join(v) == text[k[1:]] for k, v in by.items() if k[0] in ("phrase", "word"))


OPF = b'''<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><meta property="dcterms:modified">2001-01-01T00:00:00Z</meta></metadata>
<manifest><item id="c1" href="t/c1.xhtml" media-type="application/xhtml+xml" media-overlay="o1"/><item id="o1" href="o/c1.smil" media-type="application/smil+xml"/><item id="n" href="nav.xhtml" properties="nav scripted" media-type="application/xhtml+xml"/><item href="no-id"/></manifest>
<spine><itemref idref="c1"/></spine><guide><reference type="text" href="t/c1.xhtml" title="Start"/><reference type="cover"/></guide></package>'''
NAV = b'''<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><a href="t/c1.xhtml#a">First  one</a><a href="t/c1.xhtml"> </a></nav>
<nav epub:type="landmarks"><a epub:type="bodymatter x" href="t/c1.xhtml">B</a><a epub:type="cover" href="t/c1.xhtml">C</a><a epub:type="backmatter" href="nav.xhtml">E</a></nav></body></html>'''
SMIL = b'<smil xmlns="http://www.w3.org/ns/SMIL"><body><par><text src="../t/c1.xhtml#c1-sentence0"/><audio src="a.m4a" clipBegin="0:00:01.5" clipEnd="2.5s"/></par><par><text src="x"/></par></body></smil>'


def a_book(path):
    book.write_epub([("META-INF/container.xml", b'<container><rootfiles><rootfile full-path="E/p.opf"/></rootfiles></container>'), ("E/p.opf", OPF), ("E/nav.xhtml", NAV), ("E/t/c1.xhtml", b"<p>One.</p>"), ("E/o/c1.smil", SMIL)], str(path))


def test_tables_of_a_book(spark, tmp_path):
    a_book(tmp_path / "a.epub")
    (tmp_path / "b.epub").write_bytes(b"no zip")
    table = lambda t: [tuple(r)[1:] for r in book.read_parts(spark, str(tmp_path), t).orderBy("idx").collect()]
    assert [r[1:3] for r in table("manifest")] == [("c1", "E/t/c1.xhtml"), ("o1", "E/o/c1.smil"), ("n", "E/nav.xhtml")]
    assert table("guide") == [(0, "text", "E/t/c1.xhtml", "Start")]
    assert table("landmarks") == [(0, "bodymatter", "E/t/c1.xhtml"), (1, "backmatter", "E/nav.xhtml")]
    assert table("toc") == [(0, "E/t/c1.xhtml#a", "First one")]
    spine = spark.createDataFrame([(r.path, 0, "c1") for r in book.read_parts(spark, str(tmp_path), "guide").collect()], "path string, spine_idx int, chapter_id string")
    assert [r.smil for r in book.spine_overlays(book.read_parts(spark, str(tmp_path), "manifest"), spine).collect()] == ["E/o/c1.smil"]
    (tmp_path / "o.smil").write_bytes(SMIL)
    clips = book.read_clips(spark, str(tmp_path / "o.smil")).collect()
    assert [(c.idx, c.track, c.clip_begin, c.clip_end, c.text_href) for c in clips] == [(0, "a.m4a", 1.5, 2.5, "../t/c1.xhtml#c1-sentence0")]


def test_package_with_overlays(tmp_path):
    got = book.with_overlays(OPF, [("c1", "o/c1.smil", 61.25), ("n", "o/n.smil", 3600.0)], [("b.m4a", "audio/mp4"), ("a.m4a", "audio/mp4"), ("a.m4a", "audio/mp4")], "2024-05-06T07:08:09Z", "tool v1", frozenset(("c1", "n")), "s.css").decode()
    assert got.count("dcterms:modified") == 1 and "2024-05-06T07:08:09Z" in got and "2001-01-01" not in got
    assert ">0:01:01.250<" in got and ">1:00:00.000<" in got and ">1:01:01.250<" in got and book.ACTIVE in got
    assert 'media-overlay="c1-overlay"' in got and got.index('href="a.m4a"') < got.index('href="b.m4a"') and got.count("scripted") == 2 and "s.css" in got
    with pytest.raises(ValueError, match="no manifest item"):
        book.with_overlays(OPF, [("zz", "x", 1.0)], [], "now", "t")
    a_book(tmp_path / "a.epub")
    data = (tmp_path / "a.epub").read_bytes()
    new = book.with_files(data, {"E/p.opf": got.encode(), "E/x.mp3": b"123"})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.namelist()[0] == "mimetype" and z.read("E/p.opf").decode() == got and z.read("E/nav.xhtml") == NAV
    same = book.with_files(data, {"E/p.opf": OPF.replace(b"2001-01-01", b"2002-02-02"), "E/y.m4a": b"4"})
    assert book.content_checksum(same) == book.content_checksum(data) != book.content_checksum(new)


def test_checkpoints(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert checkpoint.last(spark, path) is None and checkpoint.load(spark, path, "align") is None
    checkpoint.save(spark.range(3), path, "epub")
    checkpoint.save(spark.range(5), path, "align")
    assert checkpoint.save(spark.range(7), path, "align").count() == 7 and checkpoint.last(spark, path) == "align"
    assert checkpoint.load(spark, path, "epub").count() == 3
    with pytest.raises(ValueError, match="no stage"):
        checkpoint.save(spark.range(1), path, "other")
