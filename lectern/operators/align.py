"""Sequential alignment of a chapter's units to a transcript."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import SYMBOLS
from lectern.operators.similarity import nearest_match

# Sentences looked at ahead by a long and a short unit, places tried before units are given up, characters of a short unit, units tried at a place.
AHEAD, AHEAD_SHORT, TRIES, TRIES_SHORT, TOO_SHORT, TOGETHER = 10, 3, 30, 2, 3, 3
# Lengths of windows, in lengths of the unit, and how much rather a window is too long than too short.
WINDOWS, TOO_LONG = (1.5, 3, 7), 1.2
#: Characters of the pieces that stand for a text in the quick test before edits are counted.
Q = 3
#: Spine numbers in a range of chapters.
SPINE = 4096
ALIGNED = "chapter_id {id}, unit_id int, text string, match_type string, match_text string, off_start long, off_end long"

_ends = re.compile(r"^[\W_]+|[\W_]+$")
_marks = re.compile(r"[^\w\s]|_")
_blank = re.compile(rf"[\s{re.escape(SYMBOLS)}]|[^\w\s]")


def plain(text: str) -> str:
    return " ".join(_marks.sub("", text.lower()).split())


def matched(query: str, text: str, drift: int, fuzzy: bool) -> tuple[str, int, int] | None:
    """(kind, start, end) of the query at or, within the edit budget, near the head of the text."""
    if text.startswith(query):
        return "exact", 0, len(query)
    if text.startswith(" " + query):
        return "trimmedLeading", 1, 1 + len(query)
    bare, lead = _ends.sub("", query), len(text) - len(re.sub(r"^[\W_]+", "", text))
    if bare and text.startswith(bare, lead):
        return "ignoringEndsPunctuation", lead, lead + len(bare)
    key = plain(query)
    if key:
        end = prefix_end(key, text)
        if end:
            return "ignoringAllPunctuation", 0, end
    if fuzzy:
        budget = max(1, max(len(query) // 4, 1) // (drift + 1))
        got = nearest_match(query, text, budget)
        if got:
            return "nearest", got[1], got[1] + len(got[0])
    return None


def prefix_end(key: str, text: str) -> int:
    """Where the text, read without punctuation and with single blanks, has gone through the key; 0 if it doesn't begin so."""
    want, i = key.replace(" ", ""), 0
    for j, c in enumerate(text.lower()):
        if _marks.match(c) or c.isspace():
            continue
        if c != want[i]:
            return 0
        i += 1
        if i == len(want):
            return j + 1
    return 0


def grams(text: str) -> set[str]:
    return {text[i : i + Q] for i in range(len(text) - Q + 1)}


class Heard:
    """A transcript's sentences, lower-cased, with their lengths so far and their grams."""

    def __init__(self, heard: list[tuple[str, int]]):
        self.raw, self.first = [t for t, _ in heard], [at for _, at in heard]
        self.text = [t.lower() for t in self.raw]
        self.upto = [0]
        for t in self.text:
            self.upto.append(self.upto[-1] + len(t))
        self.grams = [grams(t) for t in self.text]
        self.joints = [grams(f"{a[-Q + 1:]} {b[: Q - 1]}") for a, b in zip(self.text, self.text[1:], strict=False)]

    def windows(self, at: int, cut: int, length: int, most: int) -> list[int]:
        """Numbers of sentences from `at` on, `cut` characters in, whose text comes nearest to each of the WINDOWS; rising, without repeats."""
        top = min(len(self.text) - at, most)
        size = lambda n: self.upto[at + n] - self.upto[at] - cut
        out: list[int] = []
        for times in WINDOWS:
            target = int(length * times)
            n = min(bisect_right(self.upto, target + self.upto[at] + cut, at, at + top + 1) - at - 1, top)  # as many as stay within the target
            if n < top and (size(n) <= length or size(n + 1) - target <= (target - size(n)) * TOO_LONG):
                n += 1
            if n > 0 and (not out or n > out[-1]):
                out.append(n)
        return out

    def window(self, at: int, cut: int, n: int) -> str:
        return " ".join(self.text[at : at + n])[cut:]

    def may_hold(self, pieces: set[str], least: int, at: int, n: int) -> bool:
        """Whether so many of the pieces are in the window at all; what was cut off it counts too."""
        left = set(pieces)
        for k in range(at, at + n):
            left -= self.grams[k]
            if k + 1 < at + n:
                left -= self.joints[k]
            if len(pieces) - len(left) >= least:
                return True
        return False


class Sought:
    """A unit as it is sought: its text and the pieces of it that an occurrence with few edits must keep."""

    def __init__(self, text: str):
        self.query = " ".join(text.lower().split())
        said = _blank.sub("", self.query)
        self.empty, self.short = not said, len(said) <= TOO_SHORT
        self.pieces = grams(self.query)

    def budget(self, drift: int) -> int:
        return max(1, max(len(self.query) // 4, 1) // (drift + 1))

    def found(self, heard: Heard, at: int, cut: int, drift: int) -> tuple[str, int, int, str] | None:
        """(kind, start, end, window) in the first window that holds it, each tried by all kinds: an edit spoils Q pieces at most, so where too many are missing none are counted."""
        least = len(self.pieces) - Q * self.budget(drift)
        for n in heard.windows(at, cut, len(self.query), AHEAD_SHORT if self.short else AHEAD):
            window = heard.window(at, cut, n)
            fuzzy = not self.short and (least <= 0 or heard.may_hold(self.pieces, least, at, n))
            got = matched(self.query, window, drift, fuzzy)
            if got:
                return *got, window
            if self.short:
                return None
        return None


def align_units(units: list[tuple[int, str]], heard: list[tuple[str, int]]) -> list[tuple]:
    """Walks through units and transcript sentences (text, offset) together; (unit_id, text, kind, match, start, end), kind `skipped` without a match.

    At a place up to TOGETHER units are sought, one after another; the first that is found is taken and those before it are skipped. Where none is, the place moves on by a sentence
    and the same units are sought again; TRIES sentences beyond the last match they are given up, and the place goes back to it. A short unit is sought alone and given up
    sooner. A match moves the place past it, so matches never cross. What is empty or punctuation is skipped.
    """
    h, sought = Heard(heard), [Sought(t) for _, t in units]
    hits: dict[int, tuple] = {}
    todo = [i for i, s in enumerate(sought) if not s.empty]
    i = at = cut = good = good_cut = 0
    while i < len(todo):
        hit, used = None, 0
        for used, j in enumerate(todo[i : i + TOGETHER], 1):
            hit = sought[j].found(h, at, cut, at - good) if at < len(h.text) else None
            if hit or sought[j].short:
                break
        if not hit:
            at, cut = at + 1, 0
            short = sought[todo[i + used - 1]].short
            if at >= min(len(h.text), good + (TRIES_SHORT if short else TRIES)):
                i, at, cut = i + used, good, good_cut
            continue
        kind, a, b, window = hit
        start, end = cut + a, cut + b
        hits[todo[i + used - 1]] = kind, window[a:b], h.first[at] + start, h.first[at] + end
        while at < len(h.text) and end >= len(h.text[at]):
            end -= len(h.text[at]) + 1
            at += 1
        cut = good_cut = max(end, 0)
        good = at
        i += used
    return [(unit_id, text, *hits.get(k, ("skipped", None, None, None))) for k, (unit_id, text) in enumerate(units)]


def aligned(units: DataFrame, heard: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Units (chapter_id, unit_id, text) against transcript sentences (chapter_id, sent_idx, text, off_start): one row per unit, chapter by chapter, with the same result in any order."""
    schema = ALIGNED.format(id=units.schema[chapter].dataType.simpleString())

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("unit_id"), right.sort_values("sent_idx")
        rows = align_units(list(zip(left["unit_id"], left["text"], strict=True)), list(zip(right["text"], right["off_start"], strict=True)))
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=["chapter_id", "unit_id", "text", "match_type", "match_text", "off_start", "off_end"])
        return out.astype({"off_start": "Int64", "off_end": "Int64"})

    return units.groupBy(chapter).cogroup(heard.groupBy(chapter)).applyInPandas(run, schema)


def head_bounds(chapters: DataFrame) -> DataFrame:
    """(chapter_id, prev_off, next_off): nearest non-zero offsets that earlier and later chapters of a book (`path`, where there is one) use, by spine order.

    Chapters are taken in ranges of SPINE numbers, each range by itself; what lies before and behind a range is carried from one to the next, a row a range.
    """
    book = [c for c in ("path",) if c in chapters.columns]
    part = [*book, "_r"]
    d = chapters.withColumns({"_u": F.nullif(F.col("off"), F.lit(0)), "_r": F.floor(F.col("spine_idx") / SPINE)})
    before, place = lambda w: w.rowsBetween(Window.unboundedPreceding, -1), F.when(F.col("_u").isNotNull(), F.struct("spine_idx"))
    ends = d.groupBy(*part).agg(F.min_by("_u", place).alias("_a"), F.max_by("_u", place).alias("_z"))
    # Both ways from the rows before: a frame that ends with the last row is read anew for each.
    up, down = (before(Window.partitionBy(*book).orderBy(o)) for o in (F.asc("_r"), F.desc("_r")))
    ends = ends.select(*[F.col(c).alias(f"_k{c}") for c in part], F.last("_z", True).over(up).alias("_prev"), F.last("_a", True).over(down).alias("_next"))
    order = Window.partitionBy(*part).orderBy("spine_idx")
    d = d.withColumns({"_i": F.row_number().over(order), "prev_off": F.last("_u", True).over(before(order))})
    d = d.withColumn("next_off", F.last("_u", True).over(before(Window.partitionBy(*part).orderBy(F.desc("_i")))))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in part])
    d = d.join(ends, same).withColumns({"prev_off": F.coalesce("prev_off", "_prev"), "next_off": F.coalesce("next_off", "_next")})
    return d.drop("_u", "_r", "_i", "_prev", "_next", *[f"_k{c}" for c in part])
