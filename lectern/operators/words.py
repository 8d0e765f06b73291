"""Words of a unit to time stamps: anchors first, then the gaps between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.text import spelled_word
from lectern.operators.folds import shares
from lectern.operators.similarity import scores

# Stamps that one word may take, and places looked ahead.
SPAN, AHEAD = 3, 6
# Words too common to be an anchor.
STOP = frozenset(("a", "an", "in", "of", "to", "or", "as", "at", "is", "be", "it", "its"))


def key(text: str) -> str:
    return "".join(c for c in (spelled_word(text.strip()) or "").lower() if c.isalnum())


def alike(a: str, b: str) -> bool:
    if not a or not b:
        return False
    if a == b:
        return a not in STOP
    allowed = max(len(a) // 4, 1)
    return len(a) >= 4 and len(b) >= 3 and abs(len(a) - len(b)) <= allowed and list(scores(a, b))[-1] <= allowed


def anchors(words: list[str], stamps: list[str]) -> list[tuple[int, int, int]]:
    """(word, first stamp, stamps) of words that sound like up to SPAN stamps together, in order; when neither is found ahead both move on."""
    w, s, out = 0, 0, []
    words, stamps = [key(x) for x in words], [key(x) for x in stamps]
    while w < len(words) and s < len(stamps):
        hit = next(((i, j, n) for i in range(AHEAD) for j in range(AHEAD) for n in range(1, SPAN + 1) if w + i < len(words) and s + j + n <= len(stamps) and alike(words[w + i], "".join(stamps[s + j : s + j + n]))), None)
        if hit is None:
            w, s = w + 1, s + 1
            continue
        i, j, n = hit
        out.append((w + i, s + j, n))
        w, s = w + i + 1, s + j + n
    return out


def timed(words: list[str], stamps: list[tuple[str, float, float]]) -> list[tuple[float, float]]:
    """A span for each word: of its anchor's stamps; between anchors one stamp each where counts agree, else shares of the gap by length."""
    if not words:
        return []
    if not stamps:
        return [(0.0, 0.0)] * len(words)
    out: list[tuple[float, float] | None] = [None] * len(words)
    marks = [(-1, -1, 1), *anchors(words, [t for t, _, _ in stamps]), (len(words), len(stamps), 1)]
    for w, s, n in marks[1:-1]:
        out[w] = (stamps[s][1], stamps[s + n - 1][2])
    for (w0, s0, n0), (w1, s1, _) in zip(marks, marks[1:], strict=False):
        gap, free = range(w0 + 1, w1), stamps[s0 + n0 if s0 >= 0 else 0 : s1]
        if not gap:
            continue
        if len(free) == len(gap):
            for w, f in zip(gap, free, strict=True):
                out[w] = f[1:]
            continue
        lo = out[w0][1] if w0 >= 0 else stamps[0][1]
        hi = out[w1][0] if w1 < len(words) else stamps[-1][2]
        ms = max(0, round((hi - lo) * 1000))
        at = lo
        for w, part in zip(gap, shares(ms, [max(len(words[w].strip()), 1) for w in gap]), strict=True):
            out[w] = (at, at + part / 1000)
            at += part / 1000
    return out


def word_stamps(words: DataFrame, stamps: DataFrame, unit: list[str]) -> DataFrame:
    """words (unit, word_idx, word) and stamps (unit, idx, token, start, end): (unit, word_idx, word, start, end), unit by unit."""
    schema = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in unit) + ", word_idx int, word string, start double, end double"

    def run(k, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("word_idx"), right.sort_values("idx")
        spans = timed(list(left["word"]), list(zip(right["token"], right["start"], right["end"], strict=True)))
        return pd.DataFrame([(*k, i, w, float(a), float(b)) for i, w, (a, b) in zip(left["word_idx"], left["word"], spans, strict=True)], columns=[*unit, "word_idx", "word", "start", "end"])

    return words.groupBy(*unit).cogroup(stamps.groupBy(*unit)).applyInPandas(run, schema)
