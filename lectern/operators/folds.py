"""Operators whose next row depends on what the last one became: one group at a time, as plain Python over its rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Seconds of a shared and a short span; words at most in a group.
TAIL, NUDGE, SHORT, MOST_WORDS = 0.25, 0.001, 0.19, 64
# Function words that lean on the word after them, and other function words.
LEANING = frozenset(("to", "of", "in", "on", "at", "by", "for", "from", "as", "with", "into", "than", "then", "that"))
NEUTRAL = frozenset((
    "a", "an", "the", "and", "or", "but", "this", "those", "these", "is", "am", "are", "was", "were", "be", "been", "being", "he", "she",
    "it", "its", "his", "her", "their", "our", "your", "my", "me", "him", "them", "us", "you", "i",
))
# Marks that end a group; seconds of a short word, of a pause and of a group that is long enough, each also where times are unreliable; what makes a time unreliable or reliable again.
MARKS = (".", "?", "!", ";", ":", "—", ",")
SHORT_WORD, PAUSE, PAUSE_UNSURE, LONG, LONG_UNSURE = 0.3, 0.1, 0.35, 0.6, 2.0
UNSURE_FOR, UNSURE_AT, SURE_FOR, SURE_AT = 0.04, 0.0, 0.25, 0.4


def per_group(df: DataFrame, keys: list[str], order: list[str], fold, schema) -> DataFrame:
    """Applies a fold over dicts to each group's ordered rows; the groups are the units of parallel work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable").to_dict("records")
        return pd.DataFrame(fold(rows), columns=schema.names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def repaired(rows: list[dict]) -> list[dict]:
    """No row starts before the one before it ends, as repaired; an empty one gets a thousandth of a second."""
    last, out = float("-inf"), []
    for r in rows:
        start = max(r["start"], last)
        end = max(r["end"], start)
        if end <= start:
            end = start + NUDGE
        out.append({**r, "start": start, "end": end})
        last = end
    return out


def spread(rows: list[dict], weight=lambda r: max(len(r["token"].strip()), 1)) -> list[dict]:
    """Runs of equal spans share the time from where the last row ended to where the next one starts, by weight."""
    out: list[dict] = []
    i = 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and (rows[j + 1]["start"], rows[j + 1]["end"]) == (rows[i]["start"], rows[i]["end"]):
            j += 1
        run = rows[i : j + 1]
        if len(run) == 1:
            out.append(dict(run[0]))
        else:
            lo = max(out[-1]["end"], 0) if out else rows[i]["start"]
            hi = max(rows[j + 1]["start"] if j + 1 < len(rows) else rows[i]["end"], lo)
            total, at = sum(map(weight, run)), lo
            for r in run:
                to = at + (hi - lo) * weight(r) / total
                out.append({**r, "start": at, "end": to})
                at = to
        i = j + 1
    return out


def given_time(rows: list[dict], weight=lambda r: max(len(r["token"].strip()), 1)) -> list[dict]:
    """Rows without duration: the window around them grows, right first, until it has time, which its rows then share by weight."""
    out = [dict(r) for r in rows]
    for i in range(len(out)):
        if out[i]["end"] > out[i]["start"]:
            continue
        lo = hi = i
        while out[hi]["end"] <= out[lo]["start"]:
            if hi + 1 < len(out):
                hi += 1
            elif lo > 0:
                lo -= 1
            else:
                break
        a, z = out[lo]["start"], out[hi]["end"]
        total, at = sum(weight(r) for r in out[lo : hi + 1]), a
        for r in out[lo : hi + 1]:
            to = at + (z - a) * weight(r) / total
            r["start"], r["end"] = at, to
            at = to
    return out


def bare(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum() or c == "'").strip("'")


def ends_group(word: str) -> bool:
    return word.rstrip().endswith(MARKS)


class _Unsure:
    """Whether times are unreliable just now: so from a word that hardly lasts or has no confidence (but for a segment's first), until two reliable ones meet."""

    def __init__(self):
        self.on = False

    def meets(self, a: dict, b: dict, a_first: bool, b_first: bool) -> bool:
        """Takes in neighbours a and b; true if either is unreliable."""
        doubt = any(x["end"] - x["start"] <= UNSURE_FOR or not first and x.get("time_conf", 1.0) <= UNSURE_AT for x, first in ((a, a_first), (b, b_first)))
        sure = all(x["end"] - x["start"] >= SURE_FOR and x.get("time_conf", 1.0) >= SURE_AT for x in (a, b))
        self.on = doubt or self.on and not sure
        return doubt


def _joins(a: dict, b: dict, length: float, n: int, unsure: bool, doubt: bool) -> bool:
    """Whether word b goes on with the group of n words that ends with a; `length` is the group's with b."""
    if n >= MOST_WORDS and not b.get("interpolated") or a.get("track") != b.get("track") or a.get("segment") != b.get("segment"):
        return False
    spans = [max(x["end"] - x["start"], 0.0) for x in (a, b)]
    if ends_group(a["token"]) and min(spans) > 0:
        return False
    if doubt or a.get("interpolated") or b.get("interpolated"):
        return True
    if not 0 <= round(b["start"] - a["end"], 9) <= (PAUSE_UNSURE if unsure else PAUSE) or length >= (LONG_UNSURE if unsure else LONG):
        return False
    function = {bare(a["token"]), bare(b["token"])} & (LEANING | NEUTRAL)
    return sum(spans) < LONG or min(spans) < SHORT_WORD and bool(function or unsure)


def word_groups(rows: list[dict]) -> list[dict]:
    """Words (token, start, end; also time_conf, segment, track and interpolated where there are) into spoken phrases.

    Neighbours join while they are short, or one is short and one a function word, until the group is long enough, a pause or a mark comes, or MOST_WORDS are
    reached. Where times are unreliable pauses and lengths may be longer, and unreliable or interpolated words always join. Then short groups join the neighbour with which they come
    closest to SHORT, and a last word that leans on the next one, or follows a mark, moves on where both groups stay long enough.
    """
    groups: list[list[dict]] = []
    state = _Unsure()
    for i, r in enumerate(rows):
        if groups:
            g, last = groups[-1], rows[i - 1]
            first = lambda k: k == 0 or rows[k - 1].get("segment") != rows[k].get("segment")
            if len(g) == 1:
                state = _Unsure()
            doubt = state.meets(last, r, first(i - 1), first(i))
            if _joins(last, r, r["end"] - g[0]["start"], len(g), state.on, doubt):
                g.append(r)
                continue
        groups.append([r])
    groups = _short_joined(groups)
    for a, b in zip(groups, groups[1:], strict=False):
        if len(a) > 1 and (bare(a[-1]["token"]) in LEANING or ends_group(a[-2]["token"])):
            moved = max(a[-1]["end"] - a[-1]["start"], 0.0)
            if a[-1]["end"] - a[0]["start"] - moved >= SHORT and b[-1]["end"] - b[0]["start"] + moved >= SHORT:
                b.insert(0, a.pop())
    return [{**{k: v for k, v in g[0].items() if k not in ("token", "start", "end")}, "group_idx": i, "token": "".join(w["token"] for w in g), "start": g[0]["start"], "end": g[-1]["end"], "n_words": len(g)} for i, g in enumerate(groups)]


def _short_joined(groups: list[list[dict]]) -> list[list[dict]]:
    """Each short group joins, first to last: the one before it, as it has become, or the next, whichever alone reaches SHORT with it, else comes closer to that."""
    length = lambda g: g[-1]["end"] - g[0]["start"]
    out: list[list[dict]] = []
    i = 0
    while i < len(groups):
        g = groups[i]
        rest = groups[i + 1] if i + 1 < len(groups) else None
        i += 1
        if length(g) >= SHORT or not out and rest is None:
            out.append(g)
            continue
        # (falls short, distance) of joining either side; the earlier one wins ties.
        sides = [((total := length(x) + length(g)) < SHORT, abs(total - SHORT)) if x is not None else (2, 0.0) for x in (out[-1] if out else None, rest)]
        if sides[0] <= sides[1]:
            out[-1] = out[-1] + g
        else:
            out.append(g + rest)
            i += 1
    return out


def shares(total: int, weights: list[float]) -> list[int]:
    """Largest remainders: whole numbers that sum to the total, ties to the earlier."""
    whole = sum(weights) or 1
    exact = [total * w / whole for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (-(exact[i] - out[i]), i))[: total - sum(out)]:
        out[i] += 1
    return out
