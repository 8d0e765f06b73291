"""Text functions as columns: sentences, words, phrases, normalisation, voice length."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that the normaliser maps to a plain one.
SINGLE_QUOTES, DOUBLE_QUOTES, HYPHENS = "‘’‚‛", "“”„‟«»〝〞", "‐‑‒–"
BAR, DASH, LEFT, RIGHT = "―", "—", "‹", "›"
# Symbols that a unit may consist of without having anything to say, besides punctuation.
SYMBOLS = "$+<=>^`|~"
# Pronouns and endings whose contractions are cut to the pronoun.
PRONOUNS, ENDINGS = ("i", "you", "he", "she", "it", "we", "they"), ("ll", "re", "ve", "d", "m")
# Characters after which a word ends, and after which a phrase may end.
WORD_ENDS, PHRASE_ENDS = " \t\n\r—,;!?|", ",:;—"
WORD = rf"[^{WORD_ENDS}]*[{WORD_ENDS}]+|[^{WORD_ENDS}]+"
# Number words and the value of each Roman digit.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred"))
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def once(value: Column, then) -> Column:
    """then(value) with the value computed once: a lambda would compute what it refers to again for each element."""
    return F.transform(F.array(value), then)[0]


def sentences(text: Column) -> Column:
    """Split after runs of . ! ? that blanks follow; the marks stay, the blanks go, and so do spaces of any kind at both ends of the text."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\A\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", ""), r"([.!?]+)[ \n\t\r]+", "$1\u0001"), "\u0001")


def unspoken(text: Column) -> Column:
    """Nothing but blanks, punctuation and symbols."""
    return F.length(F.regexp_replace(text, rf"[\s\p{{P}}{re.escape(SYMBOLS)}]", "")) == 0


def all_punctuation(text: Column) -> Column:
    return text.rlike(r"\A[ \t\n\f\r\p{P}]*\z")


def words(text: Column) -> Column:
    """Words with their delimiters on them, so that they concatenate to the text; pieces without a word join the one before, leading ones the next."""
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        join = (F.size(acc) > 0) & (all_punctuation(p) | all_punctuation(last))
        return F.when(join, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pieces, F.array().cast("array<string>"), add)


def count_words(text: Column) -> Column:
    """How many words there are, without building them; a text of punctuation alone is one, an empty one none."""
    spoken = F.size(F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda p: ~all_punctuation(p)))
    return F.greatest(spoken, F.when(F.length(text) > 0, 1).otherwise(0))


def phrases(words_: Column) -> Column:
    """Words joined into phrases: one ends after a word with a phrase mark, blanks and line breaks behind it or none, once it has two words and over two words remain."""
    return once(words_, _phrases)


def _phrases(words_: Column) -> Column:
    n = F.size(words_)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(0).alias("k"), F.lit(0).alias("i"))

    def add(s: Column, w: Column) -> Column:
        over = (s["k"] + 1 >= 2) & (s["i"] < n - 2) & w.rlike(rf"[{PHRASE_ENDS}][ \t\n\f\r]*\z")
        joined = F.concat(s["open"], w)
        return F.struct(F.when(over, F.concat(s["out"], F.array(joined))).otherwise(s["out"]).alias("out"), F.when(over, "").otherwise(joined).alias("open"), F.when(over, 0).otherwise(s["k"] + 1).alias("k"), (s["i"] + 1).alias("i"))

    return F.aggregate(words_, state, add, lambda s: F.when(s["open"] != "", F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]))


def tokens(text: Column) -> Column:
    """Lower-cased blank-separated words."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")


def ngrams(words_: Column, n: int) -> Column:
    """(pos, gram) of every n consecutive words; none in a shorter list."""

    def cut(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.array_join(F.slice(w, i, F.lit(n)), " ").alias("gram")))

    return once(words_, cut)


def gram_offsets(words_: Column, n: int) -> Column:
    """(pos, off) of every n consecutive words: the word and, with single blanks between words, the character at which they begin."""
    lengths = lambda w: F.transform(w, lambda x: F.length(x) + 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    upto = lambda w: F.aggregate(lengths(w), start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    return once(words_, lambda w: F.transform(F.slice(upto(w), F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0))), lambda off, i: F.struct(i.alias("pos"), off.alias("off"))))


def occurrences(text: Column, needle: str) -> Column:
    """Every place, overlapping ones too, at which the text has the needle: a lookahead cuts the text at each, and the pieces' lengths add up to them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    pieces = F.split(text, f"(?={re.escape(needle)})", -1)
    places = F.aggregate(pieces, start, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    # A cut at the very beginning leaves no empty piece before it.
    return F.when(F.startswith(text, F.lit(needle)), places).otherwise(F.slice(places, F.lit(2), F.size(pieces)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{P}", "")


def plain_punctuation(text: Column) -> Column:
    """Quotes, hyphens and dashes in one form each; two hyphens are a dash."""
    mapped = F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES + HYPHENS + BAR + LEFT + RIGHT, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(HYPHENS) + DASH + "<>")
    return F.replace(mapped, F.lit("--"), F.lit(DASH))


def contraction_stems(text: Column) -> Column:
    return F.regexp_replace(text, rf"\b({'|'.join(PRONOUNS)})'({'|'.join(ENDINGS)})\b", "$1")


def voice_length100(text: Column) -> Column:
    """Hundredths of voice length: a blank is .01, a comma 2, an end mark or digit 3, all else 1."""
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    return (F.length(text) * 100 - count(" ") * 99 + count(",") * 100 + count("[.!?0-9]") * 200).cast("long")


def roman_value(word: Column) -> Column:
    """The value of two or more capital Roman digits, well-formed or not; else null."""
    digits = F.transform(F.reverse(F.split(word, "")), lambda c: reduce(lambda e, kv: F.when(c == kv[0], kv[1]).otherwise(e), ROMAN.items(), F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    total = F.aggregate(digits, start, lambda a, d: F.struct(F.when(d < a["most"], a["sum"] - d).otherwise(a["sum"] + d).alias("sum"), F.greatest(a["most"], d).alias("most")), lambda a: a["sum"])
    return F.when(word.rlike("^[IVXLCDM]{2,}$"), total)


def spell(n: int) -> str:
    """English cardinal without `and`."""
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")
    for size, name in SCALES:
        if n >= size:
            return f"{spell(n // size)} {name}" + (f" {spell(n % size)}" if n % size else "")
    raise ValueError(n)


_core = re.compile(r"^(\W*?)(?:((?:\d+(?:,\d{3})+|\d+)(?:\.\d+)*|(?:\.\d+)+|[IVXLCDM]{2,})(%?)|(%))((?:[^\w%].*)?)$", re.S)


def spelled_word(word: str | None) -> str | None:
    """A number, Roman or decimal or percentage, in words, with what stands around it; other words, and numbers of over 15 digits, as they are."""
    m = _core.match(word) if word is not None else None
    if not m:
        return word
    lead, body, percent, alone, tail = m.groups()
    out = []
    if body and body[0] in ROMAN:
        total = most = 0
        for d in (ROMAN[c] for c in reversed(body)):
            total, most = (total - d if d < most else total + d), max(most, d)
        out.append(spell(max(total, 0)))
    elif body:
        parts = body.replace(",", "").split(".")
        if any(len(p) > 15 for p in parts):
            return word
        out.append(" point ".join(spell(int(p)) if p else "" for p in parts).strip())
    if percent or alone:
        out.append("percent")
    return lead + " ".join(out) + tail


@F.pandas_udf(T.StringType())
def spelled(word: pd.Series) -> pd.Series:
    return word.map(spelled_word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def spelled_all(words_: pd.Series) -> pd.Series:
    """Each word's number spelled; blanks around a word stay."""

    def one(w: str) -> str:
        core = w.strip()
        return w.replace(core, spelled_word(core) or "", 1) if core else w

    return words_.map(lambda ws: None if ws is None else [one(w) for w in ws])


def alignment_key(text: Column) -> Column:
    return F.trim(without_punctuation(F.lower(plain_punctuation(text))))


def chunks(text: Column, least: int) -> Column:
    """Cut at the first blank at or after `least` characters; a blank tail joins the chunk before."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{{least},}}?[ \t\n\r]+|.+$)"), F.lit(1))
    return F.filter(cut, lambda c: F.length(c) > 0)


def escaped(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), text)


def clamped(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end), both moved into the text."""
    lo = F.greatest(F.least(start, F.length(text)), F.lit(0))
    return F.substring(text, (lo + 1).cast("int"), F.greatest(F.least(end, F.length(text)) - lo, F.lit(0)).cast("int"))


def head(text: Column, n: int = 128) -> Column:
    return F.left(text, F.lit(n))


def tail(text: Column, n: int = 128) -> Column:
    return F.right(text, F.lit(n))


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def starts_blank(text: Column) -> Column:
    return text.rlike(r"^\s")


def ends_blank(text: Column) -> Column:
    return text.rlike(r"\s\z")


def all_digits(text: Column) -> Column:
    return text.rlike(r"^[0-9]+\z")


def has_text(text: Column) -> Column:
    return text.rlike(r"\S")


def relative_path(path: Column, base: Column) -> Column:
    """The way from the folder `base` to the path, both with `/` between names and without one at the end."""

    def way(p: Column) -> Column:
        common = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p["b"]), F.lit(1))), lambda i: F.slice(p["a"], F.lit(1), i) == F.slice(p["b"], F.lit(1), i)), lambda same: same))
        common = F.when(F.size(p["b"]) == 0, 0).otherwise(F.least(common, F.size(p["a"])))
        return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(p["b"]) - common), F.slice(p["a"], common + 1, F.size(p["a"]))), "/")

    names = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    return once(F.struct(names(path).alias("a"), names(base).alias("b")), way)


#: Tokens of a speech recogniser that say nothing, beside all that begin with `[_`.
SPECIAL = ("<unk>",)


def special_token(token: Column) -> Column:
    return F.startswith(token, F.lit("[_")) | token.isin(*SPECIAL)


def without_fragment(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def is_separator(c: Column) -> Column:
    """Blank or punctuation, but for what may stand inside a word."""
    return c.rlike(r"^[\s\p{P}]$") & ~c.isin("'", "-", ".", "%", "·", "•")


def text_of_html(html: Column) -> Column:
    """Body text: a line ends after each block, tags and scripts go, the five entities are resolved."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>|</body>.*$", "")
    body = F.regexp_replace(body, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    body = F.regexp_replace(body, r"(?i)</(p|div|h[1-6]|li|ul|ol|tr|td|table|section|article|nav|blockquote|header|footer)>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    body = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")), body)
    return F.trim(F.regexp_replace(body, r"\n+", "\n"))
