"""Secret scans: patterns, and a battery of randomness tests over other long tokens; DataFrame functions alone."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, stored

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the tests look at: as long as an access key or longer. The marks in it (of base64, of UUIDs, of paths and identifiers) are left out of the tests.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MARKS = r"[+/_-]"
#: Characters at least that the tests need.
LEAST = 16
#: Elements whose running sums are added up at a time.
CHUNK = 256
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by name, the first that fits: what a token of it matches, and its alphabet in order. Decimal numbers are none.
ENCODINGS = {
    "base16": (r"^(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", DIGIT + "abcdef"),
    "base26": (r"^(?:[a-z]+|[A-Z]+)$", LOWER),
    "base32": (r"^(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    "base36": (r"^(?=.*[a-zA-Z])(?:[0-9a-z]+|[0-9A-Z]+)$", DIGIT + LOWER),
    "base52": (r"^[A-Za-z]+$", UPPER + LOWER),
    "base62": (r"^(?=.*[a-zA-Z])[0-9A-Za-z]+$", UPPER + LOWER + DIGIT),
}
#: How identifiers go on from a capital, a small letter and a digit to each of these, and how they begin; the share of letters that follow no habit.
GOES = ((0.45, 0.5, 0.05), (0.1, 0.85, 0.05), (0.2, 0.2, 0.6))
BEGINS = (0.4, 0.5, 0.1)
ANY = 0.1
#: Bins of evidence for each power of e, and powers of e told apart.
BINS, MOST = 8, 700
SPAN = "array<struct<start:int,rank:int,end:int>>"
CANDIDATES = "array<struct<start:int,rank:int,end:int,evidence:double>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value evaluated once however often it is used, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running(a: Column) -> Column:
    """Exclusive running sums of an int array, in chunks so that long arrays don't take quadratic time."""
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / CHUNK).cast("int")), lambda c: total(F.slice(a, c * CHUNK + 1, F.lit(CHUNK))))
    one = lambda i, s: total(F.slice(s, F.lit(1), F.floor(i / CHUNK).cast("int"))) + total(F.slice(a, F.floor(i / CHUNK).cast("int") * CHUNK + 1, F.pmod(i, F.lit(CHUNK))))
    return let(chunks, lambda s: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: one(i, s)))


def matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans, in code points, of the leftmost matches that do not overlap and whose group has `least` characters or more.

    The pieces between matches and the matches take turns, so the running sums of their lengths are the positions.
    """
    lens = lambda a: F.transform(a, F.length)
    both = F.struct(lens(F.split(text, pattern, -1)).alias("gap"), lens(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("hit"), lens(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("part"))

    def placed(b: Column) -> Column:
        step = F.transform(b["hit"], lambda h, i: h + F.get(b["gap"], i))
        start = let(step, running)
        spans = let(start, lambda s: F.transform(b["hit"], lambda h, i: F.struct((F.get(s, i) + F.get(b["gap"], i)).alias("start"), F.lit(rank).alias("rank"), (F.get(s, i) + F.get(b["gap"], i) + h).alias("end"))))
        return F.filter(spans, lambda x, i: F.get(b["part"], i) >= least)

    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(SPAN))


def upper_tail(z: Column) -> Column:
    """The normal distribution's mass beyond z, by a logistic curve that is right to 2e-4."""
    return 1 / (1 + F.exp(z * 1.5976 + z * z * z * 0.07056))


def encoding(token: Column) -> tuple[Column, Column]:
    """(alphabet, its size) of the first encoding that fits; empty and 0 without one."""
    size, code = F.lit(0), F.lit("")
    for pattern, alphabet in reversed(ENCODINGS.values()):
        hit = token.rlike(pattern)
        size, code = F.when(hit, len(alphabet)).otherwise(size), F.when(hit, F.lit(alphabet)).otherwise(code)
    return code, size


def folded(token: Column, code: Column) -> Column:
    """The token in the case of its alphabet."""
    return F.when(code.isin(DIGIT + "abcdef", LOWER, DIGIT + LOWER), F.lower(token)).otherwise(token)


def battery(token: Column) -> Column:
    """The p-value that the token's characters are independent and uniform over its inferred encoding's alphabet: thrice the least of
    a chi-squared, a runs and a serial-correlation test. 0 where there is no encoding or too little to test."""
    code, size = encoding(token)
    chars = F.split(folded(token, code), "")

    def tests(x: Column) -> Column:
        n, a = F.size(x["c"]).cast("double"), x["a"].cast("double")
        squares = F.aggregate(F.transform(F.array_distinct(x["c"]), lambda d: F.pow(F.size(F.filter(x["c"], lambda y: y == d)).cast("double"), 2)), F.lit(0.0), lambda s, y: s + y)
        df = a - 1
        chi = (F.pow((squares * a / n - n) / df, 1 / 3) - (1 - 2 / (9 * df))) * F.sqrt(9 * df / 2)
        next_ = F.slice(x["c"], 2, F.size(x["c"]) - 1)
        mine = F.slice(x["c"], 1, F.size(x["c"]) - 1)
        mean, var = (a - 1) / 2, (a * a - 1) / 12
        turns = F.aggregate(F.zip_with(mine, next_, lambda p, q: F.when((p > mean) != (q > mean), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, y: s + y)
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.aggregate(F.zip_with(mine, next_, lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, y: s + y) / var / F.sqrt(n - 1)
        return F.least(F.lit(1.0), 3 * F.least(upper_tail(F.greatest(chi, F.lit(-8.0))), 2 * upper_tail(F.abs(runs)), 2 * upper_tail(F.abs(serial))))

    codes = F.transform(chars, lambda c: F.position(c, code) - 1)
    return F.when((size > 0) & (F.length(token) >= LEAST), let(F.struct(codes.alias("c"), size.alias("a")), tests)).otherwise(0.0)


def language(texts: DataFrame, text_col: str = "text") -> list[float]:
    """Log probabilities of a letter after each letter, 26 rows of 26, and at a word's start, one row more, from all words of all texts.

    Words are counted before their letters are; 702 numbers come to the driver. A share of ANY goes to all letters alike, and so does everything where there are no words.
    """
    words = texts.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    at = F.transform(F.split("w", ""), lambda c: F.ascii(c) - 97)
    pairs = F.zip_with(F.concat(F.array(F.lit(26)), at), at, lambda p, c: p * 26 + c)  # the last has no letter behind it: null
    seen = words.select(F.explode(pairs).alias("pair"), "n").filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = [0] * 27 * 26
    for r in seen:
        n[r.pair] = r.n
    row = [sum(n[26 * i : 26 * i + 26]) for i in range(27)]
    return [math.log((1 - ANY) * n[i] / row[i // 26] + ANY / 26) if row[i // 26] else -math.log(26) for i in range(27 * 26)]


def evidence(token: Column, habits: list[float]) -> Column:
    """The log of how much likelier the token is as characters drawn uniformly from its encoding's alphabet than as an identifier.

    An identifier goes from small letters to capitals and digits as GOES says and from letter to letter as the habits of the language do. Its probabilities sum to 1, so
    an identifier reaches evidence x with a probability of exp(-x) at most, at any length; each character of a random token adds to it.
    """
    code, size = encoding(token)
    kinds = F.transform(F.split(F.translate(token, UPPER + LOWER + DIGIT, "0" * 26 + "1" * 26 + "2" * 10), ""), lambda c: c.cast("int"))
    letters = F.transform(F.split(F.lower(token), ""), lambda c: F.ascii(c) - 97)  # a digit's is negative
    numbers = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<double>")  # noqa: E731  one literal

    def likelier(x: Column) -> Column:
        k, c = x["k"], x["c"]
        step = F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k)), lambda p, q: F.get(numbers([math.log(g) for row in GOES for g in row]), p * 3 + q))
        habit = F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(c, F.lit(1), F.size(c) - 1)), c, lambda p, q: F.when(q < 0, -math.log(10)).otherwise(F.get(numbers(habits), F.when(p < 0, 26).otherwise(p) * 26 + q)))
        said = F.aggregate(F.concat(step, habit), F.get(numbers([math.log(b) for b in BEGINS]), F.get(k, 0)), lambda s, y: s + y)
        return -F.size(c) * F.log(x["a"].cast("double")) - said

    return F.when((size > 0) & (F.length(token) >= LEAST), let(F.struct(kinds.alias("k"), letters.alias("c"), size.alias("a")), likelier)).otherwise(-1.0)


def candidates(text: Column, base: Column, habits: list[float], level: float) -> Column:
    """Tokens clear of the base spans with their evidence: -1 for those that the battery rejects at `level`."""
    tokens = F.regexp_replace(F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), " "), MARKS, "")
    found = F.arrays_zip(matches(text, TOKEN, len(KINDS) - 1).alias("span"), F.split(tokens, " ").alias("token"))

    def clear(found: Column) -> Column:
        free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])))
        return F.transform(free, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["rank"].alias("rank"), x["span"]["end"].alias("end"), F.when(battery(x["token"]) >= level, F.greatest(evidence(x["token"], habits), F.lit(-1.0))).otherwise(-1.0).alias("evidence")))

    return F.when(text.rlike(TOKEN), let(found, clear)).otherwise(F.array().cast(CANDIDATES))


def least_evidence(found: DataFrame, alpha: float) -> float:
    """The evidence from which tokens stand, by the step-up of Benjamini and Hochberg on e-values over all tokens of all documents.

    With m tokens of which k reach evidence x, these stand if exp(x) >= m / (alpha * k); x is the least such. In expectation a share of alpha of them
    at most are identifiers. Only a histogram of BINS * MOST bins comes to the driver.
    """
    bin_ = F.least(F.floor(F.col("e") * BINS), F.lit(BINS * MOST))
    n = {r.bin: r.n for r in found.select(F.explode("found.evidence").alias("e")).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    m, k, cut = sum(n.values()), 0, math.inf
    for b in sorted((b for b in n if b >= 0), reverse=True):
        k += n[b]
        if b / BINS >= math.log(m / (alpha * k)):
            cut = b / BINS
    return cut


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """(doc_id, base, added), one row per document: arrays of (start, end, kind) by start and kind, in code points, ends exclusive.

    base has the matches of the patterns: assignments to names of secrets whose value has 6 characters or more (the
    span is the whole match), access keys of 20, hexadecimal runs of 24. added has tokens that pass for random by the battery and that are, by the false-discovery
    control over all documents, no identifiers of the corpus's own language. Null and empty texts have no spans. Repeated rows are each reported; an empty table gives an
    empty one. Whole texts are read twice, where they are: once to count words, once to find spans, which are stored below the shared folder.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t, habits = F.col("text"), language(d)
    base = F.array_sort(F.concat(matches(t, ASSIGN, 0, 2, 6), matches(t, ACCESS, 1), matches(t, HEX, 2)))
    both = let(base, lambda b: F.struct(b.alias("base"), candidates(t, b, habits, level).alias("found")))
    found = stored(d.select("doc_id", both.alias("s")).select("doc_id", "s.*"), f"{scratch(docs.sparkSession)}/spans")
    cut = least_evidence(found, alpha)
    named = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind")))
    return found.select("doc_id", named(F.col("base")).alias("base"), named(F.array_sort(F.filter("found", lambda s: s["evidence"] >= F.lit(cut)))).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(base: Column, added: Column) -> Column:
    """Both lists by start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
