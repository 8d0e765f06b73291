"""Similarity search: n-gram candidates, approximate substring search, prefix cascades."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import alignment_key, contraction_stems, ngrams, tokens

#: Words of the n-grams that propose places.
GRAM = 6


def grams_of(df: DataFrame, keys: list[str], text: str = "text", n: int = GRAM) -> DataFrame:
    """(keys, pos, gram) of each text's word n-grams; none in shorter texts."""
    return df.select(*keys, F.explode(ngrams(tokens(F.col(text)), n)).alias("g")).select(*keys, "g.pos", "g.gram")


def candidates(queries: DataFrame, texts: DataFrame, query_key: str, text_key: str, n: int = GRAM) -> DataFrame:
    """(query, text, pos): word positions in texts that share an n-gram with the query, each once: an equi-join on grams that replaces an index."""
    q = grams_of(queries, [query_key], n=n).select(query_key, "gram").distinct()
    t = grams_of(texts, [text_key], n=n)
    return t.join(q, "gram").select(query_key, text_key, "pos").distinct()


def thinned(hits: DataFrame, keys: list[str], pos: str, reach: int, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Hits within [lo, hi] that the hit before them, at most `reach` back, does not cover."""
    if lo is not None:
        hits = hits.filter((F.col(pos) >= lo) & (F.col(pos) <= hi))
    prev = F.lag(pos).over(Window.partitionBy(*keys).orderBy(pos))
    return hits.withColumn("_p", prev).filter(F.col("_p").isNull() | (F.col(pos) - F.col("_p") > reach)).drop("_p")


def scores(needle: str, text: str):
    """Yields after each character of the text the least edit distance of the needle to a substring that ends there (bit-parallel dynamic programming)."""
    m = len(needle)
    if not m:
        return
    at: dict[str, int] = {}
    for i, c in enumerate(needle):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    for c in text:
        eq = at.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up) & mask, up & h
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up, down = minus | ~(x | plus) & mask, plus & x
        yield score


def nearest_match(needle: str, text: str, most: int) -> tuple[str, int, int] | None:
    """(match, offset, distance) of the first substring within `most` edits at the least distance, the shortest that ends there; None without one."""
    exact = text.find(needle) if needle else -1
    if exact >= 0:
        return needle, exact, 0
    best, end = most + 1, -1
    for i, s in enumerate(scores(needle, text)):
        if s < best:
            best, end = s, i
    if end < 0:
        return None
    for j, s in enumerate(scores(needle[::-1], text[end::-1])):
        if s == best:
            return text[end - j : end + 1], end - j, best
    return None


def allowed_edits(length: int, share: float) -> int:
    return max(1, int(length * share))


def nearest(share: float):
    """A column function (needle, text) -> struct(match, offset, distance) within share * length edits."""

    @F.pandas_udf("match string, offset int, distance int")
    def run(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
        got = [nearest_match(n, t, allowed_edits(len(n), share)) if n and t else None for n, t in zip(needle, text, strict=True)]
        return pd.DataFrame([g or (None, None, None) for g in got], columns=["match", "offset", "distance"]).astype({"offset": "Int32", "distance": "Int32"})

    return run


def seeds(needles: list[str], share: float) -> tuple[dict[int, dict[str, list[tuple[int, int]]]], list[int]]:
    """(length -> piece -> (needle, offset), needles without pieces). One more pieces than edits are allowed, side by side: some piece stands unchanged in every occurrence."""
    pieces: dict[int, dict[str, list[tuple[int, int]]]] = {}
    bare = []
    for i, n in enumerate(needles):
        k = allowed_edits(len(n), share)
        size = len(n) // (k + 1)
        if not size:
            bare.append(i)
            continue
        for at in range(0, size * (k + 1), size):
            pieces.setdefault(size, {}).setdefault(n[at : at + size], []).append((i, at))
    return pieces, bare


def seeded(needles: list[str], text: str, share: float, tables) -> list[tuple[int, str, int, int]]:
    """(needle, match, offset, distance) of each needle that occurs in the text within its edits, at the least distance, the first of them.

    Only the text around unchanged pieces is compared, where enough of the needle's 4-grams are at hand: an edit spoils four at most.
    """
    pieces, bare = tables
    places: dict[int, list[int]] = {i: [] for i in bare}
    for size, table in pieces.items():
        for at in range(len(text) - size + 1):
            for i, offset in table.get(text[at : at + size], ()):
                places.setdefault(i, []).append(at - offset)
    out = []
    for i, starts in places.items():
        n = needles[i]
        k = allowed_edits(len(n), share)
        spans: list[list[int]] = [] if starts else [[0, len(text)]]
        for at in sorted(starts):
            lo, hi = max(at - k, 0), min(at + len(n) + k, len(text))
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        grams = [n[j : j + 4] for j in range(len(n) - 3)]
        best = None
        for lo, hi in spans:
            window = text[lo:hi]
            if len(grams) > 4 * k and sum(g in window for g in grams) < len(grams) - 4 * k:
                continue
            m = nearest_match(n, window, k)
            if m and (best is None or m[2] < best[3]):
                best = (i, m[0], lo + m[1], m[2])
        if best:
            out.append(best)
    return out


def by_pieces(queries: DataFrame, texts: DataFrame, query_key: str, text_key: str, share: float, block: int = 1 << 22) -> DataFrame:
    """located() without n-grams, complete for the edits allowed: (query, text, pos, q_len, match, distance), pos the word in which the match begins. Queries are broadcast in blocks of so many characters."""
    sc = texts.sparkSession.sparkContext
    key, other = queries.schema[query_key].dataType, texts.schema[text_key].dataType
    sent, rows, size = [], [], 0
    for r in queries.select(query_key, F.array_join(tokens(F.col("text")), " ").alias("_q")).filter("_q <> ''").toLocalIterator():
        if rows and size + len(r[1]) > block:
            sent.append(sc.broadcast(rows))
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    if rows:
        sent.append(sc.broadcast(rows))
    schema = T.StructType([T.StructField(query_key, key), T.StructField(text_key, other), T.StructField("pos", T.IntegerType()), T.StructField("q_len", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("distance", T.IntegerType())])

    def run(batches):
        tables: dict = {}
        for b in batches:
            ids, said, found = b.column(0), b.column(1).to_pylist(), []
            for x, part in enumerate(sent):
                needles = [q for _, q in part.value]
                if x not in tables:  # one block's tables at a time
                    tables.clear()
                    tables[x] = seeds(needles, share)
                for row, t in enumerate(said):
                    found += [(part.value[i][0], row, t.count(" ", 0, at), len(needles[i]), m, d) for i, m, at, d in seeded(needles, t, share, tables[x])] if t else []
            q, at, *rest = zip(*found, strict=True) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(q, kinds[0]), ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)]], names=schema.names) if found else pa.RecordBatch.from_arrays([pa.array([], f) for f in kinds], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema).types
    return texts.select(text_key, F.array_join(tokens(F.col("text")), " ").alias("_t")).mapInArrow(run, schema)


def located(queries: DataFrame, texts: DataFrame, query_key: str, text_key: str, share: float = 0.1, n: int = GRAM) -> DataFrame:
    """Where each query occurs in each text, within share * length edits: the earliest candidate place that holds it.

    Candidates are few next to words, so only windows around them are compared. Where no candidate holds a query, it is
    sought by its unchanged pieces, which finds every occurrence; `pos` is then the word in which the match begins.
    """
    reach = F.size(tokens(F.col("q_text")))
    c = candidates(queries, texts, query_key, text_key, n)
    q = queries.select(query_key, F.array_join(tokens(F.col("text")), " ").alias("q_text"))
    t = texts.select(text_key, tokens(F.col("text")).alias("t_words"))
    c = thinned(c, [query_key, text_key], "pos", n)
    d = c.join(q, query_key).join(t, text_key)
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    window = F.array_join(F.slice("t_words", (first + 1).cast("int"), (reach * 3).cast("int")), " ")
    d = d.select(query_key, text_key, "pos", F.length("q_text").alias("q_len"), nearest(share)(F.col("q_text"), window).alias("m")).filter("m.match is not null")
    d = d.select(query_key, text_key, "pos", "q_len", F.col("m.match").alias("match"), F.col("m.distance").alias("distance"), F.lit(0).alias("_late"))
    d = d.unionByName(by_pieces(queries, texts, query_key, text_key, share).withColumn("_late", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(query_key, text_key).orderBy("_late", "distance", "pos"))
    return d.withColumn("_r", rank).filter("_r = 1").drop("_r", "_late")


def prefix_match(query: Column, text: Column) -> Column:
    """How the text begins with the query, the first of: as it is, after one blank, punctuation around it aside, all punctuation and contractions aside; else null."""
    ends = r"^[\s\p{P}]+|[\s\p{P}]+$"
    bare = F.regexp_replace(query, ends, "")
    plain = lambda c: F.regexp_replace(alignment_key(contraction_stems(c)), r"\s+", " ")
    return (
        F.when(F.startswith(text, query), "exact")
        .when(F.startswith(text, F.concat(F.lit(" "), query)), "trimmedLeading")
        .when((bare != "") & F.startswith(F.regexp_replace(text, r"^[\s\p{P}]+", ""), bare), "ignoringEndsPunctuation")
        .when((plain(query) != "") & F.startswith(plain(text), plain(query)), "ignoringAllPunctuation")
    )


def near_words(a: Column, b: Column) -> Column:
    """Words of 4 and 3 characters at least, equal or within a quarter of the first's length in edits."""
    allowed = F.greatest(F.floor(F.length(a) / 4), F.lit(1)).cast("int")
    close = (F.abs(F.length(a) - F.length(b)) <= allowed) & (F.levenshtein(a, b) <= allowed)
    return (a == b) | (F.length(a) >= 4) & (F.length(b) >= 3) & close
