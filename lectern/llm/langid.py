"""Language ID: expectation-maximisation of each document's mixture of languages."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import LOWER, as_bytes, parts

#: Trigrams hash into so many counters per language; languages are broadcast so many at a time.
SLOTS, BLOCK = 1 << 16, 64
#: Bytes at work at a time; longer texts go alone.
PIECE = 1 << 19
#: Digits, ASCII punctuation and blanks separate words; other bytes are kept, A-Z lower-cased.
FOLD = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): the slot of the trigram around each byte of a word, and where in slots each word starts."""
    d = FOLD[data].astype(np.uint32)
    before, after = np.concatenate(([32], d[:-1])).astype(np.uint32), np.concatenate((d[1:], [32])).astype(np.uint32)
    h = before * np.uint32(0x9E3779B1) + d * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    inside = d != 32
    first = inside & (before == 32)
    return (h >> np.uint32(16))[inside].astype(np.int64), np.flatnonzero(first[inside])


def pieces(texts: list[bytes], most: int = PIECE):
    """(first index, bytes, ends): texts joined by blanks, about `most` bytes at a time."""
    first, size = 0, 0
    for i, t in enumerate([*texts, None]):
        if i > first and (t is None or size + len(t) > most):
            yield first, np.frombuffer(b" ".join(texts[first:i]) + b" ", dtype=np.uint8), np.cumsum([len(x) + 1 for x in texts[first:i]])
            first, size = i, 0
        size += len(t or b"") + 1


def counts(rows: DataFrame) -> DataFrame:
    """(lang, slot, n) of all rows of (lang, text); each task adds up before anything is shuffled."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in parts(batches):
            texts, langs = as_bytes(b.column(1)), np.array(b.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for _, data, _ in pieces(mine):
                    n = np.bincount(grams(data)[0], minlength=SLOTS)
                    total[lang] = total[lang] + n if lang in total else n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "slot", "n"])

    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of trigram slots, one row per language, add-half smoothed."""

    def __init__(self, langs: list[str | None], counts: np.ndarray, logs: bool = False):
        self.langs = langs
        c = counts if logs else counts + 0.5
        self.logs = c if logs else np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)


def fit(rows: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learns every language from every row with a language and a text, whole texts. One row of at most SLOTS counts for each language comes to the driver, one at a time."""
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    found = {}
    for r in counts(rows).groupBy("lang").agg(F.collect_list("slot").alias("s"), F.collect_list("n").alias("n")).toLocalIterator():
        found[r.lang] = n = np.zeros(SLOTS, dtype=np.float32)
        n[r.s] = r.n
    langs = sorted(found)
    return Model(langs, np.stack([found[x] for x in langs]).astype(np.float64 if len(langs) <= BLOCK else np.float32) if langs else np.zeros((0, SLOTS)))


def mixtures(ll: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over each document's words: (proportions, log likelihoods). ll: words x languages; allowed: documents x languages."""
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    words = np.bincount(doc, minlength=n)[:, None]
    for _ in range(rounds):
        r = pi[doc] * like
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, starts, axis=0) / words
    per = np.log(np.maximum((pi[doc] * like).sum(axis=1), 1e-300)) + top[:, 0]
    return pi, np.add.reduceat(per, starts)


def slack(ll: np.ndarray, doc: np.ndarray, starts: np.ndarray, words: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """How much any mixture's log likelihood can exceed that of pi at most: it is concave, and its steepest way leads to one language."""
    like = np.exp(ll - ll.max(axis=1, keepdims=True))
    gain = np.add.reduceat(like / np.maximum((pi[doc] * like).sum(axis=1, keepdims=True), 1e-300), starts, axis=0).max(axis=1)
    return np.maximum(gain - words, 0) + 1e-6


def infer(langs: list[str | None], logs: list[np.ndarray], texts: list[bytes], rounds: int, penalty: float, doubt: float = 0.0) -> list[tuple[str | None, float, list[tuple[str | None, float]]]]:
    """For each text its language, that language's share, and the mixture; (None, 0, []) where there are no words.

    A last language None stands for none of the others; it counts only in texts that it alone makes likelier by `doubt` than any other alone does.
    """
    out: list = [(None, 0.0, [])] * len(texts)
    if not langs:
        return out
    for first, data, ends in pieces(texts, PIECE * BLOCK // max(len(langs), BLOCK)):
        slots, starts = grams(data)
        if not len(starts):
            continue
        inside = np.flatnonzero(FOLD[data] != 32)[starts]
        doc_of = np.searchsorted(ends, inside, side="right")
        ll = np.stack([np.add.reduceat(m[slots], starts) for block in logs for m in block], axis=1).astype(np.float64)
        ids, head, doc = np.unique(doc_of, return_index=True, return_inverse=True)
        if langs[-1] is None:
            alone = np.add.reduceat(ll, head, axis=0)
            ll[(alone[:, -1] - alone[:, :-1].max(axis=1, initial=-np.inf) < doubt)[doc], -1] = -1e6
        n, k = len(ids), len(langs)
        words = np.bincount(doc, minlength=n)
        pi, all_ = mixtures(ll, doc, head, n, np.ones((n, k)), rounds)
        ceiling = all_ + slack(ll, doc, head, words, pi)
        order = np.argsort(-pi, axis=1, kind="stable")
        best, best_pi = np.full(n, -np.inf), pi.copy()
        for size in range(1, k + 1):
            # The documents that a set of this size could still gain.
            live = np.flatnonzero(ceiling - penalty * (size - 1) * np.log(words + 1) > best)
            if not len(live):
                break
            mine = np.isin(doc, live)
            at = np.searchsorted(live, doc[mine])
            allowed = np.zeros((len(live), k))
            np.put_along_axis(allowed, order[live, :size], 1.0, axis=1)
            p, fit_ = mixtures(ll[mine], at, np.searchsorted(at, np.arange(len(live))), len(live), allowed, rounds if size > 1 else 1)
            fit_ = fit_ - penalty * (size - 1) * np.log(words[live] + 1)
            better = fit_ > best[live]
            best[live], best_pi[live] = np.where(better, fit_, best[live]), np.where(better[:, None], p, best_pi[live])
        for i, d in enumerate(ids):
            j = int(np.argmax(best_pi[i]))
            out[first + d] = (langs[j], float(min(1.0, best_pi[i, j])), [(langs[x], float(best_pi[i, x])) for x in order[i] if best_pi[i, x] > 1e-6])
    return out


def broadcast(docs: DataFrame, model: Model) -> list:
    """The model's rows, SLOTS * BLOCK floats at most in each."""
    return [docs.sparkSession.sparkContext.broadcast(model.logs[i : i + BLOCK]) for i in range(0, len(model.langs), BLOCK)]


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12, penalty: float = 2.0, carry: list[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, mixture, *carry), one row per document, where it is read.

    A document's words come from one language each, in proportions that EM finds. Of the sets of the
    likeliest languages, of any size, the one with the greatest log likelihood less penalty * log(words) for each further language is
    taken; lang_pred is its largest and score that one's share. Null texts and texts without letters are `und` with score 0. A model without languages
    makes all `und`. Repeated rows get equal results; of very long texts every word counts.
    """
    sent, model_langs = broadcast(docs, model), model.langs
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), has_letters(text).alias("ok"), *[F.col(c) for c in carry])
    schema = T.StructType([src.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))), *[src.schema[c] for c in carry]])

    def run(batches):
        for b in parts(batches):
            ok = b.column(2).to_pylist()
            got = infer(model_langs, [x.value for x in sent], [t if o else b"" for t, o in zip(as_bytes(b.column(1)), ok, strict=True)], rounds, penalty)
            mix = pa.array([[{"lang": x, "share": s} for x, s in g[2]] for g in got], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] or "und" for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), mix, *b.columns[3:]], names=schema.names)

    return src.mapInArrow(run, schema)


def held_out(id_: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text falls into the part; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def identified(docs: DataFrame, model: Model, *, text_col: str = "text", langs: Collection[str] | None = None, least: float = 0.5, doubt: float = 20.0, rounds: int = 12, penalty: float = 2.0) -> DataFrame:
    """The documents, all columns as they are, in a language that is wanted.

    Beside the model's languages a document's words may come from none of them, in which all trigrams are alike likely. It stays if the largest of these in its mixture is one of `langs` (any
    of the model's where that is None) and holds a share of `least` at least. No language is considered where it makes the whole text likelier by exp(doubt) than any language does, which a
    few words cannot. So null texts, texts without letters, texts of strange languages or of
    random letters, and those that no language holds so much of go. A model without languages keeps nothing. Repeated rows get equal results; an empty table gives an empty one.
    """
    names = [*model.langs, None]
    sent = broadcast(docs, Model(names, np.vstack([model.logs, np.full((1, SLOTS), -np.log(SLOTS), dtype=np.float32)]), True))
    wanted = set(model.langs if langs is None else langs)
    at = docs.columns.index(text_col)
    known = docs.filter(has_letters(F.col(f"`{text_col}`").cast("string")))

    def run(batches):
        for b in parts(batches):
            got = infer(names, [x.value for x in sent], as_bytes(b.column(at)), rounds, penalty, doubt)
            yield b.filter(pa.array([lang in wanted and share >= least for lang, share, _ in got], pa.bool_()))

    return known.mapInArrow(run, docs.schema)
