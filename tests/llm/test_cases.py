"""Hard cases of the corpus operators: skewed keys, any column type, recall of each method, brute force of what the methods add."""

import collections
import itertools
import math
import random
import re
import string
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontaminate, fingerprints, katz, langid, mixing, near, queries, repeats, secrets, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_warc_with_odd_ids(spark, tmp_path):
    rng = random.Random(1)
    far = [(i, f"u{i}", "".join(rng.choices("abcdef", k=3000))) for i in range(60)] + [(10**15, "far", "x"), (-(10**15), "low", "y")]
    hot = [(None, f"n{i}", "".join(rng.choices("abcdef", k=3000))) for i in range(30)] + [(7, "same", "z" * 4000)] * 30
    pages = spark.createDataFrame(far + hot, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, shard_bytes=20000, roll_bytes=3000)
    names = sorted(p.name for p in (tmp_path / "w/archives").iterdir() if not p.name.startswith("."))
    per = collections.Counter(n.split("-")[0] for n in names)
    assert len(per) > 15 and all(re.fullmatch(r"\d{8}-\d{5}\.warc\.gz", n) for n in names) and not (tmp_path / "w/_archives").exists()
    (tmp_path / "w").rename(tmp_path / "moved")
    path = f"file://{tmp_path}/moved"
    got = warc.read(spark, path).collect()
    assert len(got) == len(far) + len(hot) and {r.page_id for r in got} == {p for p, _, _ in far + hot}
    files = collections.defaultdict(list)
    for r in got:
        files[r.file].append(r)
    sizes = collections.Counter(r.file.split("-")[0] for r in got)
    assert max(sizes.values()) <= 12
    ids, order = [], []
    for n in names:
        data = (tmp_path / "moved/archives" / n).read_bytes()
        heads = [h for h, _ in warc.records(data)]
        assert heads[0]["warc-type"] == "warcinfo" and heads[0]["warc-filename"] == n
        ids += [h["warc-record-id"] for h in heads]
        order += [int(h["x-page-id"]) if "x-page-id" in h else None for h in heads[1:]]
    assert len(set(ids)) == len(ids) and order == sorted(order, key=lambda x: (x is not None, x or 0))
    with pytest.raises(ValueError, match="already"):
        warc.write(pages, path)
    (tmp_path / "moved/archives" / names[3]).unlink()
    with pytest.raises(ValueError, match="manifest"):
        warc.read(spark, path)


RANDOM = {
    "base62": lambda r, n: "".join(r.choices(string.ascii_letters + string.digits, k=n)),
    "base64": lambda r, n: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n)),
    "base64url": lambda r, n: "".join(r.choices(string.ascii_letters + string.digits + "-_", k=n)),
    "base36": lambda r, n: "".join(r.choices(string.ascii_lowercase + string.digits, k=n)),
    "base32": lambda r, n: "".join(r.choices(string.ascii_uppercase + "234567", k=n)),
    "hex": lambda r, n: "".join(r.choices("0123456789ABCDEF", k=n)),
    "letters": lambda r, n: "".join(r.choices(string.ascii_lowercase, k=n)),
    "uuid": lambda r, n: str(uuid.UUID(int=r.getrandbits(128), version=4)),
}


def test_secrets_recall_and_false_spans(spark):
    rng = random.Random(2)
    english = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("text").collect()
    words = sorted({w for r in english for w in re.findall(r"[a-z]{3,9}", r.text or "")})
    name = {
        "camel": lambda: "".join(w.title() for w in rng.choices(words, k=5)) + str(rng.randint(1, 99)),
        "snake": lambda: "_".join(rng.choices(words, k=5)),
        "kebab": lambda: "-".join(rng.choices(words, k=5)) + "-" + str(rng.randint(1, 9)),
        "path": lambda: "/".join(rng.choices(words, k=5)),
        "upper": lambda: "_".join(w.upper() for w in rng.choices(words, k=5)),
        "stamp": lambda: f"2024{rng.randint(10, 12)}{rng.randint(10, 28)}T{rng.randint(100000, 235959)}Z-{rng.randint(1000, 9999)}-run",
    }
    rows, kinds = [], {}
    prose = " ".join(r.text for r in english if r.text)
    for kind, make in RANDOM.items():
        for _ in range(100):
            kinds[len(rows)] = kind
            rows.append((len(rows), f"see {make(rng, 40)} there"))
    for kind, make in name.items():
        for _ in range(200):
            kinds[len(rows)] = kind
            rows.append((len(rows), f"call {make()} now"))
    rows.append((len(rows), prose))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id int, text string")).filter("size(added) > 0").collect()
    found = collections.Counter(kinds.get(r.doc_id) for r in got)
    assert all(found[k] >= 90 for k in RANDOM), found
    wrong = sum(found[k] for k in name)
    assert wrong <= 0.05 * sum(found.values()), found
    for r in got:
        if r.doc_id in kinds:
            t = rows[r.doc_id][1]
            assert [t[x.start : x.end] for x in r.added] == [t.split(" ")[1]]


def test_secrets_alone_among_identifiers(spark):
    """One key among names is found, and names alone are left alone."""
    rng = random.Random(3)
    words = "table user cache update index cluster session handler request token buffer stream parser module config service".split()
    names = ["".join(w.title() for w in rng.choices(words, k=4)) + str(rng.randint(10, 99)) for _ in range(400)]
    prose = " ".join(rng.choices(words, k=3000))
    rows = [(0, prose + " " + " ".join(names)), (1, names[0] + " " + RANDOM["base62"](rng, 32)), *[(i, n) for i, n in enumerate(names, 2)]]
    got = {r.doc_id: r.added for r in secrets.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert len(got[1]) == 1 and sum(map(len, got.values())) <= 2
    only = [r for r in rows if r[0] != 1]
    assert sum(len(r.added) for r in secrets.scan(spark.createDataFrame(only, "doc_id int, text string")).collect()) <= 1


def test_secrets_brute_force(spark):
    rng = random.Random(4)
    tokens = [make(rng, n) for make in RANDOM.values() for n in (16, 21, 33)] + ["TableUserCacheUpdate42", "a" * 20, "12345678901234567890", "short", "abcABC123" * 4]
    tokens = [re.sub(secrets.MARKS, "", t) for t in tokens]
    habits = [math.log(x) for i in range(27) for x in np.random.default_rng(i).dirichlet(np.ones(26))]

    def encoding(t):
        return next((len(a) for p, a in secrets.ENCODINGS.values() if re.search(p, t)), 0)

    def evidence(t):
        if not encoding(t) or len(t) < secrets.LEAST:
            return -1.0
        kind = lambda c: 0 if c.isupper() else 1 if c.islower() else 2
        said = math.log(secrets.BEGINS[kind(t[0])]) + sum(math.log(secrets.GOES[kind(a)][kind(b)]) for a, b in itertools.pairwise(t))
        for a, b in itertools.pairwise(" " + t.lower()):
            said += -math.log(10) if b.isdigit() else habits[(ord(a) - 97 if a.isalpha() else 26) * 26 + ord(b) - 97]
        return -len(t) * math.log(encoding(t)) - said

    def battery(t):
        a = encoding(t)
        if not a or len(t) < secrets.LEAST:
            return 0.0
        alphabet = next(x for p, x in secrets.ENCODINGS.values() if re.search(p, t))
        if alphabet in (secrets.DIGIT + "abcdef", secrets.LOWER, secrets.DIGIT + secrets.LOWER):
            t = t.lower()
        c, n, mean = [alphabet.index(x) for x in t], len(t), (a - 1) / 2
        tail = lambda z: 1 / (1 + math.exp(z * 1.5976 + z**3 * 0.07056))
        df = a - 1
        chi = (((sum(k * k for k in collections.Counter(c).values()) * a / n - n) / df) ** (1 / 3) - (1 - 2 / (9 * df))) * math.sqrt(9 * df / 2)
        runs = (sum((p > mean) != (q > mean) for p, q in itertools.pairwise(c)) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
        serial = sum((p - mean) * (q - mean) for p, q in itertools.pairwise(c)) / ((a * a - 1) / 12) / math.sqrt(n - 1)
        return min(1, 3 * min(tail(max(chi, -8)), 2 * tail(abs(runs)), 2 * tail(abs(serial))))

    d = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in d.select("t", secrets.evidence(F.col("t"), habits).alias("e"), secrets.battery(F.col("t")).alias("b")).collect():
        assert math.isclose(r.e, evidence(r.t), rel_tol=1e-9) and math.isclose(r.b, battery(r.t), rel_tol=1e-6, abs_tol=1e-12)
    total = sum(math.exp(sum(math.log(p) for p in (secrets.BEGINS[a], secrets.GOES[a][b]))) for a in range(3) for b in range(3))
    assert math.isclose(total, 1)
    texts = spark.createDataFrame([("Ab ab, b",), (None,), ("",)], "text string")
    p = secrets.language(texts)
    assert math.isclose(math.exp(p[26 * 26]), 0.9 * 2 / 3 + 0.1 / 26) and math.isclose(math.exp(p[1]), 0.9 + 0.1 / 26) and math.isclose(p[5 * 26], -math.log(26))


def test_shards_are_written(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i if i % 3 else None, "x" * rng.randint(0, 300), {"k": i}, [(i, {"a": "b"})]) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, n array<struct<i:int,m:map<string,string>>>")
    got = sharding.write(d, f"file://{tmp_path}/s", bucket_bytes=3000, task_bytes=9000)
    assert got.columns == [*d.columns, "shard", "slot", "grown_shard"]
    found = got.collect()
    key = lambda r: str((r.doc_id, r.text, r.m, r.n))
    assert collections.Counter(map(key, found)) == collections.Counter(map(key, d.collect()))
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    for f in (tmp_path / "s").glob("shard=*/part-*"):
        slots = [r.slot for r in spark.read.parquet(f"file://{f}").collect()]
        steps = [b - a for a, b in itertools.pairwise(slots)]
        assert all(x > 0 for x in steps)
    again = sharding.shuffled(d.repartition(5), bucket_bytes=3000, task_bytes=9000).collect()
    assert collections.Counter((key(r), r.shard, r.slot) for r in again) == collections.Counter((key(r), r.shard, r.slot) for r in found)
    assert sharding.write(d.limit(0), f"file://{tmp_path}/e").count() == 0


def test_shard_query(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_shard(spark, SF).collect()
    assert len(got) == len(docs) and all((r.size, r.text_crc32, r.law) == (len((docs[r.doc_id] or "").encode()) + 1, zlib.crc32((docs[r.doc_id] or "").encode()), "key") for r in got)


def brute_katz(train, order):
    """p(words, i): the probability of the i-th token of padded words, by the definition."""
    grams = [collections.Counter(tuple(d[i - k + 1 : i + 1]) for d in train for i in range(order - 1, len(d))) for k in range(1, order + 1)]
    off = [katz.discounts([sum(c == r for c in g.values()) for r in range(1, katz.CUTOFF + 2)]) for g in grams]
    mass = lambda k, c: off[k][min(c, katz.CUTOFF + 1)] * c
    n = sum(grams[0].values())
    by = [collections.defaultdict(list) for _ in range(order)]
    for k in range(order):
        for g in grams[k]:
            by[k][g[:-1]].append(g)
    memo: dict = {}

    def context(k, ctx):
        if (k, ctx) not in memo:
            total = sum(grams[k][g] for g in by[k][ctx])
            share = sum(mass(k, grams[k][g]) for g in by[k][ctx]) / total
            left = max(1 - share, 1 / (total + 1))
            lower = sum(p(k - 1, g[1:]) for g in by[k][ctx]) if k else 0.0
            memo[k, ctx] = total, (1 - left) / share, left / max(1 - lower, 1e-12)
        return memo[k, ctx]

    def p(k, g):
        if k == 0:
            total, scale, left = context(0, ())
            return scale * mass(0, grams[0][g]) / n if grams[0][g] else left
        if g[:-1] not in by[k]:
            return p(k - 1, g[1:])
        total, scale, alpha = context(k, g[:-1])
        return scale * mass(k, grams[k][g]) / total if grams[k][g] else alpha * p(k - 1, g[1:])

    return p


@pytest.mark.parametrize("order", [1, 3])
def test_katz_model(spark, none, tmp_path, order):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    line = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(30)], k=rng.randint(1, 30)))
    rows = [(i, line()) for i in range(120)] + [(None, None), (500, "")]
    fresh = [(1000 + i, line() + " new") for i in range(20)] + [(2000, None), (2000, "w1 W1")]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    model = katz.train(make(rows), f"file://{tmp_path}/m", order=order, block_bytes=900, task_bytes=2000)
    got = katz.score(make(fresh), model, block_bytes=300).collect()
    pad = lambda t: [b"^"] * (order - 1) + (t or "").lower().encode().split() + [b"$"]
    p = brute_katz([pad(t) for _, t in rows], order)
    want = collections.Counter((i, len(pad(t)) - order + 1, round(sum(math.log10(p(order - 1, tuple(pad(t)[j - order + 1 : j + 1]))) for j in range(order - 1, len(pad(t)))), 6)) for i, t in fresh)
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got) == want
    both = katz.scored(make(rows + fresh), F.col("doc_id").isNull() | (F.col("doc_id") < 1000), order=order, block_bytes=700).filter("not train").collect()
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9), round(r.base_score, 9))
    assert collections.Counter(map(key, both)) == collections.Counter(map(key, got))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lectern_")]
    assert katz.score(none, model).count() == 0


def test_mixture_inference_by_plain_loops():
    rng = np.random.default_rng(7)
    logs = np.log(rng.dirichlet(np.ones(langid.SLOTS), 3)).astype(np.float32)
    for text in (b"one two three four", b"a", "äö ü xyz".encode(), b"lorem ipsum " * 30):
        lang, share, mixture = langid.infer(["a", "b", "c"], [logs], [text], 12, 2.0)[0]
        slots, starts = langid.grams(np.frombuffer(text + b" ", dtype=np.uint8))
        words = [slots[a:b] for a, b in zip(starts, [*starts[1:], len(slots)], strict=True)]
        ll = [[float(np.sum(logs[i][w].astype(float))) for i in range(3)] for w in words]

        def em(allowed, rounds):
            pi = {i: 1 / len(allowed) for i in allowed}
            for _ in range(rounds):
                new = dict.fromkeys(allowed, 0.0)
                for row in ll:
                    top = max(row)
                    z = sum(pi[i] * math.exp(row[i] - top) for i in allowed)
                    for i in allowed:
                        new[i] += pi[i] * math.exp(row[i] - top) / z / len(ll)
                pi = new
            return pi, sum(max(r) + math.log(sum(pi[i] * math.exp(r[i] - max(r)) for i in allowed)) for r in ll)

        full, _ = em([0, 1, 2], 12)
        order = sorted(range(3), key=lambda i: -full[i])
        options = []
        for size in (1, 2, 3):
            pi, fit = em(order[:size], 12)
            options.append((fit - 2.0 * (size - 1) * math.log(len(ll) + 1), -size, pi))
        pi = max(options, key=lambda o: (o[0], o[1]))[2]
        best = max(range(3), key=lambda i: pi.get(i, 0.0))
        assert lang == "abc"[best] and share == pytest.approx(pi[best], abs=1e-4) and sum(s for _, s in mixture) == pytest.approx(1, abs=1e-4)


def test_every_language_counts(spark):
    rng = random.Random(9)
    own = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for i in range(70)}
    line = lambda x, n: " ".join(rng.choices(own[x], k=n))
    model = langid.fit(spark.createDataFrame([(x, line(x, 60 if x == "l69" else 90)) for x in own], "lang string, text string"))
    assert model.langs == sorted(own)
    mixed = ["l03", "l17", "l42", "l65", "l69"]
    texts = [line("l69", 30), " ".join(line(x, 40) for x in mixed)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    assert got[0].lang_pred == "l69" and got[0].score > 0.95
    assert {m.lang for m in got[1].mixture if m.share > 0.1} == set(mixed) and abs(got[1].score - 0.2) < 0.05


def jaccard(a, b):
    x, y = collections.Counter(a), collections.Counter(b)
    whole = sum((x | y).values())
    return sum((x & y).values()) / whole if whole else 1.0


def test_likeness_at_the_production_count(spark):
    rng, pairs = random.Random(3), []
    for k in range(300):
        common = [f"{k}c{i}" for i in range(20) for _ in range(rng.choice((1, 1, 2, 5)))]
        pairs.append([common + [f"{k}{side}{i}" for i in range(20) for _ in range(rng.choice((1, 1, 2, 3)))] for side in "ab"])
    rows = spark.createDataFrame([(k, side, p[side]) for k, p in enumerate(pairs) for side in (0, 1)], "k int, side int, words array<string>")
    got = {r.k: r for r in fingerprints.fingerprints(rows, ["k"]).collect()}
    off = [sum(x == y for x, y in zip(got[k].mine, got[k].other, strict=True)) / len(got[k].mine) - jaccard(*p) for k, p in enumerate(pairs)]
    assert len(got[0].mine) == fingerprints.SAMPLES
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.075 and abs(sum(off) / len(off)) < 0.015


def test_fingerprint_query(spark):
    """op8's columns against plain Python: edited texts, and likeness against exact generalised Jaccard of word counts."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op8_fingerprint(spark, SF).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    off = []
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        off += [got[doc].near_edited - jaccard(words(text), words(edited)), got[doc].near_next - jaccard(words(text), words(after))]
        assert got[doc].n_chars == len(text)
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.06


def test_fingerprints_of_hot_ids(spark):
    rng = random.Random(8)
    rows = [(None, "null text " * 5)] * 40 + [(5, " ".join(rng.choices("abcdefg", k=30))) for _ in range(20)] + [(i, f"t{i} " * 20) for i in range(10, 20)]
    got = fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=400).collect()
    one = fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=1 << 30).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, one)) and len(got) == len(rows)
    assert sum(r.doc_id is None and r.near_next == 1.0 for r in got) == 39


def test_sketches_keep_pairs_at_the_threshold():
    """Of pairs within two hundredths above the threshold, none of 1500 is lost by bands or sketches."""
    rng = np.random.default_rng(10)
    lost = near_ = 0
    bits = lambda v: sum(bin(x & (2**64 - 1)).count("1") for x in v)
    for _ in range(1500):
        n = int(rng.integers(60, 400))
        same = int(math.ceil(0.85 * n)) + int(rng.integers(0, max(1, n // 50)))
        s = rng.integers(0, 2**64, n, dtype=np.uint64)
        cut = same + (n - same) // 2
        a, b = np.sort(s[:cut]), np.sort(np.concatenate((s[:same], s[cut:])))
        assert 100 * same >= 85 * n
        (_, x, p), (_, y, q) = near.features(a), near.features(b)
        d = [u ^ v for u, v in zip(x, y, strict=True)]
        whole = bits(d[near.LONGS :])
        near_ += 1
        lost += not set(p) & set(q) or bits(d[: near.LONGS]) > near.most_bits(0.85) or whole * 185 > (len(a) + len(b)) * 15
    assert near_ == 1500 and lost == 0


def test_near_in_a_hot_band(spark, monkeypatch):
    """Many texts share most shingles but few are near: a band of several hundred members, dealt over salts."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        t = " ".join([*common, *[f"x{rng.random()}" for _ in range(25)]])
        texts += [t, t + " end"] if rng.random() < 0.3 else [t]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    monkeypatch.setattr(near, "SALT", 16)
    got = near.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, similarity=(85, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(comp)) and len(set(comp)) < len(comp)


def test_repeats_over_many_buckets(spark, monkeypatch):
    """With tiny buckets runs of equal tokens cross their boundaries; the result stays that of brute force."""
    rng = random.Random(12)
    monkeypatch.setattr(repeats, "BUCKET", 40)
    block = "".join(rng.choices("abcd ", k=1200))
    texts = [block[: rng.randint(300, 1200)] + "".join(rng.choices("abcd ", k=200)) for _ in range(25)] + ["".join(rng.choices("xy", k=900))] * 3 + ["z" * 1500, None, ""]
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    want = {}
    for k, t in enumerate(data):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[k] = bytes(b for b, g in zip(t, gone, strict=True) if not g)
    got = repeats.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want


def test_decontaminate_in_blocks(spark):
    """Many items in many blocks, common words, items of every length: equal to one block and to a plain search."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(12)]
    items = [(i if i % 9 else None, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))) + " " + (rng.choice(items)[1] if i % 3 else "")) for i in range(80)]
    make = lambda r, k: spark.createDataFrame(r, f"{k} long, text string")
    windows = {(str(i) if i is not None else None, tuple(w[j : j + n])) for i, t in items for w in [t.split()] for n in [min(10, len(w))] if n for j in range(len(w) - n + 1)}
    want = {}
    for i, t in texts:
        w, hit, found = t.split(), set(), set()
        for item, g in windows:
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(item)
        want[i] = (len(w), len(hit), found)
    for size in (1 << 20, 200):
        got = decontaminate.overlaps(make(texts, "doc_id"), make(items, "item_id"), block_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in got} == want


def test_empty_tables(spark, none, tmp_path):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    model = langid.fit(none)
    for out in (decontaminate.clean(none, items), langid.identified(none, model), near.distinct_documents(none), mixing.mixed(none)):
        assert out.columns == none.columns and out.count() == 0
    assert secrets.scan(none).count() == repeats.removed(none).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    rng = random.Random(14)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()
    odd = [(None, None, None, None, None), (None, docs[3].text, "en", None, None), (9001, "", None, "s", 0), (9002, "12 !! 34", "en", "s", 8), docs[5], docs[5], (9003, " ".join("".join(rng.choices("bcdfgxzq", k=8)) for _ in range(50)), "en", "s", 1)]
    d = spark.createDataFrame([*map(tuple, docs), *map(tuple, odd)], SCHEMA).withColumns({"shard": F.lit("mine"), "_size": F.lit(3), "row": F.lit(1)})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, before = d, None
    for name, stage in corpus_pipeline.STAGES:
        before, got = got, stage(spark, got, str(tmp_path)).cache()
        assert got.columns == [c for c in d.columns if c != "shard"] + ["shard", "slot", "grown_shard"] if name == "sharding" else d.columns, name
        ids = {r.doc_id for r in got.collect()}
        if name == "language ID":
            assert not ids & {9001, 9002, 9003} and len(ids & {r.doc_id for r in docs}) >= 55
    assert before.count() == got.count() and got.filter("_size = 3 and row = 1").count() == got.count()


def test_pipeline_takes_small_batches(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of it "), F.lit(300)).alias("text"), F.lit("en").alias("lang")).coalesce(1)

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.nbytes for b in batches]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for start, most in ((None, 2 << 20), ("65536", 65536)):
            spark.conf.unset(key) if start is None else spark.conf.set(key, start)
            kept = corpus_pipeline.language(spark, docs, "")
            got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert kept.count() == 4000 and sum(got) > 4000 * 5100 and max(got) < 1.25 * most
    finally:
        spark.conf.unset(key)


def test_buckets_are_dealt_evenly(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(968)).alias("text"))
    got = sharding.shuffled(docs, bucket_bytes=20_000, task_bytes=100_000).withColumn("pid", F.spark_partition_id()).collect()
    tasks = collections.Counter(r.pid for r in got)
    assert len(got) == 3000 and len(tasks) == 30 and max(tasks.values()) < 150
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
