"""Registered queries against plain versions over whole tables, where SQL can't express them."""

import hashlib
import hmac
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from winnower.llm import common, embdedup, jpeg, langid, minhash, packing, pii, registry


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in common.table(spark, data, "documents").collect()}


def test_media_query_equals_hashlib(spark, data, texts):
    stored = {r.doc_id: bytes(r.media) for r in jpeg.store_texts(common.table(spark, data, "documents")).collect()}
    rows = registry.QUERIES["op9_media"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    same = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert same.setdefault(raw, r.asDict() | {"doc_id": 0}) == r.asDict() | {"doc_id": 0}


def test_long_texts_are_media_too(spark):
    long_ = "многие слова 多くの語 " * 60_000
    df = spark.createDataFrame([(1, long_), (2, long_), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in jpeg.media_features(jpeg.store_texts(df)).collect()}
    raw = long_.encode()
    assert got[1].payload_sha256 == got[2].payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()


def test_packing_query_is_optimal(spark, data, texts):
    rows = registry.QUERIES["op8_packing"](spark, data).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == size
    hist = sorted(Counter(size.values()).items())
    below = list(itertools.accumulate((n for _, n in hist), initial=0))
    best = [0] + [math.inf] * len(hist)
    for _ in range(packing.BUCKETS):
        best = [0] + [min(best[i] + hist[j - 1][0] * (below[j] - below[i]) for i in range(j)) for j in range(1, len(hist) + 1)]
    tops = sorted({(r.bucket, r.bucket_len) for r in rows})
    assert len(tops) <= packing.BUCKETS and sum(r.padding for r in rows if r.bucket_len > 1 or r.n_tokens) <= best[-1] - sum(size.values()) + sum(r.padding for r in rows if not r.n_tokens)
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0 and all(t >= r.bucket_len or t < r.n_tokens for _, t in tops)
        batches.setdefault(r.batch_id, []).append(r)
    for rs in batches.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len({r.bucket for r in rs}) == 1
        assert len(rs) == 1 or len(rs) * rs[0].bucket_len <= packing.TOKEN_BUDGET


def test_language_query_equals_slow_counting(spark, data, texts):
    rows = {r.doc_id: r for r in registry.QUERIES["op10_langid"](spark, data).collect()}
    assert sorted(rows) == sorted(texts)
    model = langid.train(common.table(spark, data, "documents").where(~langid.held_out()))
    shift, mask = 64 - langid.FEATURES.bit_length() + 1, (1 << 64) - 1
    k = [int(x) for x in langid._K]
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        text = texts[i] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        codes = []
        for c in text.lower():
            if c.isalpha() or not codes or codes[-1] != 32:
                codes.append(ord(c) if c.isalpha() else 32)
        counts = Counter()
        for p, c in enumerate(codes):
            counts[(c * k[0] & mask) >> shift] += 1
            if p >= 1:
                two = (c * k[0] + codes[p - 1] * k[1]) & mask
                counts[(two * k[2] & mask) >> shift] += 1
            if p >= 2:
                three = (two + ((codes[p - 2] * k[2] & mask) ^ k[0])) & mask
                counts[(three * k[1] & mask) >> shift] += 1
        dense = np.zeros(langid.FEATURES)
        for f, n in counts.items():
            dense[f] = n
        lang, score = model.predict(dense)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)


def test_training_takes_many_languages(spark):
    # more languages than the bound of rows allows many rows of, in ties and with repeated rows
    rows = [(i % 900, f"{chr(0x61 + i % 26)}{chr(0x61 + i // 26 % 26)} word{chr(0x61 + i % 26) * 3}", f"l{i % 300:03d}") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, per_language=5, sample_rows=600)
    assert len(model.languages) == 300
    again = langid.train(df.repartition(3), per_language=5, sample_rows=600)
    assert again.languages == model.languages and np.allclose(again.weights, model.weights)


# --- pseudonyms, from their definition ---------------------------------------------------


def digest(*parts):
    return hmac.new(pii.DEMO_KEY.encode(), ":".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()


def network(a, b, ma, mb, tweak, back):
    for i in range(pii.ROUNDS, 0, -1) if back else range(1, pii.ROUNDS + 1):
        sign = -1 if back else 1
        if i % 2:
            a = (a + sign * (int(digest(tweak, i, b)[:15], 16) % ma)) % ma
        else:
            b = (b + sign * (int(digest(tweak, i, a)[:15], 16) % mb)) % mb
    return a, b


def permuted(a, b, ma, mb, tweak):
    a, b = network(a, b, ma, mb, tweak, False)
    n = (a * mb + b + 1) % (ma * mb)
    return network(n // mb, n % mb, ma, mb, tweak, True)


def digits(d, tweak):
    n = len(d)
    hi = n // 2
    a, b = permuted(int(d[:hi] or 0), int(d[hi:]), 10**hi, 10 ** (n - hi), f"{tweak}{n}")
    return (f"{a:0{hi}d}" if hi else "") + f"{b:0{n - hi}d}"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))


def refill(m, new):
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in m)


def pseudonym(m):
    """(kind or None, replacement) of a piece, for the kinds that the tables hold."""
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", "u" + digest("email", m.lower())[:16] + "@example.invalid"
    if re.match(r"(?i)(token|password|passwd|secret|api_?key)", m):
        tail = re.search(r"[A-Za-z0-9_-]+$", m)[0]
        return "secret", m[: len(m) - len(tail)] + (digest("secret", tail) * (len(tail) // 64 + 1))[: len(tail)]
    if re.fullmatch(r"AKIA[A-Z0-9]{16}", m):
        return "secret", "AKIA" + digest("secret", m)[:16].upper()
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None, m
        a, b = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"\d{13,19}", m):
        if luhn(m) % 10:
            return None, m
        body = digits(m[:-1], "card")
        return "card", body + str(-luhn(body + "0") % 10)
    if re.match(r"\+?1?[ .\-]?\(?\d", m) and 8 <= len(d) <= 15:
        keep = (1 if m[1] in "17" else 2) if m[0] == "+" else 1 if re.match(r"1[ .-]", m) else 0
        return "phone", refill(m, d[:keep] + digits(d[keep:], "phone"))
    raise AssertionError(f"a kind of piece that the tables were not known to hold: {m}")


def test_pseudonyms_equal_their_definition(spark, data, texts):
    rows = registry.QUERIES["op2_pii"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    pattern = re.compile("|".join(f"(?:{p})" for _, p in pii.KINDS).replace("(?<sep>", "(?P<sep>").replace(r"\k<sep>", "(?P=sep)").replace("(?<![0-9.]|[vV]|[Vv]ersion[ :=]|VERSION[ :=])", r"(?<![0-9.vV])(?<![Vv]ersion[ :=])(?<!VERSION[ :=])"))
    seen = Counter()
    for r in rows:
        counts = Counter()

        def one(m):
            kind, new = pseudonym(m[0])
            if kind:
                assert new != m[0]
                counts[kind] += 1
            return new

        assert r.text == pattern.sub(one, texts[r.doc_id])
        assert r.pii_counts == "{" + ",".join(f'"{k}":{n}' for k, n in sorted(counts.items())) + "}"
        seen += counts
    assert len(seen) >= 4


def test_no_value_is_its_own_pseudonym(spark):
    # all of a small domain: ten digits, each behind a country code
    import pyspark.sql.functions as F

    one = pii._digits("d", pii.DEMO_KEY, "'t'", False)
    back = pii._digits("n", pii.DEMO_KEY, "'t'", True)
    rows = spark.range(100).select(F.format_string("%02d", "id").alias("d")).withColumn("n", F.expr(one)).withColumn("b", F.expr(back)).collect()
    assert len({r.n for r in rows}) == 100 and all(r.n != r.d and r.b == r.d for r in rows)


def test_accounts_have_their_country_length_and_versions_stay(spark):
    good, long_ = "DE89370400440532013000", "XX00" + "1" * 20
    df = spark.createDataFrame([(good,), (long_,), ("v1.2.3.4",), ("version 10.0.0.1",), ("at 10.0.0.1",), ("e" * 70 + "@mail.example.com",), ("a@" + "b" * 70 + ".org",)], "text string")
    out = [r.text for r in pii.pseudonymise(df).collect()]
    assert out[0] != good and out[1:4] == [long_, "v1.2.3.4", "version 10.0.0.1"] and out[4] != "at 10.0.0.1"
    assert out[5].endswith("@example.invalid") and out[6].endswith("@example.invalid") and "eee" not in out[5]


def test_very_long_texts_are_pseudonymised_whole(spark):
    text = ("word " * 50_000) + "write to someone@example.org " + ("word " * 50_000) + "token=" + "k" * 10_000
    (r,) = pii.pseudonymise(spark.createDataFrame([(text,)], "text string")).collect()
    assert r.pii_counts == {"email": 1, "secret": 1} and "someone@" not in r.text and "kkkkkkkk" not in r.text and len(r.text) == len(text) - len("someone@example.org") + len("u0123456789abcdef@example.invalid")


# --- vectors and families ----------------------------------------------------------------


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [3e300, 1e290]), (3, [1e-200, 0.0]), (4, [0.0, 1e-300])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_large_buckets_of_two_families_equal_brute_force(spark):
    """Five hundred different texts in the same buckets, in chains and clusters, none like the smallest."""
    import random

    rng = random.Random(11)
    template = [f"t{k}" for k in range(200)]
    docs = []
    for c in range(90):
        base = list(template)
        for at in rng.sample(range(200), 3 + c % 4):
            base[at] = f"c{c}x{at}"
        for _ in range(1 + c % 9):
            copy = list(base)
            for at in rng.sample(range(200), rng.choice([0, 1, 2, 3])):
                copy[at] = f"e{rng.random()}"
            docs.append(copy)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 0.85).collect()}
    assert got == {i: find(i) for i in range(len(docs))}


def test_hub_edges_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_EDGES", 3)
    docs = [(i, " ".join(f"w{k}" for k in range(60)) + (f" own{i}" if i else "")) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 0.85).collect()
    assert {r.component_id for r in got} == {0}
