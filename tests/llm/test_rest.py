"""The other operators: round trips, exact optima, held-out accuracy, contracts."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from winnower.llm import jpeg, langid, mixing, packing, pii, registry, urlfilter, warc


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, data, duck):
    same(registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.ORACLES[name]).df())


# --- urls -----------------------------------------------------------------------------


def verdicts(spark, urls, **kw):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.url: r for r in urlfilter.judge(df, **kw).collect()}


def test_rules(spark):
    got = verdicts(spark, ["http://A.Example.NET/en/1", "http://example.net/de/1", "https://b.example.com/de/x?y#z", "x://org/fr/", "x://norg/fr/", "http://a.net", "http://a.net?x", "nothing", "http://x.org/en/#a/b"])
    v = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert v["http://A.Example.NET/en/1"] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert v["http://example.net/de/1"] == ("example.net", "/de/1", "net/", "block")
    assert v["https://b.example.com/de/x?y#z"] == ("b.example.com", "/de/x", "example.com/de/", "block")
    assert v["x://org/fr/"][2:] == ("org/fr/", "allow") and v["x://norg/fr/"][2] is None
    assert v["http://a.net"][1:3] == ("", None) and v["nothing"][:2] == ("", "") and v["http://x.org/en/#a/b"][1] == "/en/"


def test_templates_learn_from_their_labels(spark):
    # below one host: a folder that rules block, with variable names, and one they leave alone
    urls = [f"http://h.com/bad/name{chr(97 + i // 26)}{chr(97 + i % 26)}x/{i}" for i in range(60)] + [f"http://h.com/good/{i}" for i in range(60)]
    rules = [("block", f"h.com/bad/name{chr(97 + i // 26)}{chr(97 + i % 26)}x/") for i in range(30)]
    got = verdicts(spark, urls, rules=rules)
    assert all(r.verdict == ("block" if "/bad/" in u else "allow") for u, r in got.items())
    assert {r.template for u, r in got.items() if "/bad/" in u} == {"bad/*/{n}"}


# --- pseudonyms -------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_are_valid_linked_and_reversible(spark):
    rng = random.Random(1)
    cards = []
    while len(cards) < 60:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(c):
            cards.append(c)
    days = [f"19{rng.randrange(10, 99)}-0{rng.randrange(1, 10)}-1{rng.randrange(0, 10)}" for _ in range(60)]
    rows = [(i, f"pay {c} on {d}, call +1 (2{i:02d}) 555-01{i:02d} from 10.0.{i}.7, a{i}@b.org") for i, (c, d) in enumerate(zip(cards, days, strict=True))]
    df = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in rows)], "doc_id long, text string")
    out = pii.pseudonymise(df)
    got = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        new = got[i].text
        assert new == got[1000 + i].text and got[i].pii_counts == {"card": 1, "date": 1, "email": 1, "ip": 1, "phone": 1}
        assert luhn(new.split()[1]) and cards[i] not in new and not any(old in new for old in (f"a{i}@b.org", f"10.0.{i}.7 "))
        assert len(new.split()[1]) == 16 and new.split()[3][4] == "-"
    assert len({got[i].text.split()[1] for i, _ in rows}) == len(set(cards))
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, restore=True).collect()}
    for i, text in rows:
        assert back[i].split(" from ")[0] == text.split(" from ")[0]
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, key="another key").collect()}
    assert all(other[i] != got[i].text for i, _ in rows)


def test_what_does_not_validate_stays(spark):
    texts = ["1234567890123456", "2023-02-30", "999.1.1.1", "666-12-1234", "v3.0.1", "4.0.", "12/34"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.text for r in pii.pseudonymise(df).collect()) == sorted(texts)


def test_long_secrets_are_replaced_whole(spark):
    values = [("Ab3_-xY9" * 100)[:n] for n in (8, 64, 128, 129, 164, 700)]
    df = spark.createDataFrame([(i, f"api_key = {v}, end") for i, v in enumerate(values)], "doc_id long, text string")
    for r in pii.pseudonymise(df).collect():
        new = r.text.removeprefix("api_key = ").removesuffix(", end")
        assert r.pii_counts == {"secret": 1} and len(new) == len(values[r.doc_id])
        assert re.fullmatch("[0-9a-f]+", new)


def test_iban_and_plan_is_native(spark):
    df = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("GB82WEST12345698765432",)], "text string")
    out = [r.text for r in pii.pseudonymise(df).collect()]
    for t in out:
        c = t.replace(" ", "")
        assert int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    assert out[0][:2] == "DE" and out[0].count(" ") == 5 and out[1][4:8] == "WEST"
    plan = pii.pseudonymise(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- mixing and packing -----------------------------------------------------------------


def test_counts_invert_the_distribution(spark):
    df = spark.createDataFrame([(0.3,), (2.5,), (40.0,), (900.0,)], "rate double").select("rate", mixing.poisson_cdf("rate").alias("c"))
    for r in df.collect():
        p = [math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1)) for k in range(len(r.c))]
        assert np.allclose(np.cumsum(p), r.c, atol=1e-9) and abs(r.c[-1] - 1) < 1e-9


def test_mixture_meets_its_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(df, {"small": 3.0, "large": 1.0}).groupBy("source").count().collect()}
    assert abs(n["small"] - 15_000) < 500 and abs(n["large"] - 5_000) < 300
    a = [r.shuffle_key for r in mixing.mix(df, {"small": 1.0}).collect()]
    assert sorted(a) == sorted(r.shuffle_key for r in mixing.mix(df.repartition(7), {"small": 1.0}).collect())


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_optimal(buckets):
    rng = random.Random(buckets)
    for _ in range(15):
        lengths = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 25))]
        hist = [(v, lengths.count(v)) for v in sorted(set(lengths))]
        cost = lambda tops: sum(min(t for t in tops if t >= x) - x for x in lengths)  # noqa: E731, B023
        values = [h[0] for h in hist]
        best = min(cost((*cut, values[-1])) for k in range(min(buckets, len(values))) for cut in itertools.combinations(values[:-1], k))
        tops = packing.boundaries(hist, buckets)
        assert cost(tops) == best and len(tops) <= buckets and tops == sorted(set(tops))


def test_batches_keep_their_budget(spark, data):
    from winnower.llm import common

    rows = packing.pack(common.table(spark, data, "documents"), budget=4096, shard_rows=50).select("batch_id", "slot", "bucket_len", "n_tokens").collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch_id, []).append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and (len(rs) == 1 or len(rs) * rs[0].bucket_len <= 4096)


# --- archives ---------------------------------------------------------------------------


def archive(n=5):
    return [warc.write_record("response", f"http://x/{i}\r\nInjected: 1", {"X-Page-ID": str(i), "WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"body%d" % i).hexdigest()}, b"body%d" % i) for i in range(n)]


def kinds(data):
    return [(type(x).__name__, x.offset, x.length) for x in warc.salvage(data)]


def test_salvage_covers_every_byte():
    parts = archive()
    whole = b"".join(parts)
    assert [k for k, *_ in kinds(whole)] == ["Record"] * 5
    cut = len(parts[0])
    damaged = bytearray(whole)
    damaged[cut + 20 : cut + 26] = b"\0\0\0\0\0\0"
    for data, lost in ((bytes(damaged), 1), (whole[: cut + 10] + whole[cut + len(parts[1]) :], 1), (b"junk" + whole, 0), (whole + whole[:15], 0), (whole[:-3], 1)):
        got = kinds(data)
        assert sum(k == "Record" for k, *_ in got) == 5 - lost and any(k == "Gap" for k, *_ in got)
        assert sum(n for *_, n in got) == len(data) and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert kinds(b"") == [] and kinds(b"\x1f\x8b\x08") == [("Gap", 0, 3)]


def test_plain_archives_too():
    block = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n"
    got = list(warc.salvage(block + bad + block))
    assert [type(x).__name__ for x in got] == ["Record", "Gap", "Record"] and got[0].block == b"abc" and got[1].length == len(bad)


def test_files_and_digests(spark, tmp_path):
    good, bad = archive(2), warc.write_record("response", "u", {"WARC-Payload-Digest": "sha1:00"}, b"x")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(good) + bad)
    rows = warc.read_files(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.gap, r.page_id, bytes(r.payload) if r.payload is not None else None) for r in rows] == [(None, 0, b"body0"), (None, 1, b"body1"), ("payload digest", None, None)]


# --- media ------------------------------------------------------------------------------


def test_payloads_round_trip():
    rng = np.random.default_rng(0)
    payloads = [jpeg.payload_of(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 1, 63, 64, 65, 513, 9000, 70_000)] + [bytes([b]) * 64 for b in (0, 127, 128, 255)]
    images = [jpeg.parse(d) for d in jpeg.encode_payloads(payloads)]
    jpeg.decode(images)
    assert [jpeg.payload_in(i) for i in images] == payloads
    assert all(len(p) % 64 == 0 and p for p in payloads)


def colour_image(width, height, dc):
    """A 4:2:0 image without restart intervals; ``dc(component, k)`` gives the k-th block's DC."""
    lengths = {s: 4 for s in range(12)}
    counts, symbols = jpeg._spec(lengths)
    ac_counts, ac_symbols = jpeg._spec({0: 1})
    code = {s: (c, n) for s, c, n in jpeg._codes(counts, symbols)}
    bits, seen, last = "", [0, 0, 0], [0, 0, 0]
    for _ in range(-(-width // 16) * -(-height // 16)):
        for comp, blocks in ((0, 4), (1, 1), (2, 1)):
            for _ in range(blocks):
                v = dc(comp, seen[comp])
                seen[comp] += 1
                diff, last[comp] = v - last[comp], v
                size = abs(diff).bit_length()
                c, n = code[size]
                bits += format(c, f"0{n}b") + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [16] + [1] * 63)) + seg(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, bytes([0x00, *counts, *symbols])) + seg(0xC4, bytes([0x10, *ac_counts, *ac_symbols])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_ordinary_colour_images():
    im = jpeg.parse(colour_image(32, 16, lambda comp, k: (k * 7 - 20) if comp == 0 else 3))
    jpeg.decode([im])
    want = np.array([[k * 7 - 20 for k in row] for row in ([0, 1, 4, 5], [2, 3, 6, 7])])
    assert (jpeg.luminance(im) == np.clip((want * 16 + 4) // 8 + 128, 0, 255)).all() and (im.width, im.height) == (32, 16)


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"not an image at all", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_bad_images(data):
    with pytest.raises(jpeg.BadImage):
        jpeg.parse(data)


def test_damaged_scans_are_told(spark):
    good = jpeg.encode_payloads([jpeg.payload_of(b"hello" * 500)])[0]
    at = good.index(b"\xff\xda") + 40
    damaged = good[:at] + bytes(200) + good[at + 200 :]
    df = spark.createDataFrame([(1, good), (2, damaged[:-300]), (3, None), (4, b"x")], "id long, media binary")
    got = {r.id: r for r in jpeg.media_features(df).collect()}
    assert got[1].error is None and got[1].payload_bytes == 2560 and all(got[k].error for k in (2, 3, 4))
    assert got[1].tail_crc32 == zlib.crc32(jpeg.payload_of(b"hello" * 500)[-64:])


# --- languages ----------------------------------------------------------------------------


def test_held_out_accuracy(spark, data):
    from winnower.llm import common

    out = registry.QUERIES["op10_langid"](spark, data).join(common.table(spark, data, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_model_is_sparse_and_calibrated(spark, data):
    from winnower.llm import common

    model = langid.train(common.table(spark, data, "documents"))
    assert 0 < (model.weights != 0).sum() < 0.5 * langid.FEATURES * len(model.languages) and 0.05 <= model.temperature <= 20
    assert not model.weights[0].any() and model.weights[1:].any(axis=1).all()
    counts = [c for c, _ in langid.counts_of(["the cat", None, "x" * (langid.PIECE + 5)])]
    assert counts[1].sum() == 0 and counts[2].sum() > langid.PIECE
    assert [x for _, x in langid.counts_of(["12 !", "é"])] == [False, True]


def test_counts_do_not_depend_on_the_batch():
    texts = ["One two", "", "drei-vier", "cinq"]
    together = [c for c, _ in langid.counts_of(texts)]
    apart = [next(iter(langid.counts_of([t])))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, apart, strict=True))


# --- the pipeline -------------------------------------------------------------------------


def test_pipeline(spark, data):
    import corpus_pipeline as p
    from winnower.llm import common

    docs = common.table(spark, data, "documents")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, data), name)
        assert docs.columns == columns and docs.count() > 0
    out = p.STAGES[-1][1](spark, docs, data)
    assert out.count() == docs.count() and [n for n, _ in p.STAGES] == ["language", "lines", "near_duplicates", "mixture", "batches"]
