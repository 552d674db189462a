"""Archives as crawlers write them: digests in base32, HTTP payloads, long files, long records."""

import base64
import hashlib
import time

import pytest

from winnower.llm import warc


def http_record(body, *, encoding, wrong=False, chunked=False, block_digest=None):
    sent = b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 7]), body[k : k + 7]) for k in range(0, len(body), 7)) + b"0\r\n\r\n" if chunked else body
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + (b"Transfer-Encoding: chunked\r\n" if chunked else b"") + b"\r\n" + sent
    raw = hashlib.sha1(body + b"!" * wrong).digest()
    said = {"hex": raw.hex(), "HEX": raw.hex().upper(), "base32": base64.b32encode(raw).decode()}[encoding]
    head = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{said}", "X-Page-ID": "7"}
    head["WARC-Block-Digest"] = block_digest or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    return warc.write_record("response", "http://x/", head, block)


def rows(data):
    return [warc._row("a", x) for x in warc.salvage(data)]


@pytest.mark.parametrize("encoding", ["hex", "HEX", "base32"])
@pytest.mark.parametrize("chunked", [False, True])
def test_digests_of_http_payloads(encoding, chunked):
    body = b"<p>some page</p>"
    ((_, _, _, gap, kind, uri, page, size, digest, _, head, payload),) = rows(http_record(body, encoding=encoding, chunked=chunked))
    assert gap is None and (kind, uri, page) == ("response", "http://x/", 7) and head.startswith("HTTP/1.1 200 OK")
    assert size == len(payload) and digest == hashlib.sha1(payload).hexdigest() and (chunked or payload == body)
    assert [r[3] for r in rows(http_record(body, encoding=encoding, wrong=True, chunked=chunked))] == ["payload digest"]


def test_block_digests_and_other_algorithms():
    assert [r[3] for r in rows(http_record(b"x", encoding="hex", block_digest="sha256:" + "0" * 64))] == ["block digest"]
    good = http_record(b"x", encoding="hex", block_digest="blake2s:what")
    assert [r[3] for r in rows(good)] == [None]
    assert warc.stated_digest("SHA-1:" + "AB" * 20) == ("sha1", "ab" * 20) and warc.stated_digest("none") is None and warc.stated_digest("sha1:!") == ("sha1", "!")


def test_time_grows_with_the_archive():
    part = b"".join(warc.write_record("resource", f"u{k}", {}, hashlib.sha256(b"%d" % k).digest() * 40) for k in range(1000))

    def seconds(times):
        data = part * times
        began = time.process_time()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(data)) == 1000 * times
        return time.process_time() - began

    seconds(1)
    assert seconds(64) < 12 * max(seconds(8), 0.02)


def test_damage_in_a_long_archive_takes_no_longer():
    part = b"".join(warc.write_record("resource", f"u{k}", {}, hashlib.sha256(b"%d" % k).digest() * 40) for k in range(4000))
    damaged = bytearray(part)
    for at in range(500, len(damaged), 3000):
        damaged[at : at + 4] = b"\1\2\3\4"
    began = time.process_time()
    got = list(warc.salvage(bytes(damaged)))
    assert time.process_time() - began < 20 and sum(x.length for x in got) == len(part)
    assert sum(isinstance(x, warc.Record) for x in got) > 1000


def test_bombs_and_long_records(monkeypatch):
    big = warc.write_record("resource", "u", {}, bytes(1 << 22))
    small = warc.write_record("resource", "u", {}, b"abc")
    assert [len(x.block) for x in warc.salvage(big + small)] == [1 << 22, 3]
    monkeypatch.setattr(warc, "MAX_RECORD", 1 << 20)
    got = list(warc.salvage(big + small))
    assert isinstance(got[0], warc.Gap) and got[0].reason == "record too large" and got[-1].block == b"abc"


def test_long_pages_and_odd_columns(spark, tmp_path):
    rows_ = [(1, "http://a/", "x" * 3_000_000, "c", "d"), (2, "http://a/", "x" * 3_000_000, "c", "d"), (2, "http://a/", "x" * 3_000_000, "c", "d")]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string, `a.b` string, payload string")
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(spark.read.parquet(path)).collect())
    assert [g[1] for g in got] == ["revisit", "response", "response"] and {g[2] for g in got} == {3_000_000}
