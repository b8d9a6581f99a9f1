import base64
import hashlib

import pytest

from cueloom.llm import warc


def pages(spark, rows):
    shape = "page_id long, url string, html string, path string, original string, content string"
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], shape)


def brute(rows, min_bytes=0):
    top = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= min_bytes and i is not None:
            top[body] = max(top.get(body, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = len(body) >= min_bytes and body in top and i != top[body]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", top[body] if revisit else None))
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, "http://a b\r\n/3", "é ünï 日本 🙂"),
    (4, None, ""), (5, "http://a/5", None), (6, "http://a/6", "ends\r\n\r\n"), (7, "x", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n\r\n\r\n"),
    (8, "http://a/8", "long " * 60_000), (10, "http://a/10", "nul \x00 inside\n"),
]


@pytest.mark.parametrize("min_bytes", [0, 1, 5])
def test_same_records_as_plain_rules(spark, min_bytes):
    assert shown(warc.deduplicate(pages(spark, ROWS), min_bytes)) == brute(ROWS, min_bytes)


def test_archives_hold_the_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    warc.deduplicate(pages(spark, ROWS), folder=str(tmp_path)).collect()
    seen = {}
    for r in warc._files(spark, str(tmp_path / "dedup")).collect():
        for head, block in warc.walk(bytes(r["content"])):
            seen[int(head["X-Page-Id"])] = (head, block)
    bodies = {i: (h or "").encode() for i, _, h in ROWS}
    for i, (head, block) in seen.items():
        assert int(head["Content-Length"]) == len(block) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        body = block.partition(b"\r\n\r\n")[2]
        assert body == (bodies[i] if head["WARC-Type"] == "response" else b"")
        if head["WARC-Type"] == "revisit":
            assert head["WARC-Refers-To"] in {h["WARC-Record-ID"] for h, _ in seen.values()} and head["WARC-Profile"] == warc.PROFILE
    assert len(seen) == len(ROWS) and len({h["WARC-Record-ID"] for h, _ in seen.values()}) == len(ROWS)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "u", "same"), (1, "u", "same"), (1, "u", "same"), (2, "u", "alone")]
    got = shown(warc.deduplicate(pages(spark, rows)))
    kinds = sorted((str(r[0]), r[3], r[4]) for r in got)
    assert kinds == [("1", "response", None), ("1", "revisit", 1), ("2", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_empty_table(spark):
    assert warc.deduplicate(pages(spark, [])).collect() == []


def test_archives_of_others(spark, tmp_path):
    """Other record types, other cases of names, no digests, revisits that were there before, records without an id."""
    import gzip

    def record(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"warc-type: {kind}", *more, f"CONTENT-LENGTH: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    folder = tmp_path / "crawl"
    folder.mkdir()
    one = record("warcinfo", b"software: other", "WARC-Record-ID: <i>") + record("response", http + b"\xff\x00same", "warc-record-id: <a>", "WARC-Target-URI: http://a/")
    two = record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Record-ID: <q>") + record("response", http + b"\xff\x00same", "WARC-Record-ID: <b>")
    two += record("revisit", http, "WARC-Record-ID: <r>", "WARC-Payload-Digest: sha1:ABC", "WARC-Refers-To: <a>") + record("response", http + b"no id")
    (folder / "x.warc.gz").write_bytes(gzip.compress(one[: len(one) // 2]) + gzip.compress(one[len(one) // 2 :]))
    (folder / "y.warc.gz").write_bytes(gzip.compress(two))
    heads = warc.read_headers(spark, str(folder), "*.warc.gz")
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in heads.collect()}
    same = base64.b32encode(hashlib.sha1(b"\xff\x00same").digest()).decode()
    assert got["<i>"] == ("warcinfo", None, None) and got["<q>"] == ("request", None, None) and got["<r>"] == ("revisit", None, "ABC")
    assert got["<a>"] == got["<b>"] == ("response", 6, same) and got[None][:2] == ("response", 5)
    decided = warc.resolve(heads)
    assert [(r["record_id"], r["original"]) for r in decided.collect()] == [("<a>", "<b>")]
    warc.rewrite(spark, str(folder), decided, str(tmp_path / "out"), 6, "*.warc.gz")
    seen = [(h, b) for r in warc._files(spark, str(tmp_path / "out")).collect() for h, b in warc.walk(bytes(r["content"]))]
    kinds = sorted((h["WARC-Type"], b) for h, b in seen)
    assert kinds == sorted([("warcinfo", b"software: other"), ("request", b"GET / HTTP/1.1\r\n\r\n"), ("revisit", http), ("revisit", http),
                            ("response", http + b"\xff\x00same"), ("response", http + b"no id")])
    fresh = {warc._fresh("<a>"), warc._fresh("<b>")}
    assert fresh <= {h.get("WARC-Record-ID") for h, _ in seen} and {h.get("WARC-Refers-To") for h, _ in seen} == {None, "<a>", warc._fresh("<b>")}


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    rows = [(i, f"http://a/{i}", f"{i} " + "x" * 100_000) for i in range(9)]
    assert shown(warc.deduplicate(pages(spark, rows).coalesce(1), folder=str(tmp_path))) == brute(rows)
    for part in ("crawl", "dedup"):
        counts = [sum(1 for _ in warc.walk(bytes(r["content"]))) for r in warc._files(spark, str(tmp_path / part)).collect()]
        assert sum(counts) == 9 and max(counts) <= 2
