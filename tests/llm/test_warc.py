"""WARC: round trip, salvage by every kind of damage, ranges, and many small mutations."""

import base64
import hashlib

import numpy as np
import pyarrow.fs
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import warc


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é"), (None, "u", "x"), (9, "u", "y" * 100000)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7 and (got[2]["record_type"], got[1]["refers_to"], got[None]["refers_to"], got[3]["refers_to"]) == ("response", 2, 2, 4)
    assert got[5]["payload_bytes"] == 2 and got[1]["payload_bytes"] == 1 and got[1]["payload_digest"] == warc.sha1_base32(b"x")
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    parts = [warc.record("response", [("WARC-Record-ID", f"<urn:page:{i}>")], warc.http(5, b"hello")) for i in range(5)]
    parts = [warc.member(p) for p in parts] if compress else parts
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + b"noise" + parts[1] + bytes(broken) + parts[3] + parts[4][:-9]
    found = list(warc.salvage(data))
    assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>"]
    assert sum(x[0] == "gap" for x in found) == 3 and [x[1] for x in found[1:]] == [x[2] for x in found[:-1]] and found[-1][2] == len(data)


def test_warc_members_of_several_records(spark, tmp_path):
    parts = [warc.record("response", [("WARC-Record-ID", f"<urn:page:{i}>")], warc.http(5, b"hello")) for i in range(6)]
    broken = bytearray(parts[3])
    broken[broken.index(b"hello")] ^= 0xFF
    members = [warc.member(parts[0] + parts[1]), warc.member(parts[2] + bytes(broken) + parts[4] + b"noise"), warc.member(b"noise"), warc.member(parts[5])]
    found = list(warc.salvage(b"".join(members)))
    ends = np.cumsum([0] + [len(m) for m in members]).tolist()
    assert [(x[0], x[3]["warc-record-id"][10:-1] if x[0] == "record" else None, ends.index(x[1]), ends.index(x[2])) for x in found] == [
        ("record", "0", 0, 1), ("record", "1", 0, 1), ("record", "2", 1, 2), ("gap", None, 1, 2), ("record", "4", 1, 2), ("gap", None, 1, 2), ("gap", None, 2, 3), ("record", "5", 3, 4)
    ]
    (tmp_path / "one.warc.gz").write_bytes(warc.member(b"".join(parts)))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert [(r["kind"], r["record_id"], bytes(r["payload"])) for r in got] == [("record", f"<urn:page:{i}>", b"hello") for i in range(6)]



PARTS = [warc.record("response", [("WARC-Record-ID", f"<urn:page:{i}>")], warc.http(5, b"hello" * (i + 1))) for i in range(5)]


@settings(max_examples=300, deadline=None)
@given(st.booleans(), st.lists(st.tuples(st.floats(0, 1), st.binary(max_size=12), st.integers(0, 30)), max_size=4))
def test_mutations_never_raise_and_cover_all_bytes(compress, changes):
    data = b"".join(warc.member(p) if compress else p for p in PARTS)
    for where, new, gone in changes:
        at = int(where * len(data))
        data = data[:at] + new + data[at + gone :]
    found = list(warc.salvage(data))
    edges = sorted({(x[1], x[2]) for x in found})
    assert not data or (edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:])))
    sound = [i for i, p in enumerate(PARTS) if (warc.member(p) if compress else p) in data]
    ids = [x[3].get("warc-record-id") for x in found if x[0] == "record"]
    assert all(f"<urn:page:{i}>" in ids for i in sound) or b"WARC/1" in b"".join(c[1] for c in changes) or b"\x1f\x8b" in b"".join(c[1] for c in changes)


def test_lengths_of_many_digits_are_damage():
    bad = PARTS[0].replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000, 1)
    bad_http = warc.record("revisit", [("WARC-Record-ID", "<urn:page:8>")], b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n")
    found = list(warc.salvage(bad + PARTS[1] + bad_http))
    assert [x[0] for x in found] == ["gap", "record", "record"]
    assert warc._payload("revisit", found[-1][4])[0] == 0


def test_digest_forms_and_folded_headers():
    block = warc.http(2, b"hi")
    forms = [hashlib.sha1(block).hexdigest(), hashlib.sha1(block).hexdigest().upper(), base64.b32encode(hashlib.sha1(block).digest()).decode().lower(), warc.sha1_base32(block)]
    for kind, form in [*(("sha1", f) for f in forms), ("SHA1", forms[0]), ("md5", "x")]:
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n  b\r\nWARC-Block-Digest: {kind}:{form}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        (found,) = warc.salvage(head + block + b"\r\n\r\n")
        assert found[0] == "record" and found[3]["warc-target-uri"] == "http://a/ b"
    assert next(warc.salvage(head.replace(b"md5:x", b"sha1:" + b"0" * 40) + block + b"\r\n\r\n"))[0] == "gap"


@pytest.mark.parametrize("compress", [True, False])
def test_streams_read_as_whole_files(tmp_path, monkeypatch, compress):
    monkeypatch.setattr(warc, "_STEP", 64)
    rng = np.random.default_rng(4)
    data = b""
    for k in range(40):
        p = PARTS[k % 5]
        data += (warc.member(p) if compress else p) + (rng.bytes(int(rng.integers(0, 300))) if k % 7 == 3 else b"")
    (tmp_path / "a.warc").write_bytes(data)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc")) as f:
        assert list(warc.salvage(warc.Stream(f))) == list(warc.salvage(data))


def test_read_whole_where_streams_are_not_to_be_had(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc").write_bytes(b"".join(PARTS) + b"noise")
    (tmp_path / "b.warc").write_bytes(b"")
    want = warc.read(spark, f"file://{tmp_path}").drop("file").collect()
    monkeypatch.setattr(warc, "_openable", lambda path: False)
    assert warc.read(spark, f"file://{tmp_path}").drop("file").collect() == want and [r["kind"] for r in want] == ["record"] * 5 + ["gap"]


def test_rows_that_tie_and_other_columns(spark, monkeypatch):
    rows = [(1, "u", "x", "a", 1), (1, "u", "x", "a", 1), (None, "u", "x", "b", 2), (4, "u", "z" * 3_000_000, "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, rid int")
    for most in (500_000, 0):
        monkeypatch.setattr(warc, "_SEND_ROWS", most)
        got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect()), key=repr)
        assert got == [(1, "response", None, 1), (1, "revisit", 1, 1), (4, "response", None, 3_000_000), (None, "revisit", 1, 1)]
    kinds = [r["record_type"] for r in warc.round_trip(pages, least_bytes=2).collect()]
    assert kinds == ["response"] * 4
