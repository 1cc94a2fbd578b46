import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm.warc import on_chain, read_archives, round_trip, scan, write_archives

SCHEMA = "page_id long, url string, html string, payload string"
FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_magic_inside_payloads(spark, tmp_path):
    rows = [(k, f"http://h/{k}", t, "x") for k, t in enumerate(["<p>a</p>", FAKE, FAKE * 3 + "é", "<p>a</p>", "", None, "\r\n\r\n", "WARC/1.0\r\n", "x" * 200_000])]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = str(tmp_path / "w")
    write_archives(pages, path, compression="none")
    seen = [c for f in (tmp_path / "w").glob("part-*") for c in scan(f.read_bytes())]
    assert len(seen) > len(rows)  # candidates inside payloads
    got = {r.page_id: r for r in read_archives(spark, path).collect()}
    first = {}
    for k, _, t, _ in rows:
        first.setdefault(t or "", k)
    assert set(got) == set(range(len(rows)))
    for k, u, t, _ in rows:
        r = got[k]
        assert (r.url, r.payload_bytes, r.payload_digest) == (u, len((t or "").encode()), b32(t))
        assert (r.record_type, r.refers_to) == (("response", None) if first[t or ""] == k else ("revisit", first[t or ""]))
        assert r.digest_ok is (True if r.record_type == "response" else None)


def test_broken_archive_ends_there(spark, tmp_path):
    write_archives(spark.createDataFrame([(k, "u", f"page {k}", "") for k in range(6)], SCHEMA).coalesce(1), str(tmp_path / "w"), compression="none")
    (file,) = (tmp_path / "w").glob("part-*")
    raw = file.read_bytes()
    records = list(scan(raw))
    (tmp_path / "cut.warc").write_bytes(raw[: records[4][0] + 20])
    assert sorted(r.page_id for r in read_archives(spark, str(tmp_path / "cut.warc")).collect()) == sorted(c[2] for c in records[:4])


def test_odd_rows(spark):
    rows = [(3, None, "same", "x"), (3, None, "same", "x"), (None, "a\r\nb", "same", "x"), (5, "u", "same", None), (None, "u", "alone", None)]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(3, "response", None), (3, "response", None), (None, "revisit", 3), (5, "revisit", 3), (None, "response", None)], key=str)
    big = round_trip(spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], SCHEMA), least_bytes=3)
    assert {r.record_type for r in big.collect()} == {"response"}


def test_chain_is_followed():
    off = np.array([*range(700), 5000])
    assert on_chain(off, off + 1).tolist() == [True] * 700 + [False]
    off, follows = np.array([0, 10, 15, 30, 40]), np.array([30, 20, 30, 99, 50])
    assert on_chain(off, follows).tolist() == [True, False, False, True, False]
    assert on_chain(np.array([5]), np.array([9])).tolist() == [False]


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_malformed_fields(spark):
    head = "WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%s>\r\nX-Payload-Length: %s\r\nContent-Length: %s\r\n\r\nabc\r\n\r\n"
    fakes = [head % x for x in [("revisit", "7", "abc", "3"), ("revisit", "7", "3", "²"), ("response", "9" * 30, "3", "3"), ("revisit", "1", "9" * 40, "3"), ("x", "1", "3", "9" * 40)]]
    fakes += ["WARC/1.0\r\n" * 50 + "\r\n", "WARC/1.0\r\n\r\n\r\n\r\n", "WARC/1.1\r\n: x\r\nno colon\r\n\r\n", "\ud800".encode("utf-8", "replace").decode()]
    rows = [(k, f"u\r\n{k}", t, "x") for k, t in enumerate(fakes)]
    got = {r.page_id: r for r in round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.payload_digest for k, r in got.items()} == {k: b32(t) for k, _, t, _ in rows}
    for t in fakes:
        list(scan(t.encode()))


def test_magic_lines_take_linear_time():
    import time

    began = time.process_time()
    assert list(scan(b"WARC/1.0\r\n" * 100_000 + b"\r\n\r\n")) == []
    assert list(scan((b"WARC/1.0\r\n" + b"a: b\r\n" * 5) * 25_000)) == []
    assert time.process_time() - began < 2


@pytest.mark.parametrize("url", ["http://specs.org/WARC/1.0", "http://h/" + "u" * 70_000, "WARC/1.0", "Content-Length: 3", "a: b", "x\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\n"])
def test_odd_urls_lose_no_page(spark, url):
    for place in range(6):
        rows = [(k, url if k == place else f"http://h/{k}", f"page {k}", "") for k in range(6)]
        got = {r.page_id: r for r in round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
        assert set(got) == set(range(6)) and got[place].url == url.replace("\r", "").replace("\n", "")
        assert all(got[k].payload_digest == b32(f"page {k}") for k in range(6))


ODD = st.lists(st.one_of(st.sampled_from(["WARC/1.0", "\r\n", "\n", " ", ":", FAKE, "Content-Length: 7", "é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"]), st.text(alphabet="aé\t\x00 ", max_size=6)), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), min_size=1, max_size=8))
def test_any_urls_and_payloads(spark, pairs):
    rows = [(k, u, t, "") for k, (u, t) in enumerate(pairs)]
    got = {r.page_id: r for r in round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert set(got) == set(range(len(rows)))
    for k, u, t, _ in rows:
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(t.encode()), b32(t))
        assert got[k].url.strip() == u.replace("\r", "").replace("\n", "").strip()


def test_a_long_page_changes_no_other_file(spark, tmp_path):
    rows = [(k, "u", f"page {k}", "") for k in range(60)]
    long = [(99, "u", "x" * (30 << 20), "")]
    for name, data, files in (("few", rows, 1), ("more", rows + long, 2)):
        write_archives(spark.createDataFrame(data, SCHEMA).coalesce(1), str(tmp_path / name))
        assert len(list((tmp_path / name).glob("part-*"))) == files
    assert read_archives(spark, str(tmp_path / "more")).count() == 61
