import io

import pytest
import zstandard

from graphloom.llm import warc
from graphloom.llm.common import fresh_dir


def test_round_trip_and_revisits(spark):
    big, rows = "x" * 1200 + "é", [(1, "u1", "small"), (2, "u2", "small"), (3, None, None), (None, "u", "q" * 1500), (None, "u", "only")]
    rows += [(i, f"http://h/{i}", big) for i in range(10, 60)] + [(60, "dup", "y" * 3000), (60, "dup", "y" * 3000)]
    rows += [(61, "long", "z é\r\n\r\n" * 400_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    html = {}
    for p, _, h in rows:
        html.setdefault(p, []).append(h or "")
    for p, rs in by.items():
        assert sorted(r.payload_bytes for r in rs) == sorted(len(h.encode()) for h in html[p])
        for r in rs:
            assert (r.record_type == "revisit") == (10 <= (p or 0) < 59)
            assert r.refers_to == (59 if r.record_type == "revisit" else None)
            assert bytes(r.payload).decode() in ([""] if r.record_type == "revisit" else html[p])
    assert warc.archive(pages.limit(0)).count() == 0


def test_layout_and_damage(spark):
    recs = [warc.record_bytes(i, "u", b"p%d" % i, 2, __import__("hashlib").sha1(b"p%d" % i).hexdigest(), "response", None) for i in range(5)]
    words = warc.dictionary_of(recs)
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    whole = warc.skippable(words) + b"".join(press.compress(r) for r in recs)
    assert list(warc.frames(io.BytesIO(whole))) == recs
    assert [warc.parse_record(r)["page_id"] for r in recs] == list(range(5))
    for bad in (whole[:-3], whole[:20], whole + b"junk"):
        with pytest.raises((warc.BadRecord, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(bad)))
    for bad in (recs[0].replace(b"p0", b"p9"), recs[0][:-1], recs[0].replace(b"Content-Length: 2", b"Content-Length: 7"), recs[0].replace(b"WARC-Type: response\r\n", b""), b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
    files = spark.createDataFrame([("x",)], "file string")
    assert files.count() == 1 and fresh_dir(spark, "a") != fresh_dir(spark, "a")
