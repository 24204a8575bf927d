import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from tensorloom.llm import warc
from tensorloom.llm.common import shared_path
from tensorloom.llm.line_dedup import drop_boilerplate, html_text
from tensorloom.llm.queries import op3_warc

PAGES = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_bundle_is_seekable():
    writer, records = warc.BundleWriter(frame_bytes=300), {}
    for i in range(20):
        payload = f"<p>{i}</p>".encode() * (i + 1)
        records[str(i)] = warc.record(str(i), f"http://h/{i}", hashlib.sha256(payload).hexdigest(), len(payload), payload, None)
        writer.add(str(i), records[str(i)])
    data = writer.finish()
    assert len(warc.seek_table(data)) > 3
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records.values())
    for place in reversed(writer.index):
        assert warc.read_record(data, place["frame"], place["offset"], place["length"]) == records[place["record_id"]]
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1])


def test_odd_pages(spark):
    same = "x" * 100
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 9), (9, "u", "z" * 3_000_000), (9, "u", "z" * 3_000_000), (None, "u", same)]
    own = {c: F.lit("mine") for c in ("record_type", "PAYLOAD_DIGEST", "refers_to", "payload_bytes", "record_id", "uri", "bundle", "index")}
    frame = warc.with_revisits(pages(spark, rows).withColumns(own))
    assert [c.lower() for c in frame.columns].count("payload_digest") == 1
    path = shared_path(spark, "test")
    read = warc.read_bundles(warc.write_bundles(frame, path, frame_bytes=1000, bundle_bytes=100_000))
    found = sorted((r["record_id"], r["payload_bytes"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"").decode()) for r in read.collect())
    z = "z" * 3_000_000
    assert found == sorted([("1", 100, "response", None, same), ("2", 100, "revisit", "1", ""), ("3", 99, "response", None, "x" * 99), ("4", 99, "response", None, "x" * 99), ("5", 0, "response", None, ""), ("6", 0, "response", None, ""), ("7", 100, "response", None, "é" * 50), ("8", 135, "response", None, rows[7][2]), ("9", 3_000_000, "response", None, z), ("9", 3_000_000, "response", None, z), ("null", 100, "revisit", "1", "")])


def test_no_pages(spark, tmp_path):
    frame = warc.with_revisits(spark.createDataFrame([], PAGES))
    path = shared_path(spark, "test")
    assert warc.read_bundles(warc.write_bundles(frame, path)).count() == 0
    assert warc.export_bundles(spark, path, str(tmp_path)) == 0


def test_export(spark, tmp_path):
    frame = warc.with_revisits(pages(spark, [(1, "http://a", "hello"), (2, "http://b", "there")]))
    path = shared_path(spark, "test")
    warc.write_bundles(frame, path)
    assert warc.export_bundles(spark, path, str(tmp_path)) >= 1
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True).read() for f in tmp_path.iterdir())
    assert text.count(b"WARC-Type: response") == 2 and b"hello" in text
    for bundle in spark.read.schema(warc.BUNDLES).parquet(path).collect():
        for place in bundle["index"]:
            found = warc.seek_record(tmp_path / f"{bundle['bundle']}.warc.zst", place["frame"], place["offset"], place["length"])
            assert found == warc.read_record(bytes(bundle["data"]), place["frame"], place["offset"], place["length"])
            assert f"<urn:record:{place['record_id']}>".encode() in found


def test_damage_is_seen(spark):
    bad = warc.record("1", "u", "0" * 64, 5, b"hello", None)
    writer = warc.BundleWriter()
    writer.add("1", bad)
    frame = spark.createDataFrame([("b", bytearray(writer.finish()), [])], warc.BUNDLES)
    with pytest.raises(Exception, match="damaged"):
        warc.read_bundles(frame).collect()


def test_query_reads_every_page(spark):
    sf = "/root/testdata/sf0.001"
    assert op3_warc(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_lines(spark):
    menu = "<p>Menu</p><p> Home </p>"
    rows = [(i, f"https://Site.org/{i}", f"{menu}<b>text {i}</b><i>text {i}</i>") for i in range(10)]
    rows += [(20 + i, "https://other.org", f"{menu}{i}") for i in range(2)]
    rows += [(30, None, menu), (31, "nothing", menu), (32, "https://site.org/x", None), (33, "https://site.org/y", ""), (9, "https://site.org/9", menu)]
    found = {}
    for r in drop_boilerplate(pages(spark, rows), html_text("html")).collect():
        found.setdefault(r["page_id"], []).append((r["host"], r["n_lines"], r["n_dropped"], r["clean_text"]))
    assert found[3] == [("site.org", 4, 2, "text 3\ntext 3")]
    assert found[20] == [("other.org", 3, 0, "Menu\nHome\n0")]  # two pages are no boilerplate
    assert found[30] == found[31] == [(None, 2, 0, "Menu\nHome")]
    assert found[32] == found[33] == [("site.org", 0, 0, "")]
    assert sorted(found[9]) == [("site.org", 2, 2, ""), ("site.org", 4, 2, "text 9\ntext 9")]
    assert drop_boilerplate(spark.createDataFrame([], PAGES), html_text("html")).count() == 0


def test_lines_of_one_large_site(spark):
    rows = [(i, "http://hot.org" if i % 3 else f"http://h{i}.org", f"<p>top</p>line {i}") for i in range(3000)]
    own = pages(spark, rows).withColumns({c: F.lit("mine") for c in ("host", "N_LINES", "n_dropped", "clean_text", "__n")})
    found = drop_boilerplate(own, html_text("html"))
    assert found.columns == ["page_id", "url", "html", "__n", "host", "n_lines", "n_dropped", "clean_text"]
    assert found.where("host = 'hot.org' AND n_dropped = 1").count() == 2000
    assert found.where("n_dropped > 0").count() == 2000


def test_very_long_pages(spark):
    """Lines of a megabyte, and a hundred thousand lines on one page."""
    long = "z" * 1_000_000
    rows = [(i, "http://a.org", f"<p>{long}</p><p>line {i}</p>") for i in range(4)] + [(9, "http://a.org", "".join(f"<p>{k % 7} of many {k}</p>" for k in range(100_000)))]
    found = {r["page_id"]: r for r in drop_boilerplate(pages(spark, rows), html_text("html")).collect()}
    assert all((found[i]["n_lines"], found[i]["n_dropped"], found[i]["clean_text"]) == (2, 1, f"line {i}") for i in range(4))
    assert (found[9]["n_lines"], found[9]["n_dropped"]) == (100_000, 0)
