import hashlib
import io

import pytest
import zstandard

from inferweave.llm import warc

PAGES = "page_id long, url string, html string, record_type string"


def test_round_trip(spark):
    long, other = "<p>ä" * 400, "<b>x" * 300
    rows = [(1, "http://a/", long, "z"), (7, None, long, "z"), (3, "http://a/\r\nb", long, "z"), (4, "u", "short", "z"), (5, "u", "short", "z"), (6, "u", None, "z"), (8, "u", other, "z"), (None, "u", other, "z"), (9, "u", "y" * 300_000, "z")]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 7), 3: ("revisit", 7), None: ("revisit", 8)}


def test_repeated_rows_and_none(spark):
    rows = [(1, "u", "z" * 2000, "")] * 3
    assert [r.record_type for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()] == ["response"] * 3
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_dictionary_leads():
    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    out = Kept()
    writer = warc.ArchiveWriter(out)
    pages = [f"<html><body><p>page {i} of a site with much in common {i * i}</p></body></html>".encode() * 3 for i in range(600)]
    for i, p in enumerate(pages):
        writer.add(warc.build_record(i, "http://x/", p, hashlib.sha1(p).hexdigest(), len(p), None))
    writer.finish()
    # 0x184D2A5D: the skippable frame that dictionary-compressed WARC files begin with
    assert out.data[:4] == bytes.fromhex("5d2a4d18") and out.data[8:12] == bytes.fromhex("37a430ec")
    frames = list(warc.read_frames(io.BytesIO(out.data)))
    assert [warc.parse_record(r)[1].partition(b"\r\n\r\n")[2] for _, r in frames] == pages
    dictionary = zstandard.ZstdCompressionDict(out.data[8 : 8 + int.from_bytes(out.data[4:8], "little")])
    at = frames[300][0]
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(out.data[at:])
    assert one == frames[300][1]  # any record can be read alone


def test_archives_on_disk(spark, tmp_path):
    """The files themselves: a dictionary frame first, every record a frame of its own that its offset leads to."""
    text = lambda i: f"<html><head><title>{i}</title></head><body><p>{i * 7919} words of a page of this site</p></body></html>" * 12
    rows = [(i, f"http://h/{i}", text(i % 90), "") for i in range(120)]
    folder = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.write_archives(warc.with_revisits(pages), folder)
    got = warc.checked_revisits(warc.read_archives(manifest)).collect()
    assert sorted(r.page_id for r in got) == list(range(120)) and sum(r.record_type == "revisit" for r in got) == 30
    for m in manifest.collect():
        data = open(m.archive.removeprefix("file://"), "rb").read()
        assert len(data) == m.bytes and data[:4] == bytes.fromhex("5d2a4d18")
        n = int.from_bytes(data[4:8], "little")
        assert n > 100 and data[8 + n : 12 + n] == bytes.fromhex("28b52ffd")
        for r in got:
            if r.archive == m.archive:
                headers, block = warc.parse_record(warc.read_record(io.BytesIO(data), r.offset))
                assert headers["WARC-Record-ID"] == warc.record_id(r.page_id)
                if r.record_type == "response":
                    assert block.partition(b"\r\n\r\n")[2].decode() == text(r.page_id % 90)


def test_few_records_have_a_dictionary():
    for n in (1, 2, 7):
        records = [warc.build_record(i, None, b"<p>%d</p>" % i, hashlib.sha1(b"<p>%d</p>" % i).hexdigest(), 8, None) for i in range(n)]
        out = io.BytesIO()
        writer = warc.ArchiveWriter(out)
        for r in records:
            writer.add(r)
        writer._begin()
        data = out.getvalue()
        assert data[:4] == bytes.fromhex("5d2a4d18")
        assert [r for _, r in warc.read_frames(io.BytesIO(data))] == records


def test_a_revisit_without_its_response_is_an_error(spark):
    rows = [(1, 2000, "aa", "revisit", 2, "x", 0), (2, 2000, "bb", "response", None, "x", 9)]
    records = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")
    with pytest.raises(ValueError):
        warc.checked_revisits(records)
