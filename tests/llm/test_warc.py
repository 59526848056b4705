"""Archives: an exact round trip, and the ZIP structures against those of the standard library."""

import hashlib
import io
import random
import zipfile

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from lumenframe.llm import warc

PAGES = "page_id long, url string, html string, digest string, refers_to long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], PAGES)


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200_000
    rows = [(5, "http://a/ b", "x" * 99 + "é"), (3, "http://a", "x" * 99 + "é"), (4, None, "x" * 99 + "é"), (1, "u", "short"), (2, "u", "short"), (6, "u", None), (7, "é\r\nX: y", ""), (8, "u", big), (9, "u", big), (None, "u", big), (5, "again", "x" * 99 + "é")]
    for force in (False, True):
        archives = warc.write_archives(frame(spark, rows), f"file://{tmp_path}/w{force}", force_zip64=force, archive_bytes=500)
        assert archives.agg({"records": "sum"}).first()[0] == len(rows)
        got = warc.read_archives(archives).collect()
        assert len(got) == len(rows)
        html = {(r[0], r[1]): r[2] or "" for r in rows}
        by_id = {r["page_id"]: r for r in got}
        for r in got:
            payload = {i: h for (i, _), h in html.items()}[r["page_id"]].encode()
            assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
            assert (r["payload"] == payload) if r["record_type"] == "response" else r["payload"] is None
        assert {i: by_id[i]["refers_to"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, None)} == {1: None, 2: None, 3: None, 4: 3, 5: 3, 6: None, 7: None, 8: None, 9: 8, None: None}
    empty = warc.write_archives(frame(spark, []), f"file://{tmp_path}/none")
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, "u", f"page {i}") for i in range(40)]
    archives = warc.write_archives(frame(spark, rows).repartition(4), f"file://{tmp_path}/many", archive_bytes=1)
    assert archives.count() == 40
    read = warc.read_archives(archives)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() == 40


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_equals_the_standard_library(tmp_path, zip64):
    rng, path = random.Random(3), tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(20):
            with z.open(zipfile.ZipInfo(f"d/é{k}"), "w", force_zip64=zip64) as member:
                member.write(rng.randbytes(rng.randrange(2000)))
    if zip64:
        # set the small directory's fields to "see ZIP64" as a writer of a huge archive does
        raw = bytearray(path.read_bytes())
        end = raw.rindex(b"PK\x05\x06")
        n, size, at = int.from_bytes(raw[end + 10 : end + 12], "little"), int.from_bytes(raw[end + 12 : end + 16], "little"), int.from_bytes(raw[end + 16 : end + 20], "little")
        big = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + n.to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + at.to_bytes(8, "little")
        locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
        tail = raw[end:]
        tail[8:20] = b"\xff" * 12
        path.write_bytes(bytes(raw[:end]) + big + locator + bytes(tail))
    with zipfile.ZipFile(path) as z, pafs.LocalFileSystem().open_input_file(str(path)) as f:
        found = warc.central_directory(f, f.size())
        assert set(found) == set(z.namelist())
        for name, entry in found.items():
            at, size = warc.stored_member(f, entry)
            assert f.read_at(size, at) == z.read(name)


def test_end_signature_inside_the_comment(tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a", "b")
        z.comment = b"a comment with PK\x05\x06 in it, and more text behind that"
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "c.zip")) as f:
        assert list(warc.central_directory(f, f.size())) == ["a"]


def test_damage_is_reported(tmp_path):
    (tmp_path / "x").write_bytes(b"no archive at all")
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f, pytest.raises(ValueError, match="not a ZIP"):
        warc.central_directory(f, f.size())
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "a" * 100)
    (tmp_path / "y").write_bytes(raw.getvalue())
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "y")) as f, pytest.raises(ValueError, match="stored"):
        warc.stored_member(f, warc.central_directory(f, f.size())["a"])
