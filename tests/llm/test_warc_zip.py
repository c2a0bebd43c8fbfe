"""Packages written and read back, directories of both kinds, archives without an index, odd pages."""

from __future__ import annotations

import base64
import hashlib
import zipfile

import pytest

from turnlake.llm import warc_zip

SCHEMA = "page_id long, url string, html string, row string, package long"
PAGES = [
    (5, "https://a.example/x y?q=1", "one", "r", 1),
    (3, "https://a.example/é", "one", None, None),
    (3, "https://a.example/é", "one", None, None),
    (None, "http://b.example/", "one", "r", 2),
    (7, None, None, None, None),
    (8, "no host", "", None, 3),
    (9, "x://h\r\nInjected: yes", "\r\n\r\nWARC/1.1\r\n\r\n é", None, 3),
    (10, "http://c.example/", "z" * 3_000_000, None, 3),
    (None, None, "alone", None, 3),
]


def plain(pages):
    first = {}
    for page in sorted(range(len(pages)), key=lambda i: (pages[i][0] is None, pages[i][0] or 0, i)):
        first.setdefault(pages[page][2] or "", page)
    out = []
    for i, (page_id, _, html, *_) in enumerate(pages):
        payload, of = (html or "").encode(), first[html or ""]
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if of == i else "revisit", None if of == i else pages[of][0]))
    return sorted(out, key=repr)


def read(found):
    return sorted(map(tuple, warc_zip.digest(found).collect()), key=repr)


@pytest.mark.parametrize("package_bytes", [warc_zip.PACKAGE_BYTES, 1])
def test_pages_come_back(spark, package_bytes):
    pages = spark.createDataFrame(PAGES, SCHEMA).coalesce(1)
    packages = warc_zip.written(pages, package_bytes=package_bytes)
    assert packages.agg({"records": "sum"}).first()[0] == len(PAGES)
    found = warc_zip.read_packages(packages)
    assert read(found) == plain(PAGES)
    texts = {r.record_id: bytes(r.payload).decode() for r in found.collect() if r.payload is not None}
    assert texts["<urn:page:9>"] == PAGES[6][2] and texts["<urn:page:10>"] == PAGES[7][2]
    uris = {r.record_id: r.target_uri for r in found.collect()}
    assert uris["<urn:page:9>"] == "x://h%0D%0AInjected:%20yes" and uris["<urn:page:7>"] is None


def test_short_payloads_are_all_responses(spark):
    packages = warc_zip.written(spark.createDataFrame(PAGES, SCHEMA), least=4)
    assert {(r.record_type, r.refers_to) for r in warc_zip.read_packages(packages).collect()} == {("response", None)}


def test_wide_directories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    writer = warc_zip.PackageWriter(f"{tmp_path}/wide.zip")
    for i, payload in enumerate([b"a" * 500, b"b"]):
        digest = warc_zip.sha1_base32(payload)
        writer.add(f"http://h/{i}", warc_zip.as_record(i, f"http://h/{i}", payload, False, None, digest), "response", digest)
    writer.zip.comment = b"a comment with PK\x05\x06 inside"
    writer.close()
    assert b"PK\x06\x06" in (tmp_path / "wide.zip").read_bytes()
    want = [("archive/data.warc.gz", writer.size), ("indexes/index.cdxj", sum(map(len, writer.lines)))]
    assert [(x["name"], x["size"]) for x in warc_zip.members_of(f"{tmp_path}/wide.zip")] == want
    packages = spark.createDataFrame([(f"{tmp_path}/wide.zip",)], "package string")
    assert sorted(bytes(r.payload) for r in warc_zip.read_packages(packages).collect()) == [b"a" * 500, b"b"]


def test_archives_without_an_index_are_walked(spark, tmp_path):
    (whole,) = (r.package for r in warc_zip.written(spark.createDataFrame(PAGES, SCHEMA).coalesce(1)).collect())
    with zipfile.ZipFile(whole.removeprefix("file://")) as own, zipfile.ZipFile(tmp_path / "bare.zip", "w", zipfile.ZIP_STORED) as bare:
        bare.writestr("readme.txt", "nothing")
        bare.writestr("archive/data.warc.gz", own.read("archive/data.warc.gz"))
    packages = spark.createDataFrame([(f"{tmp_path}/bare.zip",)], "package string")
    assert read(warc_zip.read_packages(packages)) == plain(PAGES)


def test_what_is_no_package_is_an_error(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"not a zip")
    with pytest.raises(ValueError, match="no end"):
        list(warc_zip.members_of(f"{tmp_path}/x.zip"))
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as own:
        own.writestr("archive/data.warc.gz", b"0" * 1000)
    with pytest.raises(Exception, match="is not stored"):
        warc_zip.read_packages(spark.createDataFrame([(f"{tmp_path}/packed.zip",)], "package string")).collect()


def test_empty_table(spark):
    assert warc_zip.read_packages(warc_zip.written(spark.createDataFrame([], SCHEMA))).count() == 0
