import base64
import hashlib

import pytest

from filewright.llm import queries, warc

SHA = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/", "<p>two</p>"),
    (3, "http://c/", "<p>one</p>"),
    (4, None, None),
    (5, "http://e/\r\nWARC-Type: fake", ""),
    (6, "http://f/", f"before {INNER}{INNER}WARC/ and WARC/1.1\r\n after"),
    (7, "http://g/é", "x" * 5000 + "\r\n\r\nWARC/1.0\r\n\r\n" + "ä\U0001f600" * 50),
    (8, "http://h/", INNER),
    (8, "http://h/", INNER),
    (9, "http://i/", "plain text again"),
    (None, "http://j/", "<p>one</p>"),
]


def expected(pages):
    out, first = [], {}
    for page, _, html in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        payload = (html or "").encode()
        again = payload in first
        out.append((page, len(payload), SHA(payload), "revisit" if again else "response", first[payload] if again else None))
        first.setdefault(payload, page)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 5) for p in PAGES], "page_id long, url string, html string, length int")


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_round_trip_with_magic_inside_payloads(spark, pages, tmp_path, split):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted((tuple(r) for r in queries.op5_warc(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(PAGES)


def test_payloads_come_back_byte_for_byte(spark, pages, tmp_path):
    warc.write(pages.coalesce(1), str(tmp_path / "a"))
    read = warc.read(spark, str(tmp_path / "a")).where("record_type = 'response'").collect()
    got = sorted(bytes(r["block"]).split(b"\r\n\r\n", 1)[1] for r in read)
    assert got == sorted({(html or "").encode() for _, _, html in PAGES})
    (file,) = (tmp_path / "a").glob("part-*")
    assert file.read_bytes().startswith(b"WARC/1.1\r\n") and file.read_bytes().endswith(b"\r\n\r\n")


def test_small_payloads_are_never_revisits_and_cut_files_lose_only_their_tail(spark, pages, tmp_path):
    got = warc.round_trip(pages.where("page_id <= 5"), min_bytes=100)
    assert [r.record_type for r in got.collect()] == ["response"] * 5
    warc.write(pages.coalesce(1), str(tmp_path / "b"))
    (file,) = (tmp_path / "b").glob("part-*")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cut.warc").write_bytes(file.read_bytes()[:-10])
    assert warc.read(spark, str(tmp_path / "c")).count() == len(PAGES) - 1
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_hold_when_a_second_read_deals_the_pages_otherwise(spark, tmp_path, monkeypatch):
    rows = [(n, f"http://h/{n}", f"<p>{n % 20}</p>" + "x" * n) for n in range(40)] + [(n + 100, f"http://h/{n}", f"<p>{n}</p>") for n in range(30) for _ in range(2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).write.parquet(str(tmp_path / "pages"))
    real = warc.stash

    def moving(df, label):  # the files are split otherwise from then on
        done = real(df, label)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        return done

    monkeypatch.setattr(warc, "stash", moving)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        kept = warc.records(spark.read.parquet(str(tmp_path / "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r) for r in kept), key=str) == expected(rows)
