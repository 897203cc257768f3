import base64
import gzip
import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from equisift.llm import warc as m
from equisift.llm.common import shared_path

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(1)
    html = ["<p>" + "x" * rng.randint(0, 300) + str(rng.random()) for _ in range(40)]
    html += ["", None, "same", "same", "same", "ß漢😀\r\n\r\nWARC/1.1\r\n", "\x1f\x8b\x08 not gzip", "z" * 300_000, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(100_000))]
    return [(i * 7 % 1000, None if i == 3 else f"http://h/{i}\r\nX: y" if i == 4 else f"http://h/{i}", t) for i, t in enumerate(html)]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[(t or "").encode()].append(i)
    out = {}
    for p, ids in groups.items():
        for i in ids:
            first = max(ids) if len(p) >= least else i
            out[i] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
    return out


def test_query(spark, tmp_path):
    rows = pages()
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "record_type": F.lit("x"), "_key": F.lit(0)}).write.parquet(str(tmp_path / "in/pages.parquet"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in m.op9_warc(spark, str(tmp_path / "in")).collect()}
    assert got == expected(rows)


def test_any_split_size_gives_every_record_once(spark):
    rows = pages()
    manifest = m.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), shared_path(spark, "warc-test"), min_bytes=1)
    want = sorted((i, (t or "").encode()) for i, _, t in rows)
    for split in (97, 1000, 1 << 20):
        got = m.read_warc(spark, manifest, split).select("record_id", "payload", "record_type", "refers_to").collect()
        by = {int(r["record_id"].split(":")[-1][:-1]): r for r in got}
        assert len(got) == len(by) == len(rows)
        for i, payload in want:
            r = by[i]
            if r["record_type"] == "revisit":
                r = by[int(r["refers_to"].split(":")[-1][:-1])]
            assert bytes(r["payload"]) == payload


def test_the_files_are_gzip_of_warc(spark):
    path = shared_path(spark, "warc-test")
    manifest = m.write_warc(spark.createDataFrame(pages(), SCHEMA).coalesce(1), path).collect()
    data = gzip.decompress(open(manifest[0]["file"].removeprefix("file:"), "rb").read())
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages()) and b"\r\nX: y" not in data


def test_junk_between_records_is_skipped(tmp_path):
    one, two = (m.record(i, "u", b"payload", "response", m.digest(b"payload"), None) for i in (1, 2))
    broken = gzip.compress(b"no record") + one[:40] + m.MAGIC + b"junk"
    (tmp_path / "f").write_bytes(one + broken + two)
    size = len(one + broken + two)
    for cut in range(1, size, 13):
        got = [*m.read_split(f"file://{tmp_path}/f", 0, cut, size), *m.read_split(f"file://{tmp_path}/f", cut, size, size)]
        assert [g["headers"]["warc-record-id"][-2] for _, g in got] == ["1", "2"]


def test_no_rows(spark):
    manifest = m.write_warc(spark.createDataFrame([], SCHEMA), shared_path(spark, "warc-test"))
    assert manifest.count() == 0 and m.read_warc(spark, manifest).count() == 0


def test_null_ids_have_no_record(spark):
    manifest = m.write_warc(spark.createDataFrame([(None, "u", "x"), (1, "u", "x")], SCHEMA), shared_path(spark, "warc-test"))
    assert m.read_warc(spark, manifest).count() == 1


def test_one_payload_of_nearly_all_pages(spark, tmp_path):
    """Rows of a payload go to several tasks, and each revisits the greatest id."""
    rows = [(i, f"http://h/{i}", "error page" if i % 50 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in m.op9_warc(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    spread = m.roles(df).filter("refers_to = 2999").select(F.spark_partition_id().alias("p")).distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spread.count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_of_s3(monkeypatch):
    seen = []
    fake = type("Fake", (), {"FileSystem": type("FileSystem", (), {"from_uri": staticmethod(lambda uri: seen.append(uri) or (None, uri))})})
    monkeypatch.setattr(m, "pafs", fake)
    for uri in ("s3a://bucket/x", "s3n://bucket/x", "file:///x"):
        m.store(uri)
    assert seen == ["s3://bucket/x", "s3://bucket/x", "file:///x"]


def test_query_returns_a_row_per_page(spark, tmp_path):
    rows = [(None, "u", "x"), (None, "u", "alone"), (1, "u", "x"), (9, "u", "x"), (9, "u", "x"), (9, "v", "longer"), (2, "u", "longer")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in m.op9_warc(spark, str(tmp_path)).collect()]
    want = [(None, 1, "revisit", 9), (None, 5, "response", None), (1, 1, "revisit", 9), *[(9, 1, "response", None)] * 2, (9, 6, "response", None), (2, 6, "revisit", 9)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
