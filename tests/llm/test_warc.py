import base64
import hashlib
import io
import random

from pyspark.sql import functions as F

from plumbline.llm import warc
from plumbline.llm.common import scratch


def plain(pages):
    rows = []
    for page, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if p is not None and (h or "") == (html or "")]
        last = max(same) if page is not None else None
        refers = last if page is not None and page < last else None
        rows.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(rows, key=repr)


def test_query_against_plain(spark, tmp_path):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", rng.choice(["<p>é</p>", "", None, f"<b>{i}</b>" * 50])) for i in range(200)]
    pages += [(None, "http://x", "<p>é</p>"), (500, None, "z" * 300_000), (501, "a\r\nb", "q\r\n\r\nWARC/1.1\r\n"), (7, "http://h/7", "other"), (199, pages[199][1], pages[199][2])]
    path = str(tmp_path / "sf")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op6_warc(spark, path).collect()), key=repr)
    assert got == plain(pages)


def test_archives_are_equal_and_roll(spark):
    pages = spark.createDataFrame([(i, f"u{i}", ("%d " % (i * 7919)) * 400) for i in range(300)], "page_id bigint, url string, html string")
    made = []
    for parts in (1, 3):
        spark.conf.set("spark.sql.shuffle.partitions", 4 + parts)
        folder = scratch(spark, "warc")
        warc.write_archive(pages.repartition(parts), folder, shard_bytes=150_000, roll_bytes=4000)
        rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/manifest").collect())
        made.append(rows)
        back = warc.read_archive(spark, folder).select("page_id", "url", "block").collect()
        assert sorted((r.page_id, r.url, bytes(r.block).decode()) for r in back) == sorted(tuple(r) for r in pages.collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert made[0] == made[1]
    assert len(made[0]) > 8 and 4 <= len({r[0] for r in made[0]}) <= 9


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert warc.op6_warc(spark, path).count() == 0


def test_a_changed_file_is_noticed(spark):
    import pytest

    folder = scratch(spark, "warc")
    manifest = warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), folder)
    name = f"{folder.removeprefix('file://')}/records/{manifest.first().file}"
    raw = warc.make_record(1, "u", b"tent", None)
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="doesn't match"):
        warc.read_archive(spark, folder).collect()


def test_ids_over_the_whole_range_and_shards_of_like_size(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 2**63 - 2, 2**63 - 1]
    pages = [(i, "u", f"{i}" * 300) for i in [*ends, *range(1000, 1400), *range(10**12, 10**12 + 50)]]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    folder = scratch(spark, "warc")
    manifest = warc.write_archive(df, folder, shard_bytes=50_000).collect()
    back = warc.read_archive(spark, folder).select("page_id", "block").collect()
    assert sorted((r.page_id, bytes(r.block).decode()) for r in back) == sorted((i, t) for i, _, t in pages)
    shards = {}
    for m in manifest:
        shards[m.shard] = shards.get(m.shard, 0) + m.records
    assert len(shards) > 8 and max(shards.values()) < 60


def test_shards_follow_the_bounds(spark):
    bounds = [-7, 0, 3, 10, 11, 12, 500]
    ids = [None, -(2**63), -8, -7, -6, 0, 1, 3, 4, 10, 11, 12, 13, 500, 501]
    got = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", warc._shard_of(bounds, F.col("id")).alias("s")).collect()
    assert [r.s for r in got] == [0 if i is None else sum(b < i for b in bounds) for i in ids]


def test_records_are_http_responses(tmp_path):
    raw = warc.make_info(0, 0) + warc.make_record(3, "http://a/b", "<p>é</p>".encode(), None) + warc.make_record(2, None, b"x", 3)
    info, page, again = warc.read_records(io.BytesIO(raw))
    assert info[0]["WARC-Type"] == "warcinfo" and page[0]["Content-Type"] == "application/http; msgtype=response"
    head, _, payload = page[1].partition(b"\r\n\r\n")
    assert head.startswith(b"HTTP/1.1 200 OK\r\n") and payload.decode() == "<p>é</p>" and f"Content-Length: {len(payload)}".encode() in head
    assert again[0]["WARC-Type"] == "revisit" and again[0]["WARC-Refers-To"] == warc.record_id("3") and again[1].endswith(b"\r\n\r\n")
