"""URL rules and WARC archives beside plain Python on small tables."""

from collections import Counter
import base64
import glob
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomtext.llm.url_rules import filter_urls, rule_table
from loomtext.llm.warc import MAGIC, format_record, read_warc, write_warc

RULES = [
    ("||net/", "block", 1), ("||example.net/en/", "allow", 1), ("||org/fr/", "allow", 1),
    ("*casino*", "block", 0), ("/a-b/*.php|", "block", 0), ("|ads.", "block", 0),
    ("||example.net/en/", "allow", 1), (None, "block", 5), ("||x.y/(z", "block", 0),
]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://A.Example.NET/en/x?y", "x://b.net/EN/",
    "http://notnet.com/", "https://e.org/fr/?q#f", "https://e.org?/fr/", "http://q/CASINO", "http://q/x/casino1",
    "http://ads.q/", "http://q.ads.q/", "http://k/a-b/c.php", "http://k/a-b/c.php?x", "http://m.x.y/(z", "a://b://c/\n",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    target = host + rest[len(host) :]
    fits = []
    for pattern, action, priority in RULES:
        if pattern and target:
            start = r"^(?:[^/?#]*\.)?" if pattern.startswith("||") else "^" if pattern[0] == "|" else ""
            body = re.escape(pattern.lstrip("|").rstrip("|")).replace(r"\*", ".*")
            if re.search(start + body + ("$" if pattern.endswith("|") else ""), target, re.S):
                fits.append((priority, len(pattern), action == "allow", pattern, action))
    best = max(fits, default=(None,) * 3 + (None, "allow"))
    return host, path, best[3], best[4]


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    for column in ("_token", "pattern", "_kept"):
        pages = pages.withColumn(column, F.lit(1))
    found = filter_urls(pages.repartition(3), rule_table(spark, RULES), keep=["page_id", "host"])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: judged(u) for i, u in rows}


def test_no_rules_and_no_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert filter_urls(pages, rule_table(spark, []), keep=["page_id"]).first().verdict == "allow"
    assert filter_urls(pages.limit(0), rule_table(spark, RULES), keep=["page_id"]).collect() == []


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def archive_rows():
    rng = random.Random(1)
    bodies = ["".join(chr(rng.randrange(32, 0x2000)) for _ in range(rng.randrange(3000))) for _ in range(60)]
    rows = [(i, f"http://x/{i}", b) for i, b in enumerate(bodies)]
    rows += [(100, None, None), (101, "u\r\nx: y", ""), (102, "u", "short"), (103, "u", "short")]
    return rows + [(200 + i, "d", "z" * 1000) for i in range(4)] + [(None, "n", "z" * 1000)]


@pytest.mark.parametrize("size", ["128m", "5000", "1000"])
def test_archives_round_trip(spark, tmp_path, small_ranges, size):
    rows = archive_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for column in ("id", "body", "target", "member"):
        pages = pages.withColumn(column, F.lit(1))
    write_warc(pages.repartition(3), str(tmp_path / "w"))
    small_ranges(size)
    found = {r.record_id: r for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(found) == len(rows)
    for i, url, body in rows:
        r, data = found[str(i) if i is not None else ""], (body or "").encode()
        revisit = body == "z" * 1000 and i != 203
        assert (r.record_type, r.refers_to) == (("revisit", "203") if revisit else ("response", None))
        assert r.payload_length == len(data) and not r.truncated
        assert revisit or bytes(r.payload) == data
        assert url != "u" or r.url == "u"


def test_archives_are_plain_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame(archive_rows(), "page_id long, url string, html string")
    write_warc(pages.coalesce(1), str(tmp_path / "w"))
    (path,) = glob.glob(f"{tmp_path}/w/part*")
    data, records = open(path, "rb").read(), 0
    while data:
        unpacker = zlib.decompressobj(31)
        assert unpacker.decompress(data).startswith(b"WARC/1.1")
        data, records = unpacker.unused_data, records + 1
    assert records == len(archive_rows())


@pytest.mark.parametrize("size", ["128m", "3000", "700"])
def test_magic_inside_members_and_cut_archives(spark, tmp_path, small_ranges, size):
    payload = b"A" * 5000 + MAGIC + b"B" * 3000 + MAGIC + MAGIC + b"WARC/1.1" + b"C" * 9000
    record = format_record("7", "response", "u", payload, len(payload), "00" * 20, None)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "a.warc").write_bytes(member * 5 + member[:9000])
    small_ranges(size)
    found = read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r.truncated for r in found) == [False] * 5 + [True]
    assert sum(bytes(r.payload) == payload for r in found) == 5


@pytest.mark.parametrize("size", ["128m", "3000", "700"])
@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_archives_of_any_name(spark, tmp_path, small_ranges, name, size):
    """The same members under both usual names, among them fields that cannot be read and damaged bytes."""
    def member(record):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(record) + packer.flush()

    def record(number, payload):
        return format_record(str(number), "response", "u", payload, len(payload), "ab" * 20, None)

    good = [record(i, bytes([i]) * (900 * i)) for i in range(5)]
    digest = b"WARC-Payload-Digest: sha1:"
    at = good[0].index(digest) + len(digest)
    end = good[0].index(b"\r\n", at)
    lower = good[1][:at] + b"nbswy3dpnbswy3dpnbswy3dpnbswy3dp" + good[1][end:]
    strange = good[2][:at] + b"1" * 32 + good[2][end:]
    length = good[3].index(b"Content-Length: ") + len(b"Content-Length: ")
    unsized = good[3][:length] + b"many" + good[3][good[3].index(b"\r\n", length):]
    damaged = bytearray(member(good[4] + os.urandom(3000)))
    damaged[len(damaged) // 2] ^= 255
    parts = [*map(member, good), member(lower), member(strange), bytes(damaged), member(unsized)]
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / name).write_bytes(b"".join(parts))
    small_ranges(size)
    found = read_warc(spark, str(tmp_path / "w")).collect()
    errors = Counter(r.error for r in found)
    assert errors[None] == 6 and errors["cannot read warc-payload-digest"] == 1
    assert errors["cannot read content-length"] == 1 and errors["damaged member"] <= 1
    assert sum(r.record_type == "response" for r in found) == 8
    assert {len(r.payload) for r in found if r.error is None} == {900 * i for i in range(5)}
    assert base64.b32decode(b"NBSWY3DPNBSWY3DPNBSWY3DPNBSWY3DP").hex() in {r.payload_digest for r in found}
    bad = next(r for r in found if r.error == "cannot read content-length")
    assert bytes(bad.payload).startswith(bytes([3]) * 2700) and not bad.truncated


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(pages, str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).collect() == []
