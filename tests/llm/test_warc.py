import hashlib
import random

import pytest

from codeshift.llm import warc

MAGIC = "WARC/1.1\r\n"
FAKE = (MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n")
ROWS = [(5, "u5", "x" * 150), (3, "u3", "x" * 150), (9, None, "x" * 150), (None, "n", "x" * 150), (1, "a\r\nWARC-Type: y", None), (2, "", ""),
        (4, "u4", "short"), (6, "u6", "short"), (7, "u7", MAGIC), (8, "u8", FAKE), (10, "u10", "é" * 60 + FAKE + "tail"),
        (11, "u11", FAKE * 30), (12, "u12", "\r\n\r\n" + MAGIC * 3 + "\r\n\r\n"), (13, "u13", "\r\n" * 90), (14, "u14", "y" * 100),
        (15, "u15", "y" * 100), (16, "u16", "y" * 99), (17, "u17", "y" * 99), (18, "u18", "W" * 200 + "WARC/1.1" + "\r"), (None, "m", "z" * 200),
        (None, "m", "z" * 200), (19, "u19", FAKE[:-6]), (20, "u20", "\x00\x01" * 80), (21, "u", "q" * 70000 + MAGIC + "q" * 70000)]


def brute(rows, least=100):
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keep = firsts.get(h or "")
        again = len(raw) >= least and keep is not None and keep != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(map(str, out))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 7) for i, u, h in rows], "page_id long, url string, html string, digest string, size int")


def report(spark, rows):
    return sorted(str(tuple(r)) for r in warc.page_report(spark, pages(spark, rows).repartition(3)).collect())


def test_edges(spark):
    assert report(spark, ROWS) == brute(ROWS)
    assert report(spark, []) == []


@pytest.mark.parametrize("part", [1000, 4096])
def test_files_read_in_small_parts(spark, part):
    """Parts far shorter than records: chains and payloads cross many of them."""
    rng = random.Random(part)
    bits = ["text ", MAGIC, FAKE, "\r\n\r\n", "WARC/1.1", "W", "WARC-Type: response\r\n", "é"]
    rows = ROWS[:20] + [(100 + k, f"u{k}", "".join(rng.choices(bits, k=rng.randrange(0, 60)))) for k in range(60)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert report(spark, rows) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_are_plain_records(spark, tmpdir_spark):
    rows = [r for r in ROWS if r[0] is not None]
    path = tmpdir_spark + "/w"
    warc.write(pages(spark, rows).coalesce(1), path)
    raw = b"".join(open(f.removeprefix("file:"), "rb").read() for f in spark.read.text(path).inputFiles())
    at, seen = 0, []
    while at < len(raw):                     # a plain sequential reader
        end = raw.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:] if x)
        n = int(fields[b"Content-Length"])
        seen.append((fields[b"WARC-Type"], raw[end:end + n]))
        assert raw[at:at + 10] == MAGIC.encode() and raw[end + n:end + n + 4] == b"\r\n\r\n"
        at = end + n + 4
    want = [(h or "").encode() for i, _, h in rows]
    assert len(seen) == len(rows) and {p for t, p in seen if t == b"response"} == set(want)
