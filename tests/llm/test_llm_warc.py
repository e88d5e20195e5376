"""Revisit resolution on hand-made records, and on random ones against a plain search."""

import random

from pyspark.sql import functions as F

from tablescout.llm.frames import work_folder
from tablescout.llm.warc import canonical_url, resolve_revisits

KIND = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, key string"


def resolve(spark, rows):
    df = spark.createDataFrame([(*r, "k") for r in rows], KIND)
    return resolve_revisits(df, work_folder(spark, "t")).collect()


def test_canonical_url(spark):
    same = [
        "https://www.A.org:443/x/?utm_source=f&ref=z#top", "http://a.org/x", "a.org/x/",
        "HTTP://u:p@A.ORG:80/x?ref=1", "a.org/x?&utm_id=1&&ref=2",
    ]
    df = spark.createDataFrame([(u,) for u in [*same, "", None]], "u string")
    assert {r[0] for r in df.select(canonical_url(F.col("u"))).collect()} == {"a.org/x", "", None}
    # Only the scheme's own default port may go.
    kept = ["http://a.org:443/x", "https://a.org:80/x", "a.org:80", "ftp://a.org:443", "http://a.org:8080"]
    df = spark.createDataFrame([(u,) for u in kept], "u string")
    got = {r[0] for r in df.select(canonical_url(F.col("u"))).collect()}
    assert got == {"a.org:443/x", "a.org:80/x", "a.org:80", "a.org:443", "a.org:8080"}


def test_outcomes(spark):
    old, new = {"etag": "a", "x": "1", "content-length": "9"}, {"x": "2", "content-length": "0"}
    rows = [
        (1, "http://a.org/", 10, 200, '"a"', "d1", old), (2, "https://a.org", 20, 200, '"b"', "d1", old),
        (3, "a.org", 15, 304, 'W/"a"', None, new), (4, "a.org", 30, 304, '"a"', "d1", new),
        (5, "a.org", 30, 304, None, "d1", new), (6, "a.org", 10, 304, '"a"', None, new),
        (7, "a.org", 40, 304, None, None, None), (8, None, 40, 304, '"a"', None, new),
        (9, "a.org", None, 304, '"a"', None, new), (10, "a.org", 12, 404, '"a"', None, old),
        (3, "a.org", 15, 304, 'W/"a"', None, new),
    ]
    got = resolve(spark, rows)
    assert sorted(r["record_id"] for r in got) == [3, 3, 4, 5, 6, 7, 8, 9]
    by = {r["record_id"]: (r["outcome"], r["refers_to"]) for r in got}
    assert by[3] == ("resolved", 1) and by[4] == ("mismatch", 2) and by[5] == ("resolved", 2)
    assert by[6] == by[8] == by[9] == ("no_original", None) and by[7] == ("unverified", 2)
    headers = {r["record_id"]: r["headers"] for r in got}
    assert headers[3] == {"etag": "a", "x": "2", "content-length": "9"}
    assert headers[4] == new and headers[7] == {}
    assert resolve(spark, []) == []


def test_hot_url_across_ranges(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        url = "hot.org/x" if i % 3 else f"s{draw.randint(0, 40)}.org"
        status = 200 if draw.random() < 0.1 else 304
        rows.append((i, url, draw.randint(0, 2000), status, draw.choice(['"a"', '"b"']), None, None))
    got = {r["record_id"]: (r["outcome"], r["refers_to"]) for r in resolve(spark, rows)}
    full = sorted(r for r in rows if r[3] == 200)
    for r in rows:
        if r[3] == 304:
            best = max(((f[2], f[0], f[4]) for f in full if f[1] == r[1] and f[2] < r[2]), default=None)
            same = best and best[2] == r[4]
            want = "no_original" if best is None else "resolved" if same else "mismatch"
            assert got[r[0]] == (want, best[1] if best else None)
