import base64
import hashlib
import io

import pytest

from boundwell.llm import warc as W

PAGE = "page_id long, url string, html string"


def want(rows, least=0):
    out = []
    newest = {}
    for k, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if k is None else k)
    for k, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and newest[h or ""] != (-1 if k is None else k)
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", newest[h or ""] if again else None))
    return sorted(map(str, out))


ROWS = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", ""), (4, "http://c/", None), (5, "http://d/", "WARC/1.1\r\n\r\n" * 30), (6, "http://e/", "x" * 100_000), (7, "u", "x" * 100_000), (None, "n", "<p>é</p>"), (None, "n", "only here"), (8, "r", "twice"), (8, "r", "twice")]


@pytest.mark.parametrize(("chunk", "least"), [(1 << 20, 0), (7, 0), (1000, 10)])
def test_round_trip(spark, chunk, least):
    pages = spark.createDataFrame([(*r, 1, "s") for r in ROWS], PAGE + ", record int, sha1 string")
    got = W.warc_round_trip(pages, min_bytes=least, chunk=chunk).collect()
    assert sorted(str(tuple(r)) for r in got) == want(ROWS, least)


def test_archive_is_an_ordinary_warc_stream(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGE)
    W.write_archive(pages, str(tmp_path / "archive"))
    archive = spark.read.parquet(str(tmp_path / "archive"))
    out = io.BytesIO()
    W.export_warc(archive, out)
    out.seek(0)
    assert sorted(map(str, W.read_warc(out))) == want(ROWS)


def test_damage_is_found():
    head = W.header(1, "u", "response", hashlib.sha1(b"abc").hexdigest(), 3, None)
    for data in (head + b"abX" + 2 * W.CRLF, head + b"ab", head + b"abc"):
        reader = W.RecordReader()
        reader.feed(data)
        with pytest.raises(ValueError):
            reader.result()
    reader = W.RecordReader()
    for b in head + b"abc" + 2 * W.CRLF:  # byte by byte
        reader.feed(bytes([b]))
    assert reader.result()[3] == "response"


def test_empty_table(spark):
    assert W.warc_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_no_whole_payload_is_moved(spark):
    """Above the scan every exchange of the plan carries chunk rows."""
    pages = spark.createDataFrame([(i, f"http://{i}/", "y" * 5000 + str(i % 3)) for i in range(12)], PAGE)
    rows = W.archive_rows(pages, "page_id", "url", "html", 0, 1000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "payload" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert plan.index("SortMergeJoin") < plan.index("Generate explode")
    held = rows.collect()
    assert max(len(r.bytes) for r in held if r.last_chunk) < 2000 and len(held) == 9 + 3 * 6


def test_the_archive_is_deleted(spark):
    import glob

    from boundwell.shared import use_checkpoint_dir

    pages = spark.createDataFrame(ROWS, PAGE)
    assert W.warc_round_trip(pages).count() == len(ROWS)
    assert not glob.glob(f"{use_checkpoint_dir(spark).removeprefix('file:')}/warc-*")
