import base64
import gzip
import hashlib
import random

import compare
import pytest
from pyspark.sql import functions as F

from metaeval.llm import arc_to_warc as a

SF = "/root/testdata/sf0.001"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(version, blocks, fields="URL IP-address Archive-date Content-type Archive-length"):
    """An archive written by hand, and the place of each of its records."""
    body = f"{version} 0 someone\n{fields}\n<note>x</note>\n".encode()
    out = f"filedesc://hand.arc 0 19970101 text/plain{' 200 - - 0 hand.arc' if version == 2 else ''} {len(body)}\n".encode() + body
    places = []
    for url, date, block in blocks:
        out += b"\n"
        places.append(len(out))
        out += f"{url} 1.2.3.4 {date} text/html{' 200 - - 77 hand.arc' if version == 2 else ''} {len(block)}\n".encode() + block
    return out + b"\n", places


def parsed(data):
    """The records of a WARC file by a plain reading of the format."""
    found = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.0"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        assert rest[size:size + 4] == b"\r\n\r\n"
        found.append((fields, rest[:size]))
        data = rest[size + 4:]
    return found


def tricky(rng, version, n):
    """HTTP answers whose payloads look like records, or hold a whole archive."""
    inner = arc_file(version, [("http://inner/", "20000101000000", b"HTTP/1.0 200 OK\n\nx")] * 3)[0]
    like = b"\nhttp://fake/ 9.9.9.9 20010101000000 text/html 3\nabc\nWARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    payloads = [b"", b"\n\n\n", b"\xff\xfe\x00bin\r\n\r\n", inner, like * 4, b"same", rng.randbytes(3000)]
    out = []
    for i in range(n):
        payload = rng.choice(payloads)
        out.append((f"http://h/{i}?a b" if i % 5 == 0 else f"http://h/{i}", f"2005010203{i % 60:02d}00", b"HTTP/1.1 200 OK\r\nX-Key: %d\r\n\r\n" % (i % 9) + payload))
    return [*out, ("dns:h", "20050102", b"h. 1 IN A 1.2.3.4"), ("ftp://h/f", "200501020304", b"plain")]


@pytest.mark.parametrize("size", [1 << 26, 700])
def test_conversion_of_archives_written_by_hand(spark, tmp_path, size):
    rng = random.Random(4)
    (tmp_path / "arc").mkdir()
    v2 = a.ARC_FIELDS[2].decode()
    files = {"one.arc": arc_file(1, tricky(rng, 1, 60)), "two.arc": arc_file(2, tricky(rng, 2, 60), v2)}
    given = {}
    for name, (data, places) in files.items():
        (tmp_path / "arc" / name).write_bytes(data)
        for place, (url, date, block) in zip(places, tricky_blocks(data, places)):
            given[f"file:{tmp_path}/arc/{name}", place] = (url, date, block)
    packed = arc_file(1, [("http://z/", "20060102030405", b"HTTP/1.1 200 OK\r\n\r\nonly here")])
    (tmp_path / "arc" / "three.arc.gz").write_bytes(gzip.compress(packed[0]))
    given[f"file:{tmp_path}/arc/three.arc.gz", packed[1][0]] = ("http://z/", "20060102030405", b"HTTP/1.1 200 OK\r\n\r\nonly here")
    a.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", "X-Key", "long", range_bytes=size)
    got = [r for f in sorted((tmp_path / "warc").glob("part-*")) for r in parsed(f.read_bytes())]
    assert sum(f["WARC-Type"] == "warcinfo" for f, _ in got) == 3
    by_id = {f["WARC-Record-ID"]: (f, block) for f, block in got}
    assert len(by_id) == len(got) == len(given) + 3
    groups = {}
    for (path, place), (_, _, block) in given.items():
        if block.startswith(b"HTTP/"):
            head, _, payload = block.partition(b"\r\n\r\n")
            key = int(head.split(b"X-Key: ")[1]) if b"X-Key" in head else -1
            groups.setdefault(payload, []).append((key, path, place))
    for (path, place), (url, date, block) in given.items():
        fields, stored = by_id[a.record_id(path, place)]
        assert fields["WARC-Target-URI"] == url and fields["WARC-Date"].replace("-", "").replace(":", "").replace("T", "").startswith(date[:8])
        assert fields["WARC-Block-Digest"] == "sha1:" + b32(stored) and fields["WARC-IP-Address"] == "1.2.3.4"
        if not block.startswith(b"HTTP/"):
            assert stored == block and fields["WARC-Type"] == ("response" if url.startswith("dns:") else "resource")
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        assert fields["WARC-Payload-Digest"] == "sha1:" + b32(payload)
        best = max(groups[payload])
        if best[1:] == (path, place):
            assert fields["WARC-Type"] == "response" and stored == block
        else:
            assert fields["WARC-Type"] == "revisit" and stored == head + b"\r\n\r\n"
            assert fields["WARC-Refers-To"] == a.record_id(*best[1:])
            assert fields["WARC-Refers-To-Target-URI"] == given[best[1:]][0]
    # the library's own reader, over ranges and whole files, sees the same records
    for limit in (size, 1 << 26):
        rows = a.read_warcs(a.segments(spark, f"{tmp_path}/warc", "warc", limit)).collect()
        assert {r["record_id"]: (r["type"], bytes(r["block"])) for r in rows} == {k: (f["WARC-Type"], block) for k, (f, block) in by_id.items()}
        assert len(rows) == len(got)
    rows = a.read_arcs(a.segments(spark, f"{tmp_path}/arc", "arc", size)).filter("offset > 0").collect()
    assert {(r["path"], r["offset"]): (r["url"], r["date"], bytes(r["block"])) for r in rows} == given


def tricky_blocks(data, places):
    """The records at known places, cut out by their declared lengths."""
    for place in places:
        line, _, rest = data[place:].partition(b"\n")
        parts = line.split(b" 1.2.3.4 ")
        yield parts[0].decode(), parts[1].split()[0].decode(), rest[:int(line.rsplit(b" ", 1)[1])]


def test_sql_says_the_same(spark):
    assert compare.spark_rows(a.op11_arc_to_warc(spark, SF)) == compare.sql_rows(compare.connect(SF), a.SQL)


def test_odd_pages(spark):
    long = "é漢🙂 long\r\n\r\nWARC/1.0\r\n" * 200_000
    rows = [(1, "u", None), (2, None, ""), (3, "a b\n", "x"), (3, "-", "x"), (4, "", "x\r\n\r\n"), (None, "u", "x"), (5, "u", long), (6, "u", long),
            (7, "u", "HTTP/1.1 200 OK\r\nX-Page-Id: 99\r\n\r\nx"), (None, None, None), (8, "u", "\0"), (8, "u", "\0")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("block", "date", "key", "path", "status", "value")})
    got = sorted(map(tuple, a.archived_pages(df.repartition(3)).collect()), key=str)
    want, best = [], {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    left = dict(best)
    for i, _, html in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        text = html or ""
        first = left.get(text) == (-1 if i is None else i)
        if first:
            del left[text]
        want.append((i, len(text.encode()), b32(text.encode()), "response" if first else "revisit", None if first else best[text]))
    assert got == sorted(want, key=str)
    assert a.archived_pages(df.limit(0)).collect() == []


def test_both_versions_are_written(spark, tmp_path):
    rows = a.page_records(spark.read.parquet(f"{SF}/pages.parquet")).repartition(2)
    for version in (None, 1, 2):
        a.write_arcs(rows, f"{tmp_path}/{version}", version)
        got = a.read_arcs(a.segments(spark, f"{tmp_path}/{version}", "arc"))
        assert {r["version"] for r in got.select("version").distinct().collect()} == ({1, 2} if version is None else {version})
        assert got.filter("offset > 0").count() == rows.count()


def test_damaged_archives_raise(spark, tmp_path):
    data, places = arc_file(1, [(f"http://h/{i}", "20050102030405", b"HTTP/1.1 200 OK\r\n\r\nabc") for i in range(30)])
    damaged = {"short": data[:-10], "line": data[:places[9]] + b"?" * 30 + data[places[9] + 30:], "version": data.replace(b"1 0 someone", b"7 0 someone")}
    for name, content in damaged.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.arc").write_bytes(content)
        for size in (1 << 20, 300):
            with pytest.raises(Exception, match="x.arc at|unknown ARC version"):
                a.read_arcs(a.segments(spark, f"{tmp_path}/{name}", "arc", size)).collect()


@pytest.mark.parametrize("digits, iso", [("19970102030405", "1997-01-02T03:04:05Z"), ("199701020304", "1997-01-02T03:04:00Z"), ("19970102", "1997-01-02T00:00:00Z"),
                                         ("19970102030405678", "1997-01-02T03:04:05Z"), ("19971302000000", "1970-01-01T00:00:00Z"), ("-", "1970-01-01T00:00:00Z"), (None, "1970-01-01T00:00:00Z")])
def test_dates(digits, iso):
    assert a.iso_date(digits) == iso
