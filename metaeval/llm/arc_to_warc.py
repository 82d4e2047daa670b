"""Legacy ARC archives become WARC archives.

An ARC file opens with a version block that names the version and the fields of
every record's header line: five in version 1, ten in version 2. The last is the
declared length of the block that follows; reading trusts nothing else, so blocks
may hold lines that look like headers. Each record gets what WARC asks for: an
identifier derived from its file and place (the same whenever a task runs again),
an ISO timestamp, a type, and SHA-1 digests of block and payload. HTTP answers with
equal payloads are stored once: the one with the greatest key is the ``response``,
all others are ``revisit`` records with their HTTP head and a reference.

Scale: files are read where the tasks run, a record at a time. A file above
``RANGE_BYTES`` is cut: tasks list the places in their range where a header line may
stand, the declared lengths are followed from the start of the file over these
places (numbers only), and the first true record of every range starts a segment.
Only digests and places are shuffled; payloads are read again where the WARC
records are written, by Spark's own writer, whose line separator is the format's
end of a record. A lost task writes the same bytes again.

Defined results: a null block is empty; null or empty header fields are written
``-`` and read as null; blanks in an address are percent-encoded. An empty payload is
a payload like any other. Of equal keys the record that comes last by file and
place is the response; null keys are least. Dates of 8 to 17 digits are padded or
cut to seconds; others, or none, give 1970-01-01T00:00:00Z. Blocks that are no HTTP
answer become ``resource`` records (``response`` for name lookups) and are never merged.
A header line that does not fit its version, or a block that ends early, raises
with its file and place. No rows give archives without records. Files ending in
``.gz`` are read too, each by one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from metaeval.llm import flat
from metaeval.llm.registry import query
from metaeval.session import delete_at_exit, shared_dir
from metaeval.sources.inventory import list_files, located_file, working_folder

RANGE_BYTES = 64 << 20
LONGEST_LINE = 1 << 16
OUT_BYTES = 8 << 20
#: How archives are packed: faster than by default, for somewhat more bytes.
FAST = {"zlib.compress.level": "BEST_SPEED"}

# The field lines of both ARC versions, and names of the WARC format.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.0"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
RECORD_END = "\r\n\r\n"

ARC_ROW = "path string, segment long, offset long, version int, url string, ip string, date string, content_type string, status string, block binary"
WARC_ROW = "path string, offset long, type string, record_id string, date string, uri string, refers_to string, content_type string, block_digest string, payload_digest string, block binary"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Head, with its blank line, and payload of an HTTP answer; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [block.find(mark) + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if mark in block]
    end = min(ends, default=len(block))
    return block[:end], block[end:]


def head_field(head: bytes, name: str) -> str | None:
    """The value of the first header line of that name."""
    found = re.search(rb"(?mi)^%s:[ \t]*([^\r\n]*?)[ \t]*\r?$" % re.escape(name.encode()), head)
    return found[1].decode("latin-1") if found else None


def iso_date(digits: str | None) -> str:
    """An archive's date of 8 to 17 digits as WARC writes it."""
    if digits and re.fullmatch(r"[0-9]{8,17}", digits):
        padded = digits[:14].ljust(14, "0")
        try:
            return datetime(*(int(padded[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))).isoformat() + "Z"
        except ValueError:
            pass
    return "1970-01-01T00:00:00Z"


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


# ---- reading both formats by their declared lengths


class ArcFormat:
    """Header lines as the version block at the start of the file lays them out."""

    def __init__(self, opening: bytes):
        lines = opening.split(b"\n", 3)
        if not opening.startswith(b"filedesc://") or len(lines) < 3:
            raise ValueError("no ARC version block")
        names = lines[2].rstrip(b"\r").split(b" ")
        version = lines[1].split(b" ")[0]
        if version not in (b"1", b"2") or names[0] != b"URL" or names[-1] != b"Archive-length":
            raise ValueError(f"unknown ARC version: {lines[1]!r}, {lines[2]!r}")
        self.version, self.names = int(version), [n.decode() for n in names]
        number = b"[0-9]{1,18}\r?"
        middle = b" ".join(b"(?:[0-9]+|-)" if n == "Archive-date" else b"[^ \n]+" for n in self.names[1:-1])
        self.line = re.compile(rb"(?m)^[^\s][^\n]* " + middle + b" " + number + b"$")

    def head(self, reader, offset: int) -> tuple[dict, int, int]:
        """Fields, bytes of the head and bytes of the block of the record that begins here."""
        line = reader.readline(LONGEST_LINE)
        text = line.rstrip(b"\r\n")
        if offset == 0:
            values = text.split(b" ")
            if not values[-1].isdigit():
                raise ValueError("the version block has no length")
            return {"URL": text.split(b" ")[0].decode("utf-8", "replace"), "Archive-date": values[2].decode("latin-1") if len(values) > 2 else "-"}, len(line), int(values[-1])
        if not self.line.fullmatch(text):
            raise ValueError(f"no header line of ARC version {self.version}: {text[:200]!r}")
        values = [v.decode("utf-8", "replace") for v in text.rsplit(b" ", len(self.names) - 1)]
        return dict(zip(self.names, values)), len(line), int(values[-1])

    def starts(self, chunk: bytes) -> Iterator[tuple[int, int]]:
        """Places of a chunk where a record may begin, and where it would end."""
        for found in self.line.finditer(chunk):
            yield found.start(), found.end() + 1 + int(found[0].rsplit(b" ", 1)[1])


class WarcFormat:
    """A version line and named fields up to a blank line."""

    block = re.compile(rb"(?m)^WARC/1\.[0-9]\r?\n(?:[^\r\n]+\r?\n)*\r?\n")

    def __init__(self, opening: bytes):
        if not opening.startswith(b"WARC/1."):
            raise ValueError("no WARC record")

    def head(self, reader, offset: int) -> tuple[dict, int, int]:
        lines, size = [], 0
        while True:
            line = reader.readline(LONGEST_LINE)
            size += len(line)
            lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            if not lines[-1]:
                break
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"no WARC record: {lines[0][:200]!r}")
        return fields, size, int(fields["content-length"])

    def starts(self, chunk: bytes) -> Iterator[tuple[int, int]]:
        for found in self.block.finditer(chunk):
            length = head_field(found[0], "Content-Length")
            if length and length.isdigit():
                yield found.start(), found.end() + int(length)


FORMATS = {"arc": ArcFormat, "warc": WarcFormat}


def opened(path: str, home: str):
    system, inner = located_file(path, home)
    raw = system.open_input_file(inner)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)


def records(kind: str, path: str, home: str, start: int, end: int) -> Iterator[tuple[int, object, dict, bytes]]:
    """Place, format, fields and block of the records that begin between two places of a file."""
    with opened(path, home) as reader:
        opening = reader.read(LONGEST_LINE)
        if not opening:
            return
        try:
            layout = FORMATS[kind](opening)
            reader.seek(start)
            offset = start
            while offset < end:
                skipped = reader.peek(1)[:1]
                if skipped in (b"\r", b"\n"):
                    reader.read(1)
                    offset += 1
                    continue
                if not skipped:
                    return
                fields, size, length = layout.head(reader, offset)
                block = reader.read(length)
                if len(block) < length:
                    raise ValueError("the block ends early")
                yield offset, layout, fields, block
                offset += size + length
        except ValueError as e:
            raise ValueError(f"{path} at {offset if 'offset' in locals() else 0}: {e}") from e


def segments(spark: SparkSession, folder: str, kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``start``, ``end`` of stretches that begin with a record, for all files of a folder."""
    home = working_folder(spark)
    files = list_files(spark, folder)
    whole = (F.col("length") <= range_bytes) | F.col("path").endswith(".gz")
    # what a packed file holds is longer than the file
    end = F.when(F.col("path").endswith(".gz"), F.lit(1 << 62)).otherwise(F.col("length")).alias("end")
    small = files.filter(whole).select("path", F.lit(0).cast("long").alias("start"), end)
    ranges = files.filter(~whole).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, length, start in frame.itertuples(index=False):
                with opened(path, home) as reader:
                    layout = FORMATS[kind](reader.read(LONGEST_LINE))
                    # a place counts if its line begins in the range; the byte before tells that a line begins
                    reader.seek(max(start - 1, 0))
                    chunk = reader.read(range_bytes + LONGEST_LINE + 1)
                    first = start - max(start - 1, 0)
                    if start and chunk[:1] != b"\n":
                        first = chunk.find(b"\n") + 1 or len(chunk)
                    base = max(start - 1, 0) + first
                    found = [(path, length, start, base + a, base + b) for a, b in layout.starts(chunk[first:]) if base + a < start + range_bytes]
                    if start == 0:
                        reader.seek(0)
                        _, size, block = layout.head(reader, 0)
                        found = [(path, length, 0, 0, size + block), *(x for x in found if x[3] > 0)]
                    yield pd.DataFrame(found, columns=["path", "length", "range", "start", "end"])

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        path, length = part["path"].iloc[0], int(part["length"].iloc[0])
        starts, ends, cuts = part["start"].tolist(), part["end"].tolist(), part["range"].tolist()
        at, firsts, last_cut = 0, [], -1
        while at < len(starts):
            if cuts[at] != last_cut:
                firsts.append(starts[at])
                last_cut = cuts[at]
            at = bisect_left(starts, ends[at], at + 1)
        return pd.DataFrame({"path": path, "start": firsts, "end": [*firsts[1:], length]})

    places = ranges.repartition(tasks(spark), "path", "start").mapInPandas(listed, "path string, length long, range long, start long, end long")
    return small.unionByName(places.groupBy("path").applyInPandas(walked, "path string, start long, end long"))


def tasks(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_arcs(cut: DataFrame) -> DataFrame:
    """The records of the ARC ``segments``, version blocks included (``url`` is then ``filedesc://…``)."""
    spark = cut.sparkSession
    home = working_folder(spark)
    text = lambda fields, name: None if fields.get(name, "-") == "-" else fields[name]

    def rows(path: str, start: int, end: int) -> Iterator[tuple]:
        for offset, layout, fields, block in records("arc", path, home, start, end):
            yield (path, start, offset, layout.version, text(fields, "URL"), text(fields, "IP-address"), text(fields, "Archive-date"),
                   text(fields, "Content-type"), text(fields, "Result-code"), block)

    return _by_segment(cut, rows, ARC_ROW)


def read_warcs(cut: DataFrame) -> DataFrame:
    """The records of the WARC ``segments``."""
    home = working_folder(cut.sparkSession)
    names = ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-refers-to", "content-type", "warc-block-digest", "warc-payload-digest")

    def rows(path: str, start: int, end: int) -> Iterator[tuple]:
        for offset, _, fields, block in records("warc", path, home, start, end):
            yield (path, offset, *map(fields.get, names), block)

    return _by_segment(cut, rows, WARC_ROW)


def _by_segment(cut: DataFrame, rows, schema: str) -> DataFrame:
    """The rows that ``rows(path, start, end, …)`` gives for every segment, in batches of a few megabytes."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment in frame.itertuples(index=False):
                held, size = [], 0
                for row in rows(*segment):
                    held.append(row)
                    size += 200 + (len(row[-1]) if row[-1] is not None else 0)
                    if size >= OUT_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    return cut.repartition(tasks(cut.sparkSession), "path", "start").mapInPandas(run, schema)


# ---- writing


def write_arcs(rows: DataFrame, folder: str, version: int | None = None, compression: str = "none") -> None:
    """One ARC file per partition. Columns: ``url``, ``ip``, ``date``, ``content_type``, ``status``, ``block``.

    Without a ``version`` partitions take turns: 1, 2, 1, … Packed files (``gzip``) are read by
    one task each, so pack only partitions of a size that a task can read.
    """
    flat.small_batches(rows.sparkSession)

    def field(value) -> bytes:
        text = "" if value is None else str(value)
        text = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)
        return b"%2D" if text == "-" else (text or "-").encode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        kind = version or 1 + number % 2
        name = f"part-{number:05d}.arc"
        body = b"%d 0 metaeval\n%s\n" % (kind, ARC_FIELDS[kind])
        extra = b" 200 - - 0 " + name.encode() if kind == 2 else b""
        opening = f"filedesc://{name} 0.0.0.0 19960923142103 text/plain".encode() + extra + b" %d\n" % len(body) + body
        offset = len(opening) + 1
        yield pa.record_batch([pa.array([opening], pa.binary())], names=["value"])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = bytes(row["block"] or b"")
                parts = [field(row["url"]), field(row["ip"]), field(row["date"]), field(row["content_type"])]
                if kind == 2:
                    parts += [field(row["status"]), b"-", b"-", b"%d" % offset, name.encode()]
                out.append(b" ".join([*parts, b"%d" % len(block)]) + b"\n" + block)
                offset += len(out[-1]) + 1
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    written = rows.select("url", "ip", "date", "content_type", "status", "block").mapInArrow(run, "value binary")
    written.select(F.col("value").cast("string")).write.options(lineSep="\n", compression=compression, **FAST).text(folder)


def warc_record(kind: str, name: str, date: str, fields: list[tuple[str, str | None]], content_type: str | None, block: bytes) -> bytes:
    """A record up to, and without, the two line ends that close it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *fields,
            ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in head if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arcs: str, warcs: str, key_header: str | None = None, key_type: str = "long", range_bytes: int = RANGE_BYTES, compression: str = "none") -> None:
    """Write the records of the ARC files of a folder as WARC files.

    ``key_header`` names the HTTP header line whose value, as ``key_type``, decides which of
    several equal payloads is kept as the response: the greatest.
    """
    home = working_folder(spark)
    cut = flat.written(segments(spark, arcs, "arc", range_bytes))

    def facts(path: str, start: int, end: int) -> Iterator[tuple]:
        for offset, _, fields, block in records("arc", path, home, start, end):
            parts = http_parts(block) if offset else None
            if parts:
                key = head_field(parts[0], key_header) if key_header else None
                yield path, start, offset, key, len(parts[1]), fields["URL"], fields["Archive-date"], sha1(parts[1])

    found = _by_segment(cut, facts, "path string, segment long, offset long, key string, size long, url string, date string, digest string")
    found = flat.written(found.withColumn("key", F.col("key").cast(key_type)))
    # a max of structs: null keys are least, equal keys are told apart by the place
    groups = found.groupBy("digest", "size").agg(F.max(F.struct("key", "path", "offset", "url", "date")).alias("best"), F.count("*").alias("n"))
    groups = flat.written(groups.filter("n > 1").drop("n"))
    other = (F.col("path") != F.col("best.path")) | (F.col("offset") != F.col("best.offset"))
    again = found.join(groups, ["digest", "size"]).filter(other).groupBy("path", F.col("segment").alias("start")).agg(
        F.collect_list(F.struct("offset", F.struct("best.path", F.col("best.offset").alias("place"), "best.url", "best.date").alias("best"))).alias("again"))

    def warc_rows(path: str, start: int, end: int, again) -> Iterator[tuple]:
        copies = {int(x["offset"]): x["best"] for x in again} if again is not None else {}
        for offset, layout, fields, block in records("arc", path, home, start, end):
            yield (converted(path, offset, layout, fields, block, copies.get(offset)),)

    work = cut.join(again, ["path", "start"], "left").select("path", "start", "end", "again")
    _by_segment(work, warc_rows, "value binary").select(F.col("value").cast("string")).write.options(lineSep=RECORD_END, compression=compression, **FAST).text(warcs)


def converted(path: str, offset: int, layout: ArcFormat, fields: dict, block: bytes, best) -> bytes:
    """The WARC record for a record of an ARC file; ``best`` is the kept record of an equal payload."""
    name, date = record_id(path, offset), iso_date(fields["Archive-date"])
    if offset == 0:
        notes = f"format: WARC File Format 1.0\r\ndescription: from ARC version {layout.version}\r\n".encode()
        return warc_record("warcinfo", name, date, [("WARC-Filename", fields["URL"].removeprefix("filedesc://"))], "application/warc-fields", notes)
    uri, ip = (None if fields[k] == "-" else fields[k] for k in ("URL", "IP-address"))
    common = [("WARC-Target-URI", uri), ("WARC-IP-Address", ip)]
    parts = http_parts(block)
    if parts is None:
        kind = "response" if (uri or "").startswith("dns:") else "resource"
        return warc_record(kind, name, date, common, None if fields["Content-type"] == "-" else fields["Content-type"], block)
    common.append(("WARC-Payload-Digest", f"sha1:{sha1(parts[1])}"))
    if best is None:
        return warc_record("response", name, date, common, HTTP_TYPE, block)
    common += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(best["path"], int(best["place"]))),
               ("WARC-Refers-To-Target-URI", None if best["url"] == "-" else best["url"]), ("WARC-Refers-To-Date", iso_date(best["date"]))]
    return warc_record("revisit", name, date, common, HTTP_TYPE, parts[0])


# ---- pages

KEY_HEADER = "X-Page-Id"
#: The table of pages has no times.
PAGE_DATE = "20240101000000"


def page_records(pages: DataFrame) -> DataFrame:
    """HTTP answers with the html of each page, as rows for ``write_arcs``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    key = F.coalesce(F.concat(F.lit(f"{KEY_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"),
                    F.lit("\r\n"), key, F.lit("\r\n"))
    return pages.select("url", F.lit("0.0.0.0").alias("ip"), F.lit(PAGE_DATE).alias("date"), F.lit("text/html").alias("content_type"),
                        F.lit("200").alias("status"), F.concat(head.cast("binary"), html.cast("binary")).alias("block"))


def page_facts(cut: DataFrame) -> DataFrame:
    """What the WARC files say of each page; the digest of a stored payload is computed anew and must agree."""
    home = working_folder(cut.sparkSession)

    def rows(path: str, start: int, end: int) -> Iterator[tuple]:
        for offset, _, fields, block in records("warc", path, home, start, end):
            if fields.get("content-type") != HTTP_TYPE:
                continue
            head, payload = http_parts(block)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            size = int(head_field(head, "Content-Length"))
            if fields["warc-type"] == "response" and (sha1(payload), len(payload)) != (digest, size):
                raise ValueError(f"{path} at {offset}: the payload does not fit its digest")
            yield fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), head_field(head, KEY_HEADER), size, digest

    return _by_segment(cut, rows, "record_type string, record_id string, refers string, page_id string, payload_bytes long, payload_digest string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Archive all pages as ARC files, convert these, and report what the WARC files hold of each page."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    # packed, as archives are kept: a file holds what one task reads of the pages
    write_arcs(page_records(pages), f"{folder}/arc", compression="gzip")
    convert(spark, f"{folder}/arc", f"{folder}/warc", KEY_HEADER, kind.simpleString(), compression="gzip")
    facts = flat.written(page_facts(segments(spark, f"{folder}/warc", "warc")).withColumn("page_id", F.col("page_id").cast(kind)))
    # only responses that others refer to are looked up: one row per group of copies
    kept = facts.filter("refers IS NOT NULL").select("refers").distinct().join(
        facts.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")), "refers")
    out = facts.join(flat.written(kept), "refers", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_NUMBER = "('0x' || substr(h, {0}, 5))::BIGINT"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_NUMBER.format(5 * group + 1)} >> {shift}) & 31)::INTEGER, 1)"
                      for group in range(8) for shift in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""


@query(SQL)
def op11_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC files and back."""
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
