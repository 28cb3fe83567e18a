"""WARC output and a salvage reader.

Writing: one record per page in plain WARC/1.1 files, made by Spark's own text writer (the blank
line that ends a record is the writer's line separator), so archives go to any store Spark can
reach. Pages with equal payloads of at least `MIN_PAYLOAD` bytes are stored once: the smallest
page_id is the response, the others revisit it.

Reading: every file is parsed record by record; plain records and gzip members (of one or more
records) may alternate. A record must have a version line, a header block, a length within the
file, the closing blank line and a payload that matches its digest. After a failed check the
reader searches for the next version line or member, goes on from there, and reports the bytes
between as a gap. A member is inflated a piece at a time and its contents are salvaged in the same
way: records before and after damage, and those before the place where it is cut off, are kept.
Offsets inside a member count inflated bytes and stand beside the member's own. Only one record's
bytes are held at a time, and headers may have any length. binaryFile gives a task one file of up
to 2 GB as a value; larger files must be split before.

Null html counts as empty. Repeated page_ids make one record each; all rows of the smallest id are
responses, as none of them has a larger page_id than the others, so none can revisit. A null
page_id never becomes a response others refer to. An empty table makes an archive without records.
URLs lose control characters and spaces; a null URL is left out. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import bounded, shared_folder, ship, stored, table

MIN_PAYLOAD = 100
#: A file is read by one task as one value: this keeps it to some MB of usual pages.
RECORDS_PER_FILE = 500
#: Pages under so many bytes (None: any) go so many to a file at most, so no file is beyond some 500 MB but for one page of its own.
SIZE_CLASSES = ((1 << 20, RECORDS_PER_FILE), (1 << 24, 30), (None, 1))
#: Bytes inflated at a time.
PIECE = 1 << 20
_MEMBER = re.compile(rb"\x1f\x8b\x08")
_BLANK = re.compile(rb"\r\n\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_VERSION_BYTES = 10
_DIGEST = re.compile(r"sha256:([0-9a-f]{64})$")
RECORD = "path string, kind string, offset long, inner_offset long, length long, reason string, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string"


def write(pages: DataFrame, folder: str, size_classes: tuple = SIZE_CLASSES) -> None:
    """Write a record for each row (page_id, url, html) into WARC files under folder, large pages into files of few records."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    firsts = rows.where(F.col("bytes") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    rows = rows.join(bounded(stored(firsts)), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("bytes"))),
    )
    value = F.concat(header, F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("html"))).alias("value")
    least = 0
    for limit, records in size_classes:
        mine = (F.col("bytes") >= least) & (F.lit(True) if limit is None else F.col("bytes") < limit)
        rows.where(mine).select(value).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(folder)
        least = limit


class Source:
    """Bytes that arrive in pieces: what was read and not dropped yet, addressed by offsets from the first byte."""

    def __init__(self, held: bytearray | memoryview, pieces: Iterator[bytes] | None = None) -> None:
        self.held, self.pieces, self.before, self.ended = held, pieces, 0, pieces is None
        self.known: dict[re.Pattern, int] = {}  # where a mark was last found; nothing lies between its search and it

    def reach(self, end: int) -> bool:
        """Whether there are bytes up to `end`; reads on as far as needed."""
        while not self.ended and self.before + len(self.held) < end:
            piece = next(self.pieces, None)
            if piece is None:
                self.ended = True
            else:
                self.held += piece
        return self.before + len(self.held) >= end

    def end(self) -> int:
        return self.before + len(self.held)

    def get(self, start: int, stop: int) -> bytes:
        self.reach(stop)
        return bytes(self.held[start - self.before : stop - self.before])

    def find(self, what: re.Pattern, start: int, size: int) -> int:
        """Where `what` (of `size` bytes) first occurs at or after start, or -1; starts never fall."""
        last = self.known.get(what)
        if last is not None and (last == -1 or last >= start):
            return last
        at = start
        while True:
            if found := what.search(self.held, at - self.before):
                self.known[what] = self.before + found.start()
                return self.known[what]
            at = max(start, self.end() - size + 1)
            if not self.reach(self.end() + 1):
                self.known[what] = -1
                return -1

    def drop(self, upto: int) -> None:
        """Bytes before `upto` aren't asked for any more."""
        if upto - self.before > PIECE:
            del self.held[: upto - self.before]
            self.before = upto


def _record(source: Source, at: int) -> tuple[dict | str, int]:
    """A record that starts at `at` and its end, or why there is none."""
    if not _VERSION.match(source.get(at, at + _VERSION_BYTES)):
        return "no version line", at
    blank = source.find(_BLANK, at, 4)
    if blank < 0:
        return "no end of header", at
    fields = {}
    for line in source.get(at + _VERSION_BYTES, blank).decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return "bad header line", at
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,18}", size := fields.get("content-length", "")):
        return "bad length", at
    start, stop = blank + 4, blank + 4 + int(size)
    if not source.reach(stop + 4) or source.get(stop, stop + 4) != b"\r\n\r\n":
        return "no closing blank line", at
    digest = hashlib.sha256(source.get(start, stop)).hexdigest()
    kind = fields.get("warc-type", "")
    told = _DIGEST.search(fields.get("warc-payload-digest", ""))
    if kind != "revisit" and told and told[1] != digest:
        return "digest differs", at
    length = fields.get("x-payload-length", "0") if kind == "revisit" else size
    names = ("warc-record-id", "warc-refers-to", "warc-target-uri")
    known = dict(zip(("record_id", "refers_to", "target_uri"), map(fields.get, names), strict=True))
    known |= {"record_type": kind, "payload_bytes": int(length) if length.isdigit() else 0}
    return known | {"payload_digest": told[1] if told and kind == "revisit" else digest}, stop + 4


def _contents(source: Source) -> Iterator[dict]:
    """Records and gaps of bytes that hold no members."""
    at, gap, why = 0, None, ""
    while source.reach(at + 1):
        found, end = _record(source, at)
        if isinstance(found, str):
            if gap is None:
                gap, why = at, found
            at = source.find(_VERSION, at + 1, _VERSION_BYTES)
            if at < 0:
                break
            source.drop(at)
            continue
        if gap is not None:
            yield {"kind": "gap", "start": gap, "length": at - gap, "reason": why}
            gap = None
        yield found | {"kind": "record", "start": at, "length": end - at}
        at = end
        source.drop(at)
    if gap is not None:
        yield {"kind": "gap", "start": gap, "length": source.end() - gap, "reason": why}


def _inflated(data: memoryview, at: int, state: dict) -> Iterator[bytes]:
    """The contents of the member that starts at `at`; state gets its end, and its error if it has one."""
    inflate = zlib.decompressobj(31)
    state |= {"end": at, "error": None}
    while not inflate.eof:
        rest = inflate.unconsumed_tail or data[state["end"] : state["end"] + PIECE]
        if not inflate.unconsumed_tail:
            state["end"] += len(rest)
        before = inflate.copy()
        try:
            piece = inflate.decompress(rest, PIECE)
        except zlib.error as e:
            state["error"] = f"gzip: {e}"[:80]
            yield from _upto_damage(before, rest)
            return
        if not piece and not len(rest) and not inflate.eof:
            state["error"] = "gzip: cut off"
            return
        yield piece
    state["end"] -= len(inflate.unused_data)


def _upto_damage(inflate, rest: bytes | memoryview) -> Iterator[bytes]:
    """What inflates before the byte that fails."""
    for k in range(len(rest)):
        try:
            yield inflate.decompress(rest[k : k + 1])
        except zlib.error:
            return


def _member(data: memoryview, at: int, state: dict) -> Iterator[dict]:
    """Records and gaps of a member; where inflating fails, up to its last record."""
    waiting = []
    for x in _contents(Source(bytearray(), _inflated(data, at, state))):
        waiting.append({**x, "offset": at, "inner_offset": x["start"]})
        if x["kind"] == "record":
            yield from waiting
            waiting = []
    if state["error"] is None:
        yield from waiting


def salvage(data: bytes | memoryview) -> Iterator[dict]:
    """Records of an archive and the gaps between them, in file order."""
    data, at, gap, why = memoryview(data), 0, None, ""
    whole = Source(data)
    while at < len(data):
        if _MEMBER.match(data, at):
            state: dict = {}
            for x in _member(data, at, state):
                if gap is not None:
                    yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
                    gap = None
                yield x
            if state["error"] is None:
                if gap is not None:
                    yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
                    gap = None
                at = state["end"]
                continue
            found = state["error"]
        else:
            found, end = _record(whole, at)
            if not isinstance(found, str):
                if gap is not None:
                    yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
                    gap = None
                yield found | {"kind": "record", "offset": at, "length": end - at}
                at = end
                continue
        if gap is None:
            gap, why = at, found
        later = [x for x in (whole.find(_VERSION, at + 1, _VERSION_BYTES), whole.find(_MEMBER, at + 1, 3)) if x >= 0]
        at = min(later, default=len(data))
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": why}


def read(spark, folder: str) -> DataFrame:
    """Records and gaps of all archives under folder; kind tells which."""
    ship(spark)
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    schema = pa.schema([(f.split(" ")[0], pa.int64() if f.endswith("long") else pa.string()) for f in RECORD.split(", ")])

    def parse(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                path, content = batch.column("path")[row].as_py(), batch.column("content")[row].as_buffer()
                for found in _in_lots(salvage(memoryview(content)), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array([path if n == "path" else x.get(n) for x in found], schema.field(n).type) for n in names], schema=schema)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(parse, RECORD)


def _in_lots(rows: Iterator[dict], size: int) -> Iterator[list[dict]]:
    lot = []
    for row in rows:
        lot.append(row)
        if len(lot) == size:
            yield lot
            lot = []
    if lot:
        yield lot


def op10_warc(spark, sf_dir) -> DataFrame:
    """Pages written as WARC and read back."""
    folder = f"{shared_folder(spark)}/warc"
    write(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read(spark, folder).where("kind = 'record'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"))


OP10_SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id > m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id > m THEN m END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS m FROM pages)
"""
