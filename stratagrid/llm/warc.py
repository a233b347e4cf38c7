"""WARC 1.1 archives: revisit deduplication on writing, segment reassembly on reading.

Writing. Of pages with equal payloads the one with the largest id is a response record, the others are revisit records
that refer to it. Payloads are grouped by digest with map-side sums, so one copy of a payload leaves a task. A response
block is HTTP with chunked framing; a block over `segment` bytes is cut: the first record has segment number 1, the
rest are continuation records, in files of their own, that name it as their origin, and the last has the total length.
Each record is a gzip member; files are rolled at ROLL bytes. The names of the files that ended well are a table beside
them, so what a lost attempt leaves is not read.

Reading. Files are streamed and parsed on executors; a member can hold several records, and plain files do too. Whole
records are digested at once. Segments are grouped by origin identifier, ordered by number, and must be 1 .. n with the
stated total length; then the HTTP block is split and the chunked framing decoded. What fails is a row with a problem,
not an exception; after damage the reader goes on at the next member or record that it finds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ROLL = 8 << 20
#: Bytes read at once, bytes of archives for a task, and of a record's header at most.
PIECE, TASK_BYTES, HEAD = 1 << 14, 16 << 20, 1 << 20
MEMBER = b"\x1f\x8b\x08"
FILES = "path string, bytes bigint"
CHUNK = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, record_type string, refers_id string, digest string, payload_bytes bigint, origin string, segment int, total bigint, block binary, problem string"
RECORD = "record_id string, record_type string, refers_id string, digest string, payload_bytes bigint, problem string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over. Raises ValueError where it breaks off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        digits = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            raise ValueError("a chunk's size is no hexadecimal number")
        size = int(digits, 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *headers, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode() + block + b"\r\n\r\n"


def response(record_id: str, url: str, payload: bytes, segment: int) -> tuple[bytes, list[bytes]]:
    """A response record and its continuations."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    headers = [("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return record("response", record_id, headers, block), []
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    more = []
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        more.append(record("continuation", f"{record_id}:{n}", [("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n)), *last], part))
    return record("response", record_id, [*headers, ("WARC-Segment-Number", "1")], parts[0]), more


def revisit(record_id: str, url: str, refers: str, refers_url: str, digest: str, size: int) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("revisit", record_id, [("WARC-Target-URI", url), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>"), ("WARC-Refers-To-Target-URI", refers_url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], block)


class _Roller:
    """Files of one kind; each has a name of this attempt's own."""

    def __init__(self, folder: str, name: str):
        self.store, self.base = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(self.base, recursive=True)
        self.folder, self.name, self.stream, self.n, self.files, self.sizes = folder, name, None, 0, [], []

    def write(self, raw: bytes) -> None:
        if self.stream is None or self.n >= ROLL:
            self.close()
            leaf = f"{self.name}-{len(self.files):05d}.warc.gz"
            self.stream, self.n = self.store.open_output_stream(f"{self.base}/{leaf}", compression=None), 0
            self.files.append(f"{self.folder}/{leaf}")
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.stream.write(packed)
        self.n += len(packed)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.sizes.append(self.n)
            self.stream = None


def _write(folder: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        main, more = _Roller(folder, f"main-{name}"), _Roller(folder, f"more-{name}")
        for b in batches:
            for r in b.to_pylist():
                url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                if r["payload"] is None:
                    main.write(revisit(r["id"], url, r["refers"], "", base64.b32encode(bytes.fromhex(r["h"])).decode(), r["n"]))
                else:
                    first, rest = response(r["id"], url, r["payload"].encode(), segment)
                    main.write(first)
                    for x in rest:
                        more.write(x)
        main.close()
        more.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(main.files + more.files, pa.string()), "bytes": pa.array(main.sizes + more.sizes, pa.int64())})

    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment: int = 16384) -> str:
    """Write a record for each row of pages under folder, and the table of its files; returns folder.

    A null html is an empty payload, a null url an empty one. Payloads under `least` bytes are all responses. Of repeated
    rows one is the response. Record ids are urn:page:<page id>:<digest>:<copy>, so they are unique even if page ids are
    not; a null page id is an empty string there, and comes after all others.
    """
    spark = pages.sparkSession
    shared.prepare(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.select("page_id", "url", F.sha1("payload").alias("h"), F.octet_length("payload").cast("long").alias("n"), "payload")
    name = lambda p, h, c: F.concat_ws(":", F.lit("urn:page"), F.coalesce(p.cast("string"), F.lit("")), h, c.cast("string"))
    large, small = rows.where(F.col("n") >= least), rows.where(F.col("n") < least)
    first = large.groupBy("h").agg(F.max(F.struct("page_id", "url")).alias("top"), F.first("payload").alias("payload"), F.first("n").alias("n"))
    main = first.select(name(F.col("top.page_id"), F.col("h"), F.lit(0)).alias("id"), "top.url", F.lit("").alias("refers"), "h", "n", "payload")
    same = large.groupBy("h", "page_id", "url", "n").agg(F.count("*").alias("c"))
    tops = large.groupBy("h").agg(F.max(F.struct("page_id", "url")).alias("top"))
    is_top = F.col("top.page_id").eqNullSafe(F.col("page_id")) & (F.col("top.url") == F.col("url"))
    # urls that share (page id, digest) number on, so that copies' names differ
    hot = shared.hot_keys(same.groupBy("h").agg(F.count("*").alias("n")), ["h"])
    copies = shared.join_spread(same, tops, ["h"], hot, "inner").withColumn("from", F.when(is_top, 1).otherwise(0)).where("from < c").select("h", "page_id", "url", "n", "top", F.explode(F.sequence(F.col("from"), F.col("c") - 1)).alias("copy"))
    tag = F.when(F.col("top.page_id").eqNullSafe(F.col("page_id")) & (F.col("top.url") == F.col("url")), F.col("copy").cast("string")).otherwise(F.concat_ws("-", F.hex(F.xxhash64("url")), F.col("copy").cast("string")))
    again = copies.select(name(F.col("page_id"), F.col("h"), tag).alias("id"), "url", name(F.col("top.page_id"), F.col("h"), F.lit(0)).alias("refers"), "h", "n", F.lit(None).cast("string").alias("payload"))
    alone = small.select(name(F.col("page_id"), F.col("h"), F.concat(F.lit("s"), F.monotonically_increasing_id())).alias("id"), "url", F.lit("").alias("refers"), "h", "n", "payload")
    out = main.unionByName(again) if least <= 0 else main.unionByName(again).unionByName(alone)
    out.mapInArrow(_write(folder, segment), FILES).write.parquet(f"{folder}/files")
    return folder


class Damaged(ValueError):
    """What is compressed breaks off here."""


class Malformed(ValueError):
    """No record can be read here."""


def inflate(stream) -> Iterator[bytes | Damaged]:
    """Decompressed pieces of successive members, or those of a plain file; Damaged in place of the rest of a bad member."""
    held = stream.read(PIECE)
    if held[:2] != MEMBER[:2]:
        while held:
            yield held
            held = stream.read(PIECE)
        return
    while held or (held := stream.read(PIECE)):
        opener, began = zlib.decompressobj(31), False
        try:
            while not opener.eof:
                if not held and not (held := stream.read(PIECE)):
                    raise zlib.error("the file ends inside a member")
                piece = opener.decompress(held)
                held, began = opener.unused_data if opener.eof else b"", True
                if piece:
                    yield piece
        except zlib.error as e:
            yield Damaged(f"a member is damaged: {e}")
            held = held[0 if began else 1 :]  # the next member begins where its signature is found
            while (at := held.find(MEMBER)) < 0:
                more = stream.read(PIECE)
                if not more:
                    return
                held = held[-2:] + more
            held = held[at:]


class _Source:
    def __init__(self, pieces: Iterator[bytes | Damaged]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0
        self.damage: Damaged | None = None

    def fill(self) -> bool:
        """Hold another piece; not beyond damage, before it is passed."""
        piece = None if self.damage else next(self.pieces, None)
        if isinstance(piece, Damaged):
            self.damage = piece
            return False
        if self.at > 1 << 16:
            del self.held[: self.at]
            self.at = 0
        self.held += piece or b""
        return piece is not None

    def passed(self) -> Damaged | None:
        """Go on behind the damage that ended what is held."""
        self.held, self.at, found, self.damage = bytearray(), 0, self.damage, None
        return found

    def more(self) -> bool:
        """Pass over line ends between records; whether anything follows."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.held):
                return True
            if not self.fill():
                return False

    def head(self) -> bytes:
        """The header that begins here, without its end; the place stays."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", self.at + max(0, seen - 3))) < 0:
            seen = len(self.held) - self.at
            if seen > HEAD or not self.fill():
                raise Malformed("a record's header has no end")
        return bytes(self.held[self.at : end])

    def ahead(self, n: int) -> int:
        """How many of the next n bytes there are; the place stays."""
        while len(self.held) - self.at < n:
            if not self.fill():
                break
        return min(n, len(self.held) - self.at)

    def record(self, head: int, length: int) -> bytes:
        """The block behind a header of `head` bytes; line ends or another record must follow it."""
        whole = head + length
        if self.ahead(whole) < whole:
            raise Malformed("a record is shorter than its length")
        self.ahead(whole + 5)
        gap = bytes(self.held[self.at + whole : self.at + whole + 5])
        if gap and gap[:4] not in b"\r\n\r\n" and gap != b"WARC/":
            raise Malformed("a record's length is not where it ends")
        out = bytes(self.held[self.at + head : self.at + whole])
        self.at += whole
        return out

    def seek(self, mark: bytes) -> bool:
        """Go on to the next mark behind this place."""
        self.at += 1
        while (found := self.held.find(mark, self.at)) < 0:
            self.at = max(self.at, len(self.held) - len(mark) + 1)
            if not self.fill():
                return False
        self.at = found
        return True


def parse(stream) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, problem) of each record in a file; a problem has the headers that could be read, or none."""
    source = _Source(inflate(stream))
    lost = False
    while True:
        headers: dict[str, str] = {}
        try:
            found = source.seek(b"WARC/1.") if lost else source.more()
            lost = False
            if not found:
                if not (damage := source.passed()):
                    return
                raise damage
            head = source.head()
            first, *lines = head.decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise Malformed("no record begins here")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = headers.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", length):
                raise Malformed("a record's length is no number")
            yield headers, source.record(len(head) + 4, int(length)), None
        except Damaged as e:
            yield headers, b"", str(e)
        except Malformed as e:
            damage = source.damage and source.passed()
            yield headers, b"", str(damage or e)
            lost = not damage


def payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return unchunked(body)
    stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
    if stated and int(stated[1]) != len(body):
        raise ValueError("the body differs from its length")
    return body


def settle(block: bytes, claimed: str | None) -> tuple[str | None, int | None, str | None]:
    """(digest, payload bytes, problem) of a whole response block."""
    try:
        found = payload(block)
    except ValueError as e:
        return None, None, str(e)
    digest = base32_sha1(found)
    return digest, len(found), None if not claimed or claimed == digest else "the payload differs from its digest"


def _fields(h: dict[str, str], block: bytes, problem: str | None) -> dict:
    """A row of PARSED."""
    bare = lambda x: x.strip("<>") if x else None
    claimed = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = dict.fromkeys(PARSED_NAMES) | {"record_id": bare(h.get("warc-record-id")), "record_type": h.get("warc-type"), "refers_id": bare(h.get("warc-refers-to")), "digest": claimed, "problem": problem}
    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
    if problem:
        row["digest"] = None
    elif any(x and not re.fullmatch("[0-9]{1,9}", x) for x in (number, total)):
        row |= {"digest": None, "problem": "a segment's number or total length is no number"}
    elif number and not (h.get("warc-segment-origin-id") or row["record_id"]):
        row |= {"digest": None, "problem": "a segment names no origin"}
    elif number:
        row |= {"origin": bare(h.get("warc-segment-origin-id")) or row["record_id"], "segment": int(number), "total": int(total) if total else None, "block": zlib.compress(block, 1)}
    elif row["record_type"] == "revisit":
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block)
        row["payload_bytes"] = int(stated[1]) if stated else None
    elif row["record_type"] == "response":
        row["digest"], row["payload_bytes"], row["problem"] = settle(block, claimed)
    else:
        row["digest"], row["payload_bytes"] = base32_sha1(block), len(block)
    return row


PARSED_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_bytes": pa.int64(), "total": pa.int64(), "segment": pa.int32(), "block": pa.binary()}
    out = lambda rows: pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in PARSED_NAMES})
    for b in batches:
        for path in b.column("path").to_pylist():
            store, name = pafs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                for record_ in parse(stream):
                    rows.append(_fields(*record_))
                    held += 500 + len(rows[-1]["block"] or b"")
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
            yield out(rows)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["segment"])
            lead = parts[0]
            block, total = b"".join(zlib.decompress(p["block"]) for p in parts), next((p["total"] for p in parts if p["total"] is not None), None)
            out = {"record_id": r["origin"], "record_type": "response", "refers_id": None, "digest": None, "payload_bytes": None, "problem": None}
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                out["problem"] = "segments are missing or repeated"
            elif total is None or total != len(block):
                out["problem"] = "the segments differ from the total length"
            else:
                out["digest"], out["payload_bytes"], out["problem"] = settle(block, lead["digest"])
            rows.append(out)
        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], pa.int64() if k == "payload_bytes" else pa.string()) for k in (x.split()[0] for x in RECORD.split(", "))})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """records() of the archives that write() made in folder."""
    return records(spark.read.schema(FILES).parquet(f"{folder}/files"))


def records(files: DataFrame) -> DataFrame:
    """A row for each record in the files (path, bytes), segments joined: record_id, record_type, refers_id, digest
    (base32 SHA-1 of the whole payload), payload_bytes, problem (null where all is well).

    Files are gzip members or plain text, of any size. A response's payload is its HTTP body; a revisit's digest and size
    are as stated; other types' payload is their block. What is damaged, cut short or malformed is a row with a problem and
    the fields that could be read, and no other record is lost by it than those that share its member.
    """
    spark = files.sparkSession
    shared.prepare(spark)
    tasks = shared.parts(files.agg(F.sum("bytes")).head()[0] or 0, TASK_BYTES)
    parsed = shared.materialise(files.select("path").repartition(tasks).mapInArrow(_parse, PARSED), "records")
    names = [x.split()[0] for x in RECORD.split(", ")]
    parts = parsed.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block", "digest")).alias("parts"))
    return parsed.where("origin IS NULL").select(*names).unionByName(parts.mapInArrow(_join, RECORD))


def page_of(record_id: str):
    """The page id in a record id that write() gave."""
    return F.expr(f"try_cast(split_part({record_id}, ':', 3) AS bigint)")
