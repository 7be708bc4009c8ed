"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.arrow_batches import small_batches
from strandlake.llm.files import attempt_name, locate, make_folder
from strandlake.operators.hot_keys import split_hot
from strandlake.operators.sieve import BitSieve, sieve_bits
from strandlake.storage import cut

# Fixed values of the formats.
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:strandlake:page:"
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP head, with the payload's length, and leaves the payload out."""
    name = (uri or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {name}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-case names), payload and the payload's full length of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = len(payload)
    for line in http.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"content-length" and fields["warc-type"] == "revisit":
            length = int(v)
    return fields | {"payload": payload, "payload_bytes": length}


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_warc(
    df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    least_revisit: int = 0, file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write one record per row below ``folder``; returns the committed files: (file, bytes, records).

    Of rows with equal payloads of at least ``least_revisit`` bytes the one with the largest id is a response record,
    the others are revisit records that refer to it; smaller payloads are always responses. Payload digests are
    counted map-side. Digests of more than one row in 4096 are fewer than 4096 and broadcast, rows whose digest no other
    row has pass a sieve, and only payloads of the rest, groups of a few rows, are exchanged. A task starts a new file at
    ``file_bytes``. A lost task writes files of new names; only those of committed attempts are listed.

    Cases: a null payload is empty, a null url too; rows that repeat id and payload are all responses; a null id loses
    to any other and, where it revisits nothing, is a response without number. Very long payloads and urls are written whole, one record
    at a time. Other columns, whatever their names, are ignored. An empty table writes no file.
    """
    spark = df.sparkSession
    small_batches(spark, 500)
    make_folder(folder)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest")
    )
    same = rows.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    same = cut(same, "warc-digests")
    hot, cold = split_hot(same, "n", df.count())
    maybe = BitSieve(cold, ["digest"], sieve_bits(cold.count())).may_hold(rows, [F.col("digest")], "may_repeat")
    columns = ["digest", "id", "uri", "payload", "first"]
    known = maybe.join(F.broadcast(hot.drop("n")), "digest", "left")
    stays = known.where("first is not null or not may_repeat").select(columns)
    joined = stays.unionByName(known.where("first is null and may_repeat").drop("first").join(cold.drop("n"), "digest", "left").select(columns))
    refers = F.when((F.octet_length("payload") >= least_revisit) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = locate(folder)
        out, name, size, count, done = None, "", 0, 0, []
        for b in batches:
            for page, uri, text, ref in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name, size, count = attempt_name("part", ".warc.gz"), 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = _gzip(record(page, uri, text.encode("utf-8"), ref, ref is not None))
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((name, size, count))
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            columns = [pa.array([d[i] for d in done]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "bytes", "records"])

    written = joined.select("id", "uri", "payload", refers.alias("ref")).mapInArrow(run, "file string, bytes long, records long")
    return cut(written, "warc-files")


class Archive:
    """Gzip members of a file, which is read through a window of ``chunk`` bytes that moves forward."""

    def __init__(self, source, size: int, chunk: int = 1 << 20):
        self.source, self.size, self.chunk = source, size, chunk
        self.held, self.base = b"", 0

    def _at(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if offset < self.base or offset + n > self.base + len(self.held):
            self.base = offset
            self.held = self.source.read_at(min(max(n, self.chunk), self.size - offset), offset)
        return self.held[offset - self.base : offset - self.base + n]

    def _pieces(self, offset: int) -> Iterator[tuple[bytes, int]]:
        """Contents of the member at ``offset`` bit by bit, each with the place up to which the file is used. ValueError
        if it is no whole member."""
        z, at = zlib.decompressobj(31), offset
        while not z.eof:
            piece = self._at(at, 1 << 14)
            if not piece:
                raise ValueError(f"the member at byte {offset} is cut off")
            try:
                out = z.decompress(piece)
            except zlib.error as e:
                raise ValueError(f"the member at byte {offset} is damaged: {e}") from e
            at += len(piece)
            yield out, at - len(z.unused_data)

    @staticmethod
    def _is_head(start: bytes) -> bool | None:
        """Whether ``start`` begins a record, None if more bytes are needed to tell. A head may be of any length."""
        if not start.startswith(b"WARC/1."[: len(start)]):
            return False
        head, gap, _ = start.partition(b"\r\n\r\n")
        if not gap:
            return None
        names = {x.partition(b":")[0].strip().lower(): x.partition(b":")[2].strip() for x in head.split(b"\r\n")[1:]}
        return b"warc-type" in names and names.get(b"content-length", b"").isdigit()

    def member(self, offset: int, keep: bool) -> tuple[bool, int, bytes]:
        """(it is a record, where it ends, its bytes if ``keep``) of the whole member at ``offset``."""
        parts, said, end = [], None, offset
        for out, end in self._pieces(offset):
            if said is None or keep:
                parts.append(out)
            if said is None and out:
                said = self._is_head(b"".join(parts))
                if said is not None and not keep:
                    parts = []
        return bool(said), end, b"".join(parts) if keep and said else b""

    def find(self, start: int, stop: int) -> int | None:
        """The first place from ``start`` to before ``stop`` with gzip magic whose member decodes to a record's head."""
        at = start
        while at < stop:
            window = self._at(at, min(self.chunk, stop - at) + len(_MAGIC) - 1)
            hit = window.find(_MAGIC)
            while hit >= 0:
                if at + hit < stop and self._begins(at + hit):
                    return at + hit
                hit = window.find(_MAGIC, hit + 1)
            at += self.chunk
        return None

    def _begins(self, offset: int) -> bool:
        start, said = b"", None
        try:
            for out, _ in self._pieces(offset):
                start += out
                said = self._is_head(start) if start else None
                if said is not None:
                    return said
        except ValueError:
            pass
        return False

    def records(self, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of the records of the members that follow each other from ``start`` on, up to the last that begins
        before ``stop``."""
        at = start
        while at < stop:
            record, end, raw = self.member(at, True)
            if record:
                yield at, raw
            at = end

    def end_of(self, start: int, stop: int) -> int:
        """Where the first member that follows on from ``start`` and begins at or after ``stop`` is. Behind what is no
        member (``start`` was none, or there is damage, which ``records`` reports) the next record counts."""
        at = start
        while at < stop:
            try:
                at = self.member(at, False)[1]
            except ValueError:
                found = self.find(at + 1, self.size)
                at = self.size if found is None else found
        return at


def _ranges(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int) -> DataFrame:
    """(file, bytes, start, first): ranges of the files with the member that each begins with, where one begins in it.

    A task guesses: the first place of its range at which a record's head decodes. It hands on where the first member
    behind its range begins, by following members from there. A guess may lie in a payload that holds an archive; it is
    right if it is what the ranges before hand on, down to the file's start. Ranges of wrong guesses follow from there
    instead, which in turn may change what they hand on, until all agree: then each range has what one reader of the whole
    file would have. A round sets right the first wrong range of every file at least, and usually all.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    kind = "file string, bytes long, start long, first long, end long"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = locate(folder)
        for b in batches:
            out = []
            for name, size, start, known in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                stop = min(start + split_bytes, size)
                with fs.open_input_file(f"{path}/{name}") as source:
                    archive = Archive(source, size)
                    first = 0 if start == 0 else archive.find(start, stop) if known is None else known
                    out.append((name, size, start, first, None if first is None else archive.end_of(first, stop)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), *[pa.int64()] * 4), strict=True)], names=["file", "bytes", "start", "first", "end"])

    def tasks(rows: DataFrame) -> DataFrame:
        return rows.repartition(max(1, min(rows.count(), 100_000)))

    found = cut(tasks(splits.withColumn("known", F.lit(None).cast("long"))).mapInArrow(follow, kind), "warc-ranges")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    while True:
        due = F.coalesce(F.last("end", ignorenulls=True).over(before), F.lit(0))
        told = found.withColumn("due", due).withColumn("owns", F.col("due") < F.least(F.col("start") + split_bytes, "bytes"))
        told = cut(told.withColumn("wrong", ~F.when(F.col("owns"), F.col("due")).eqNullSafe(F.col("first"))), "warc-ranges")
        if not told.where("wrong").limit(1).count():
            return told.select("file", "bytes", "start", "first")
        right = told.where("not wrong").select(found.columns)
        passed = told.where("wrong and not owns").select("file", "bytes", "start", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("end"))
        again = tasks(told.where("wrong and owns").select("file", "bytes", "start", F.col("due").alias("known"))).mapInArrow(follow, kind)
        found = cut(right.unionByName(passed).unionByName(again), "warc-ranges")


def read_warc(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Records of ``files`` (file, bytes): (file, offset, record_type, record_id, refers_to, uri, digest, payload, payload_bytes).

    Every file is cut into ranges of ``split_bytes``, each a task: it looks for gzip magic from its range's start,
    validates a candidate by decoding the head there, and owns the records that start inside its range, reading past
    its end where a record does. Ranges settle with each other what starts where (``_ranges``), so no index is needed and
    the records are the same for any ``split_bytes``.

    Cases: heads and payloads may be of any length (one record is held at a time); members that are no records are left
    out; an archive inside a payload is payload; a record ends with its member, whatever its head says of its length. A
    response's digest is computed from its payload and checked against the head; a payload that differs, and a damaged or
    cut-off member, raise ValueError. An empty file, or table of files, has no records.
    """
    small_batches(spark)
    ranges = _ranges(spark, files, folder, split_bytes).where("first is not null")
    names = ["file", "offset", "record_type", "record_id", "refers_to", "uri", "digest", "payload", "payload_bytes"]
    types = ["string", "long", "string", "string", "string", "string", "string", "binary", "long"]
    arrow = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64()]

    def rows(name: str, size: int, start: int, first: int) -> Iterator[tuple]:
        fs, path = locate(folder)
        with fs.open_input_file(f"{path}/{name}") as source:
            for offset, raw in Archive(source, size).records(first, min(start + split_bytes, size)):
                r = parse_record(raw)
                said = r.get("warc-payload-digest", "").removeprefix("sha1:")
                if r["warc-type"] == "response" and said and said != payload_digest(r["payload"]):
                    raise ValueError(f"{name}: the payload at byte {offset} differs from its digest")
                yield (
                    name, offset, r["warc-type"], r.get("warc-record-id", "").strip("<>"), r.get("warc-refers-to", "").strip("<>") or None,
                    r.get("warc-target-uri"), said, r["payload"], r["payload_bytes"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(arrow)], names=names)

        for b in batches:
            for name, size, start, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for row in rows(name, size, start, first):
                    held.append(row)
                    weight += len(row[7])
                    if weight >= 8 << 20 or len(held) >= 1000:
                        yield flush()
                        held, weight = [], 0
        if held:
            yield flush()

    parts = max(1, min(ranges.count(), 100_000))
    return ranges.repartition(parts).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def page_number(record_id):
    """The page id in a record id column (null where it has none)."""
    return F.expr(f"try_cast(substring({record_id}, {len(_ID) + 1}) as long)")
