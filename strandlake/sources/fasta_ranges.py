"""FASTA files by byte ranges, so that many tasks read one long record."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.storage import cut

_NAME = 1023  # characters of a name that are kept
_LOOK = 4 * _NAME + 4  # bytes that hold as many characters
#: Letters by byte: A, C, G and T of either case stay, other characters become N. Characters up to code 64 are dropped, and so
#: are the bytes after the first of a longer character.
_LETTER = bytes(ord(chr(b).upper()) if chr(b) in "ACGTacgt" else ord("N") for b in range(256))
_DROPPED = bytes([*range(65), *range(0x80, 0xC0)])
_HEAD = re.compile(rb"(?<=\n)>[^\n]*")
_PIECES = "file string, range int, piece int, name string, lead string, seq string, shown boolean, open boolean, last boolean"


def _letters(raw: bytes) -> str:
    return raw.translate(_LETTER, _DROPPED).decode("ascii")


def _shown(raw: bytes) -> bool:
    return bool(raw.strip(b" \r\n"))


def _name(line: bytes) -> str:
    """Name in a header line (without its first character)."""
    return re.match(rb"[^ \t\n\x0b\f\r]*", line).group().decode("utf-8", "replace")[:_NAME]


def split_range(raw: bytes, before: bytes, after: bytes) -> list[tuple]:
    """(piece, name, lead, seq, shown, open, last) of a byte range; ``before`` is the byte before it (empty at the file's
    start), ``after`` some bytes behind it.

    Piece 0 is what stands before the range's first header: ``lead`` are the letters of the line that the range begins
    inside of, which may be a header's rest, ``seq`` those of the lines behind it. ``open`` tells whether the range ends
    inside a header, null if it has no line's start, so that this is as it was before. Every header that begins in the range
    is a piece more, unless its record ends here too and is blank.
    """
    whole = before in (b"", b"\n")
    stop = 0 if whole else (raw.find(b"\n") + 1 or len(raw))
    begins = whole or raw.find(b"\n") >= 0  # whether a line begins in the range or right behind it
    padded = b"\n" + raw if whole else raw
    shift = len(padded) - len(raw)
    heads = [(m.start() - shift, m.end() - shift) for m in _HEAD.finditer(padded)]
    first = heads[0][0] if heads else len(raw)
    front = raw[stop:first]
    ends = [h[0] for h in heads[1:]] + [len(raw)] * bool(heads)
    out = [(0, None, _letters(raw[:stop]), _letters(front), _shown(raw[:stop]) or _shown(front))]
    for (at, line), end in zip(heads, ends, strict=True):
        text = raw[at + 1 : line]
        shown = _shown(text) or _shown(raw[line:end]) or (before == b"" and at == 0)
        if shown or end == len(raw):
            known = text + after.split(b"\n", 1)[0] if line == len(raw) else text
            out.append((len(out), _name(known), "", _letters(raw[line:end]), shown))
    if heads:
        opened: bool | None = heads[-1][1] == len(raw)
    else:
        opened = False if begins else None
    return [(*row, opened if i == 0 else None, i == len(out) - 1) for i, row in enumerate(out)]


def _pieces(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)  # names and sizes only
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length")).where("length > 0")
    ranges = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes))).alias("range", "at"))
    ranges = cut(ranges, "fasta-ranges")
    schema = pa.schema(
        [("file", pa.string()), ("range", pa.int32()), ("piece", pa.int32()), ("name", pa.string()), ("lead", pa.string()), ("seq", pa.string())]
        + [(c, pa.bool_()) for c in ("shown", "open", "last")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, number, at in zip(*(b.column(c).to_pylist() for c in ("path", "range", "at")), strict=True):
                fs, where = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(where) as f:
                    f.seek(max(0, at - 1))
                    before = f.read(1) if at else b""
                    raw, after = f.read(range_bytes), f.read(_LOOK)
                rows = split_range(raw, before, after)
                for i in range(0, len(rows), 10_000):
                    columns = [pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 10_000]), list(schema)[2:], strict=True)]
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([number] * n, pa.int32()), *columns], schema=schema)

    count = ranges.count()
    tasks = max(1, min(count, -(-count * range_bytes // (1 << 20)), 100_000))  # a task reads a megabyte at least
    return cut(ranges.repartitionByRange(tasks, "path", "range").mapInArrow(run, _PIECES), "fasta-pieces")


def read_parts(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """(seq_index, seq_id, at, seq, length): the records of ``read_fasta`` in parts, each of which begins at ``at`` in its
    record of ``length`` bases. A part lies in one range of ``range_bytes`` of a file, so a record of any length, wrapped or on
    one line, is read by as many tasks as it has ranges.

    Ranges are parsed apart. Whether one begins inside a header, how many records came before, and where in a record it
    begins follow from a table of one row a range, by running sums. Files are taken in the order of their paths.

    Cases: records without bases have one empty part, of ``length`` 0; blank records (spaces and line ends only) don't
    count; text before the first header is a record without a name; empty files have no records. Files may not be
    compressed, as their ranges can't be read apart (``read_fasta`` reads those).
    """
    pieces = _pieces(spark, path, range_bytes)
    n = F.length("seq").cast("long")
    final = F.col("last") & (F.col("piece") > 0)
    ranges = pieces.groupBy("file", "range").agg(
        F.max("open").alias("open"), F.max("piece").alias("heads"),
        F.max(F.when(F.col("piece") == 0, F.length("lead").cast("long"))).alias("lead_n"),
        F.max(F.when(F.col("piece") == 0, n)).alias("rest_n"), F.max(F.when(F.col("piece") == 0, F.col("shown"))).alias("front_shown"),
        F.max(F.when(final, n)).alias("last_n"), F.max(F.when(final, F.col("shown"))).alias("last_shown"), F.max(F.when(final, F.col("name"))).alias("last_name"),
    )
    earlier = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.last("open", ignorenulls=True).over(earlier), F.lit(False)) & (F.col("range") > 0))
    ranges = ranges.withColumn("carried", F.coalesce(F.sum(F.when(F.col("heads") > 0, 1).otherwise(0)).over(earlier), F.lit(0)))
    # a record that reaches into further ranges: the last piece of one, the fronts of those behind it
    front_n = F.col("rest_n") + F.when(F.col("inside"), 0).otherwise(F.col("lead_n"))
    front = ranges.select("file", "range", "heads", F.col("carried").alias("c"), F.lit(True).alias("front"), front_n.alias("n"), F.col("front_shown").alias("shown"), F.lit(None).cast("string").alias("name"))
    tail = ranges.where("heads > 0").select("file", "range", "heads", (F.col("carried") + 1).alias("c"), F.lit(False).alias("front"), F.col("last_n").alias("n"), F.col("last_shown").alias("shown"), F.col("last_name").alias("name"))
    record = W.partitionBy("file", "c")
    chain = record.orderBy("range")
    long = front.unionByName(tail).select(
        "*", F.coalesce(F.sum("n").over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"), F.sum("n").over(record).alias("length"),
        F.max("shown").over(record).alias("counts"), F.coalesce(F.first("name").over(chain), F.lit("")).alias("seq_id"), (F.row_number().over(chain) == 1).alias("opens"),
    )
    long = cut(long, "fasta-long")
    # records that begin in each range: the one before the first header in the first, complete ones, and the last
    started = long.groupBy("file", "range").agg(
        F.sum(F.when(F.col("opens") & F.col("counts"), 1).otherwise(0)).cast("long").alias("kept"), F.max(F.when(F.col("front"), F.col("heads"))).alias("heads"),
        F.max(F.when(F.col("front") & F.col("opens") & F.col("counts"), 1).otherwise(0)).cast("long").alias("unnamed"),
    )
    count = F.col("kept") + F.greatest(F.col("heads") - 1, F.lit(0))
    numbers = started.select("file", "range", "unnamed", F.coalesce(F.sum(count).over(W.orderBy("file", "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = long.join(numbers, ["file", "range"])
    index = F.first(F.when(F.col("front"), F.col("base")).otherwise(F.col("base") + F.col("unnamed") + F.col("heads") - 1)).over(chain)
    place = lambda of, p: own.withColumn("index", index).where(of).select(
        "file", "range", *[F.col(c).alias(f"{p}_{c}") for c in ("index", "at", "length", "counts", "seq_id")]
    )
    known = ranges.select("file", "range", "inside", "heads").join(numbers, ["file", "range"]).join(place("front", "f"), ["file", "range"])
    known = cut(known.join(place("not front", "l"), ["file", "range"], "left"), "fasta-known")  # one row a range; Spark broadcasts it where it is small
    is_front, closing = F.col("piece") == 0, (F.col("piece") == F.col("heads"))
    pick = lambda f, l, e: F.when(is_front, f).when(closing, l).otherwise(e)  # noqa: E731, E741
    joined = pieces.join(known, ["file", "range"])
    parts = joined.select(
        pick(F.col("f_index"), F.col("l_index"), F.col("base") + F.col("unnamed") + F.col("piece") - 1).cast("int").alias("seq_index"),
        pick(F.col("f_seq_id"), F.col("l_seq_id"), F.col("name")).alias("seq_id"),
        pick(F.col("f_at"), F.lit(0), F.lit(0)).cast("long").alias("at"),
        F.when(F.col("inside"), F.col("seq")).otherwise(F.concat("lead", "seq")).alias("seq"),
        pick(F.col("f_length"), F.col("l_length"), n).alias("length"),
        pick(F.col("f_counts"), F.col("l_counts"), F.lit(True)).alias("_counts"),
        is_front.alias("_front"),
        "range",
    )
    opening = ~F.col("_front") | (F.col("range") == 0)
    return parts.where(F.col("_counts") & ((F.length("seq") > 0) | (opening & (F.col("length") == 0)))).drop("_counts", "_front", "range")


def tiles(parts: DataFrame, tile: int = 200_000, before: int = 0, after: int = 0) -> DataFrame:
    """(seq_index, at, first, part) of ``read_parts``: each record in tiles that begin at multiples ``first`` of ``tile`` and
    are read from ``before`` bases earlier (``at``) to ``after`` bases behind their end; tiles of no more than ``after``
    bases are left out. With ``after`` = k - 1 that is what k-mers are cut from.

    Tiles inside a part are cut where it is; only those that reach over a part's end are exchanged and joined.
    """
    end = F.col("at") + F.length("seq")
    low = F.greatest(F.floor((F.col("at") - tile - after) / tile) + 1, F.lit(0))
    high = F.least(F.floor((end - 1 + before) / tile), F.floor((F.col("length") - after - 1) / tile))
    rows = parts.where((F.length("seq") > 0) & (low <= high)).select("*", F.explode(F.sequence(low, high)).alias("_t"))
    first = F.col("_t") * tile
    want, stop = F.greatest(first - before, F.lit(0)), F.least(first + tile + after, F.col("length"))
    begin, close = F.greatest(want, F.col("at")), F.least(stop, end)
    some = rows.select(
        "seq_index", want.alias("at"), first.alias("first"), begin.alias("_b"), ((begin == want) & (close == stop)).alias("_whole"),
        F.substring("seq", (begin - F.col("at") + 1).cast("int"), (close - begin).cast("int")).alias("part"),
    ).where(F.length("part") > 0)
    here = some.where("_whole").select("seq_index", "at", "first", "part")
    over = some.where("not _whole").groupBy("seq_index", "at", "first").agg(F.sort_array(F.collect_list(F.struct("_b", "part"))).alias("_p"))
    return here.unionByName(over.select("seq_index", "at", "first", F.array_join("_p.part", "").alias("part")))
