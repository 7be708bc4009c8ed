"""Token ids in Arrow IPC files of equal-length sequences: written in document order, read back by random access."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.arrow_batches import give_back, small_batches
from strandlake.llm.files import attempt_name, locate, make_folder
from strandlake.storage import cut

_SEQUENCES = 256  # sequences in a record batch
#: Byte-level tokenizers write a byte as this character: itself if it prints, else one from U+0100 on, in order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


class WordEncoder:
    """A tokenizers file applied to whole texts by their blank-separated words, each encoded once while remembered.

    That gives the ids of the whole text if the tokenizer never joins characters across a space, tab or line feed, as
    one that drops white space before its merges does; ``check`` compares the two on a text and raises if they differ.
    Words of Latin letters with at most one mark behind them are looked up lower-cased and without the mark if the
    tokenizer itself folds case and splits marks off. Memory is bounded by ``remember`` words and a block's.
    """

    MARKS = ".,;:!?"
    BLOCK = 2 << 20  # characters of text that are split at a time

    def __init__(self, path: str, remember: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.marks = {m: self._whole(m) for m in self.MARKS}
        self.folds = all(self._whole(f"ABxY{m}") == self._whole("abxy") + self.marks[m] for m in self.MARKS)
        #: the narrowest type that holds every id
        self.dtype = "<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def check(self, text: str) -> None:
        if self.encode(pa.array([text]))[1].astype("<u4").tobytes() != self._whole(text):
            raise ValueError("this tokenizer can't be applied word by word")

    def _word(self, word: str) -> bytes:
        """Ids of a word that isn't known as it stands; what it consists of is remembered."""
        core, mark = (word[:-1], self.marks[word[-1]]) if self.folds and word[-1:] in self.marks else (word, b"")
        if self.folds and core.isalpha() and max(core) < "\u0180" and "\u0130" not in core:
            # one run of letters that are in normal form and have simple lower cases: straight to the tokenizer's merges
            core = core.lower()
            ids = self.known.get(core)
            if ids is None:
                piece = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = self.known[core] = array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
            return ids + mark
        ids = self.known[word] = self._whole(word)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each whole text, and all ids one after the other. Texts are not null."""
        spaced = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        lists = pc.split_pattern(spaced, " ")
        found = pc.dictionary_encode(lists.flatten())
        if len(self.known) > self.remember:
            self.known.clear()
        known, one = self.known.get, self._word
        raw = [known(w) or one(w) for w in found.dictionary.to_pylist()]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat = np.frombuffer(b"".join(raw), "<u4")
        which = found.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        shift = (np.cumsum(size) - size)[which] - (ends - n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, n)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.diff(bounds), ids

    def blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of consecutive stretches of ``texts`` of about BLOCK characters."""
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + self.BLOCK, side="right")))
            yield self.encode(texts.slice(at, stop - at))
            at = stop


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    e = WordEncoder(path)
    e.check("It's 12 o'clock:\tDON'T  stop\nÉté é ΣΣ <|endoftext|>x, 漢字 \U0001f642!")
    return e


def file_schema(length: int, dtype: str) -> pa.Schema:
    """ids and mask, each one fixed-size list per sequence; mask is true for an id and false for padding."""
    kind = pa.uint16() if np.dtype(dtype).itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to one file; every sequence has ``length`` ids, the last one is padded."""

    def __init__(self, sink, length: int, dtype: str = "<u4"):
        self.length, self.dtype, self.schema = length, dtype, file_schema(length, dtype)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.sink, self.parts, self.held, self.tokens = sink, [], 0, 0

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.tokens += len(ids)
        block = self.length * _SEQUENCES
        if self.held >= block:
            flat = np.concatenate(self.parts)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._write(flat[at : at + block], block)
            self.parts, self.held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.parts)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to one file: ``file[i]`` is (ids, mask) of sequence i, without copying if ``source`` is mapped."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(source)
        self.last: tuple[int, pa.RecordBatch] | None = None
        self.length = self.reader.schema.field("ids").type.list_size

    @classmethod
    def mapped(cls, path: str) -> SequenceFile:
        return cls(pa.memory_map(path))

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """All ids of record batch ``k`` (a view) and their mask (an Arrow view, one bit each)."""
        if self.last is None or self.last[0] != k:  # documents in order share batches
            self.last = k, self.reader.get_batch(k)
        b = self.last[1]
        return b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten()

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if n == 0 else (n - 1) * _SEQUENCES + self.reader.get_batch(n - 1).num_rows

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        ids, mask = self.batch(i // _SEQUENCES)
        at = i % _SEQUENCES * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids [start, start + n) of the file, a view per record batch."""
        block = _SEQUENCES * self.length
        while n > 0:
            flat, _ = self.batch(start // block)
            part = flat[start % block : start % block + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(
    df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents' ids in ascending id order; returns (part, file, index_file, tokens, start) per file.

    One range exchange of the texts puts documents in order; every task writes one file of sequences and one index file
    (id, first place in the file, number of ids), both Arrow IPC files. ``start`` is the number of ids in the files
    before. Names are unique per attempt and only committed files are listed.

    Cases: null and empty texts have the end id only; equal ids are ordered by their text; null ids come first; an
    empty table writes no file.
    """
    spark = df.sparkSession
    small_batches(spark)
    make_folder(folder)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, index = encoder(tokenizer_path), None, None
        fs, path = locate(folder)
        for b in batches:
            if writer is None:
                name = attempt_name("tokens", ".arrow")
                writer = SequenceWriter(fs.open_output_stream(f"{path}/{name}"), length, enc.dtype)
                schema = pa.schema([("id", b.schema.field(0).type), ("first", pa.int64()), ("n", pa.int64())])
                sink = fs.open_output_stream(f"{path}/{name}.index")
                index = pa.ipc.new_file(sink, schema)
            first, counts = [], []
            for n, ids in enc.blocks(b.column(1)):
                stops = np.cumsum(n)
                closed = np.insert(ids, stops, end_id)
                first += (writer.tokens + stops - n + np.arange(len(n))).tolist()
                counts += (n + 1).tolist()
                writer.append(closed)
            index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.int64()), pa.array(counts, pa.int64())], schema=schema))
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            give_back()
            part = TaskContext.get().partitionId()
            columns = [pa.array([part], pa.int32()), *[pa.array([x]) for x in (name, f"{name}.index")], pa.array([writer.tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "file", "index_file", "tokens"])

    files = cut(ordered.mapInArrow(run, "part int, file string, index_file string, tokens long"), "token-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_documents(files: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files: ``start`` counts all ids before it, the checksum
    is that of its ids as little-endian unsigned 32-bit integers. Files are read by random access, a task per file."""
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, index_name, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = locate(folder)
                with fs.open_input_file(f"{path}/{name}") as tokens, fs.open_input_file(f"{path}/{index_name}") as index:
                    sequences, listed = SequenceFile(tokens), pa.ipc.open_file(index)
                    for k in range(listed.num_record_batches):
                        part = listed.get_batch(k)
                        first, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                        crc = [_checksum(sequences, int(f), int(c)) for f, c in zip(first, n, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), pa.array(first + start), pa.array(n), pa.array(crc, pa.int64())],
                            names=["id", "start", "n_tokens", "ids_crc32"],
                        )

    count = files.count()
    spread = files.select("file", "index_file", "start").repartition(max(1, count))
    return spread.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def _checksum(sequences: SequenceFile, first: int, n: int) -> int:
    value = 0
    for part in sequences.ids(first, n):
        value = zlib.crc32(np.ascontiguousarray(part).astype("<u4", copy=False).data, value)
    return value
