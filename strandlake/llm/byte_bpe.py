"""Byte-level BPE encoding and decoding with DuckDB queries inside each partition.

The driver of the work is Spark: every task takes batches of whole texts, splits them by the vocabulary's pattern and
asks an in-memory, single-threaded DuckDB of its Python worker for the pieces that it has not met yet. Nothing is
written to local disks, and a task that is run again gives the same ids.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from strandlake.llm.arrow_batches import bounded, give_back, small_batches

# A row is a token at byte ``k & 0x7FFFFFFF`` of word ``k >> 31``. Per step: each row's successor in its word, each
# word's best pair (rank, position and the left token's length in one number, so that the least one is the leftmost of
# least rank), and the rows that remain: the pair's left row takes the new token, its right row goes. A word without a
# pair is marked and rests.
_CONTRACT = """
WITH RECURSIVE s(k, tok, step, fin) AS (
  SELECT k, tok, 0, false FROM base
  UNION ALL
  (WITH p AS (
     SELECT k, tok, step, lead(tok) OVER o AS nxt, lead(k) OVER o AS after
     FROM s WHERE NOT fin AND step < $steps WINDOW o AS (ORDER BY k)),
   m AS (
     SELECT p.k >> 31 AS w, min((merges.r::BIGINT << 41) | ((p.k & 2147483647) << 10) | (p.after - p.k)) AS best
     FROM p JOIN merges ON merges.a = p.tok AND merges.b = p.nxt WHERE p.after >> 31 = p.k >> 31 GROUP BY 1),
   b AS (SELECT w, (best >> 41)::INTEGER AS r, (w << 31) | ((best >> 10) & 2147483647) AS lft, best & 1023 AS len FROM m)
   SELECT p.k, CASE WHEN p.k = b.lft THEN b.r ELSE p.tok END, p.step + 1, b.r IS NULL
   FROM p LEFT JOIN b ON b.w = p.k >> 31 WHERE b.r IS NULL OR p.k <> b.lft + b.len)
)
SELECT k, tok, NOT fin AS open FROM s WHERE fin OR step = $steps ORDER BY k
"""

_DECODE = "SELECT string_agg(piece, '' ORDER BY pos) FROM ids JOIN vocab USING (id)"


class PieceMemory:
    """Token ids of pieces met before, by the 128-bit hash of their bytes: some 45 bytes a piece. Emptied when it holds
    ``most`` pieces or ``size`` bytes of ids."""

    def __init__(self, most: int, size: int = 32 << 20):
        self.most, self.size = most, size
        self.clear()

    def clear(self) -> None:
        self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint64)  # halves of the hashes, ascending by the first
        self.start, self.end = np.empty(0, np.int64), np.empty(0, np.int64)  # bytes in ``ids``
        self.ids = b""

    def __len__(self) -> int:
        return len(self.high)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.high, keys[:, 0]), len(self) - 1)
        return np.where((self.high[at] == keys[:, 0]) & (self.low[at] == keys[:, 1]), at, -1)

    def read(self, rows: np.ndarray) -> list[bytes]:
        ids = self.ids
        return [ids[a:b] for a, b in zip(self.start[rows].tolist(), self.end[rows].tolist(), strict=True)]

    def add(self, keys: np.ndarray, values: list[bytes]) -> None:
        if len(self) + len(keys) > self.most or len(self.ids) > self.size:
            self.clear()
        ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values))) + len(self.ids)
        starts = np.concatenate([[len(self.ids)], ends])[:-1]
        self.ids = b"".join([self.ids, *values])
        high = np.concatenate([self.high, keys[:, 0]])
        order = np.argsort(high, kind="stable")
        self.high = high[order]
        self.low = np.concatenate([self.low, keys[:, 1]])[order]
        self.start = np.concatenate([self.start, starts])[order]
        self.end = np.concatenate([self.end, ends])[order]


class BpeTables:
    """The merge table, the vocabulary and a bounded memory of encoded pieces of one Python worker.

    DuckDB is open inside ``with`` only, so its memory goes back at the end of a task; what a worker keeps for the next
    one is the ranks, the merges and a ``PieceMemory`` of at most ``remember`` pieces.

    A piece is contracted in blocks of ``stride + overlap`` bytes, one every ``stride`` bytes (most pieces are one
    block). Neighbouring blocks are joined at a token that both have at the same bytes of their overlap, which gives
    the ids of the undivided piece: if x t and t y are contracted to tokens with t among them at that place, no pair
    across t's ends is ever contracted in x t y either, because each pair there lies in x t or in t y and is the
    leftmost of least rank there too, whenever it is that in x t y. Where an overlap holds no common token, the piece
    is contracted again with blocks of twice the length, at last in one. So the work grows with a piece's length.
    """

    STEP_ROWS = 2_000_000  # rows that the steps of one query may leave behind

    def __init__(self, ranks_path: str, pattern: str, remember: int = 900_000, block_rows: int = 150_000, stride: int = 48):
        self.block_rows, self.stride = block_rows, stride  # token-position rows per recursive query
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        if self.lengths.max() >= 1024:
            raise ValueError("tokens of 1,024 bytes or more don't fit the contraction's numbers")
        self.memory = PieceMemory(remember)
        self.db: duckdb.DuckDBPyConnection | None = None
        self.merges: pa.Table | None = None

    def __enter__(self) -> BpeTables:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.made: set[str] = set()
        return self

    def __exit__(self, *_) -> None:
        self.db.close()
        self.db = None
        give_back()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")
        self.made.add(name)

    def _need_merges(self) -> None:
        if self.merges is None:
            a, b, r = array("i"), array("i"), array("i")
            for token, rank in self.ranks.items():
                for i in range(1, len(token)):
                    left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                    if left is not None and right is not None:
                        a.append(left), b.append(right), r.append(rank)
            self.merges = pa.table({n: np.frombuffer(x, np.int32) for n, x in (("a", a), ("b", b), ("r", r))})
        if "merges" not in self.made:
            self._table("merges", self.merges)

    def _need_vocabulary(self) -> None:
        if "vocab" in self.made:
            return
        # one character below U+0100 stands for each byte, so that string aggregation can join any bytes
        ids, pieces = zip(*((i, t.decode("latin-1")) for t, i in self.ranks.items()), strict=True)
        self._table("vocab", pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(pieces, pa.string())}))

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Token ids (four bytes each) of distinct pieces, from memory where it has them."""
        raws = [p.encode("utf-8", "replace") for p in pieces]
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raws)), np.uint64).reshape(-1, 2)
        rows = self.memory.find(keys)
        out = self.memory.read(rows) if len(self.memory) else [b""] * len(raws)
        new = np.flatnonzero(rows < 0)
        learnt = self.learn([raws[i] for i in new.tolist()])
        for i, ids in zip(new.tolist(), learnt, strict=True):
            out[i] = ids
        self.memory.add(keys[new], learnt)
        return out

    def learn(self, raws: list[bytes]) -> list[bytes]:
        """Token ids of byte strings: that of a token, else what contraction in blocks leaves."""
        whole = list(map(self.ranks.get, raws))
        out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
        reach = self.stride * 3 // 2
        short = [i for i, r in enumerate(whole) if r is None and len(raws[i]) <= reach]
        for i, ids in zip(short, self.contract([raws[i] for i in short]), strict=True):
            out[i] = ids
        open_ = [i for i, r in enumerate(whole) if r is None and len(raws[i]) > reach]
        stride = self.stride
        while open_:
            spans = [self._spans(len(raws[i]), stride) for i in open_]
            blocks = [raws[i][a:b] for i, span in zip(open_, spans, strict=True) for a, b in span]
            distinct = list(dict.fromkeys(blocks))
            of = dict(zip(distinct, self.contract(distinct), strict=True))
            left, at = [], 0
            for i, span in zip(open_, spans, strict=True):
                ids = self._joined([of[x] for x in blocks[at : at + len(span)]], span)
                at += len(span)
                if ids is None:
                    left.append(i)
                else:
                    out[i] = ids
            open_, stride = left, stride * 2
        return out

    @staticmethod
    def _spans(n: int, stride: int) -> list[tuple[int, int]]:
        """Bytes [a, b) of the blocks of a piece of ``n`` bytes: they overlap by half a ``stride``."""
        reach = stride * 3 // 2
        return [(a, min(a + reach, n)) for a in range(0, max(n - reach, 0) + stride, stride) if a == 0 or a + reach - stride < n]

    def _joined(self, encoded: list[bytes], span: list[tuple[int, int]]) -> bytes | None:
        """Ids of a piece from those of its blocks; None where two neighbours have no token in common."""
        if len(encoded) == 1:
            return encoded[0]
        ids = np.frombuffer(b"".join(encoded), "<i4")
        counts = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
        block = np.repeat(np.arange(len(encoded)), counts)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]  # bytes of all blocks before each one
        start = ends - size - before[block] + np.array([a for a, _ in span])[block]
        order = np.lexsort((block, ids, start))
        s, i, b = start[order], ids[order], block[order]
        same = np.flatnonzero((s[1:] == s[:-1]) & (i[1:] == i[:-1]))
        first = np.full(len(encoded) - 1, -1, np.int64)
        first[b[same][::-1]] = s[same][::-1]  # the last write is the first common token
        if (first < 0).any():
            return None
        low, high = np.concatenate([[-1], first]), np.concatenate([first, [span[-1][1]]])
        return ids[(start >= low[block]) & (start < high[block])].tobytes()

    def contract(self, raws: list[bytes]) -> list[bytes]:
        """Token ids (four bytes each) of byte strings, in their order; short ones are contracted together."""
        out: list[bytes] = [b""] * len(raws)
        order = sorted(range(len(raws)), key=lambda x: len(raws[x]))
        at = 0
        while at < len(order):
            rows, end = 0, at
            while end < len(order) and (end == at or rows + len(raws[order[end]]) <= self.block_rows):
                rows += len(raws[order[end]])
                end += 1
            ids, ends = self._contract([raws[x] for x in order[at:end]])
            flat, start = ids.tobytes(), 0
            for x, stop in zip(order[at:end], (4 * ends).tolist(), strict=True):
                out[x] = flat[start:stop]
                start = stop
            at = end
        return out

    def _contract(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all byte strings, and where each one's end: the recursive query runs until no string has a pair left to contract."""
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        starts = np.cumsum(lengths) - lengths
        k = np.arange(lengths.sum()) + np.repeat((np.arange(len(raws)) << 31) - starts, lengths)
        tok = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        done_k, done_tok = [], []
        self._need_merges()
        while len(k):
            self.db.register("base", pa.table({"k": k, "tok": tok}))
            got = self.db.sql(_CONTRACT, params={"steps": max(4, self.STEP_ROWS // len(k))}).to_arrow_table()
            self.db.unregister("base")
            k, tok, more = (got.column(i).to_numpy() for i in range(3))
            more = more.astype(bool)
            done_k.append(k[~more])
            done_tok.append(tok[~more])
            k, tok = k[more], tok[more]
        if not done_k:
            return np.empty(0, "<i4"), np.zeros(len(raws), np.int64)
        at, ids = np.concatenate(done_k), np.concatenate(done_tok).astype("<i4")
        order = np.argsort(at, kind="stable")
        return ids[order], np.cumsum(np.bincount(at >> 31, minlength=len(raws)))

    def _pieces(self, text: str, most: int = 200_000) -> Iterator[list[str]]:
        """The pattern's matches in a whole text, at most ``most`` in a list, so that a huge text is never held as pieces."""
        if len(text) <= most:
            yield self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
            while some := list(islice(found, most)):
                yield some

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of whole texts; new pieces of all of them go to common queries."""
        lists, owner = [], []
        out: list[list[bytes]] = [[] for _ in texts]
        held = 0

        def flush() -> None:
            pieces = list(set().union(*lists))
            known = dict(zip(pieces, self.ids_of(pieces), strict=True))
            for i, x in zip(owner, lists, strict=True):
                out[i].append(b"".join(map(known.__getitem__, x)))
            lists.clear(), owner.clear()

        for i, text in enumerate(texts):
            for some in self._pieces(text or ""):
                lists.append(some), owner.append(i)
                held += len(some)
                if held >= 400_000:
                    flush()
                    held = 0
        flush()
        chunks = [b"".join(x) for x in out]
        sizes = np.fromiter((len(c) // 4 for c in chunks), np.int64, len(chunks))
        return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(chunks), "<i4")

    def decode(self, offsets: np.ndarray, ids: np.ndarray, rows: int = 200_000) -> list[bytes]:
        """Bytes of each id sequence: an ordered aggregation over ``rows`` ids at a time, cut by the tokens' lengths."""
        self._need_vocabulary()
        parts = []
        for at in range(0, len(ids), rows):
            part = ids[at : at + rows]
            self.db.register("ids", pa.table({"pos": np.arange(len(part), dtype=np.int32), "id": part}))
            parts.append((self.db.sql(_DECODE).fetchall()[0][0] or "").encode("latin-1"))
            self.db.unregister("ids")
        flat = b"".join(parts)
        known = (ids >= 0) & (ids < len(self.lengths))
        ends = np.concatenate([[0], np.cumsum(np.where(known, self.lengths[np.where(known, ids, 0)], 0))])[offsets].tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def tables(ranks_path: str, pattern: str) -> BpeTables:
    return BpeTables(ranks_path, pattern)


def _encoded(bpe: BpeTables, texts: pa.Array) -> pa.Array:
    offsets, ids = bpe.encode(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _decoded(bpe: BpeTables, ids: pa.Array) -> pa.Array:
    lengths = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.array(bpe.decode(offsets, np.asarray(ids.flatten())), pa.binary())


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): each whole text's token ids, by the ranks in ``ranks_path`` and the split ``pattern``.

    Each match of the pattern is encoded separately, without special tokens: its bytes are token-position rows that a
    recursive query joins with the merge table, contracting each word's leftmost pair of least rank until none is
    left. A piece that is itself a token is that token. Pieces are encoded once while a worker remembers them.

    Cases: null and empty texts have an empty array; repeated rows and ids are encoded alike, row by row; other
    columns, whatever their names, are ignored; an empty table gives an empty table. Very long texts are split into
    pieces some hundred thousand at a time; very long pieces are contracted in overlapping blocks (``BpeTables``), with
    the same ids. ``ranks_path`` is a file on every machine (part of an installed package), not an input of the job.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables(ranks_path, pattern) as bpe:
            for part in bounded(batches, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _encoded(bpe, part.column(1))], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of each row's ``ids``, in their order.

    Ids join the vocabulary and an aggregation in position order joins their bytes. A null or empty array gives
    empty bytes; an id outside the vocabulary is left out. Other columns pass through (one named ``decoded`` is
    replaced); an empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    source = df.drop("decoded")
    fields = [f"`{n}` {t}" for n, t in source.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables(ranks_path, pattern) as bpe:
            for batch in batches:
                decoded = _decoded(bpe, batch.column("ids"))
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return source.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): ``bpe_encode`` and ``bpe_decode`` of its ids in the same worker, so that an
    executor runs one Python worker a task rather than two. Cases as there."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables(ranks_path, pattern) as bpe:
            for part in bounded(batches, 1):
                ids = _encoded(bpe, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _decoded(bpe, ids)], names=[id_col, "ids", "decoded"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
