"""Near-duplicate classes: one-permutation MinHash, densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.arrow_batches import give_back, small_batches
from strandlake.llm.shingles import OnePermutation, WordHashes, mix, shingle_set
from strandlake.operators.graph import connected_components
from strandlake.operators.hot_keys import split_hot
from strandlake.operators.sieve import BitSieve, sieve_bits
from strandlake.storage import cut

_PARITY_WORDS = 16  # a 1,024-bit map


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """1,024 bits, each the parity of the number of set members that hash to it."""
    slot = (mix(shingles) & np.uint64(_PARITY_WORDS * 64 - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=_PARITY_WORDS * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), OnePermutation(bands, rows)
        for batch in batches:
            n, key, bits, sets = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes, width)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                key.append(minhash.band_keys(minhash.signature(s)) if len(s) else np.empty(0, np.int64))
                bits.append(parity_map(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
                 pa.array(key, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["id", "n", "cls", "keys", "bits"],
            )
        del hashes, minhash
        give_back()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cls, sets = [], []
            for c, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingle_set(text, hashes, width)
                if xxhash.xxh3_128_digest(s.tobytes()) == bytes(c):  # else another text under the same id
                    cls.append(c)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "members"]
            )
        del hashes
        give_back()

    return run


def _possible(a: str, b: str, percent: int) -> Column:
    """False only if sets ``a`` and ``b`` can't reach the similarity, by their sizes and parity maps.

    Differing parity bits never outnumber the members that only one of the sets has, so
    intersection <= (sizes - differing bits) / 2; and intersection <= the smaller size.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum(
        (F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(_PARITY_WORDS)),
        start=F.lit(0),
    )
    at_most = (na + nb - apart) / 2
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * at_most >= percent * (na + nb - at_most))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"))
    right = sets.select(F.col("cls").alias("a"), F.col("members").alias("ma"))
    both = pairs.join(left, "b").join(right, "a")
    inter = F.size(F.array_intersect("ma", "mb"))
    measured = both.select("a", "b", inter.alias("i"), (F.size("ma") + F.size("mb")).alias("s"))
    return measured.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _turn(cls: Column, largest: int, base: int = 64) -> Column:
    """In which turn (1, 2, ...) a class becomes a centre of its buckets: up to turn t, ``base`` ** t of ``largest`` do,
    chosen by a hash of the class, and in the last turn all that are left."""
    u = (F.shiftright(F.xxhash64(cls, F.lit(29)), 11).bitwiseAND((1 << 52) - 1) + 1) / float(1 << 52)
    return F.greatest(F.lit(1), F.ceil(F.log(float(base), u * float(largest)) - 1e-9)).cast("int")


def _turn_pairs(open_: DataFrame, turn: int, percent: int, portion: int = 2000) -> DataFrame:
    """Pairs (a < b) of each open bucket's centres of this ``turn`` with its members of other components whose turn is not
    over, as far as sizes and parity maps leave them possible, each in the first bucket that it shares only. Large
    buckets are dealt over several tasks, and their centres, few in early turns, are copied to each."""
    parts = F.ceil(F.col("size") / portion).cast("int")
    x = open_.where(F.col("turn") == turn).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("x")
    y = open_.where(F.col("turn") >= turn).withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).alias("y")
    met = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.turn") > turn) | (F.col("x.cls") < F.col("y.cls"))) & _possible("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before"),
    )
    return met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def near_duplicates(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    width: int = 5,
    percent: int = 85,
    bands: int = 32,
    rows: int = 6,
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles (long), component_id, kept (boolean).

    Two texts are linked if the Jaccard similarity of their full shingle sets is at least ``percent`` / 100; a
    component is what links reach, named by its least id, and the row with that id is kept.

    1. One pass over whole texts gives each set's size, identity, band keys and a parity map. Equal sets form a
       class, so copies, however many, are one row from here on.
    2. Classes that share a bucket are joined to one class only, whose buckets are the largest: a star, linear in the bucket.
       Candidates that size or parity map rule out (exact bounds) are left; the others are confirmed on full sets.
    3. A star can miss a link between two members that are both too far from the centre. So buckets whose members
       still lie in several components get more centres, in turns: some 64, 4096, ... of the largest bucket's
       members, at last all. A turn compares its centres with members of other components only, each pair once, by the
       same bounds and on full sets, and a bucket that has become one component is closed. So buckets of near copies
       cost a few comparisons a member; only members that stay apart to the end are all compared.
    A pair at exactly 0.85 shares no bucket with probability (1 - 0.85^6)^32 = 3e-7.

    Rows of hot classes (more than one in 4096 rows: fewer than 4096 classes) stay in place and meet a broadcast of their
    components.

    Cases: null text counts as empty; an empty set (n_shingles 0) is linked with nothing, and each such row is its
    own component. Very long texts are read whole; a task holds one set at a time, confirmation two. Rows that repeat
    an id are one document if their text repeats too, else they are compared like any others. A null id yields
    component_id of its class members that have ids, else null; it is kept if no row of its component has an id. Extra
    columns, whatever their names, are ignored. An empty table gives an empty table.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(texts.dtypes)["id"]
    sketch = cut(
        texts.mapInArrow(
            _sketches(width, bands, rows), f"id {id_type}, n long, cls binary, keys array<long>, bits array<long>"
        ),
        "near-sketch",
    )
    count = F.count(F.lit(1))
    worded = sketch.where("n > 0")
    classes = cut(worded.groupBy("cls", "n", "keys", "bits").agg(F.min("id").alias("least"), count.alias("copies")), "near-class")

    slots = classes.select("cls", F.posexplode("keys").alias("band", "key"))
    sizes = slots.groupBy("key").agg(count.alias("size")).where("size > 1")
    placed = cut(slots.join(sizes, "key"), "near-placed")
    # what many near copies were made from is in the largest buckets of all bands, so that is the centre of each
    ranked = placed.join(placed.groupBy("cls").agg(F.sum("size").alias("_rank")), "cls")
    first = ranked.groupBy("key").agg(F.max(F.struct("_rank", "cls"))["cls"].alias("centre"))
    held = cut(placed.join(first, "key"), "near-bucket")
    shared = cut(classes.join(held.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "keys", "bits", "least"), "near-shared")

    by_id = BitSieve(shared, ["least"], sieve_bits(shared.count()))
    candidates = by_id.may_hold(texts, [F.col("id")], "may").where("may").select("id", "text")
    found = candidates.join(shared.select("cls", "least"), F.col("id").eqNullSafe(F.col("least"))).select("cls", "text")
    sets = cut(found.mapInArrow(_sets(width), "cls binary, members array<long>"), "near-set")

    star = held.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    light = shared.select("cls", F.struct("n", "bits").alias("s"))
    star = (
        star.join(light.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b")
        .join(light.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a")
        .where(_possible("x", "y", percent)).select("a", "b")
    )
    links = cut(_confirmed(star, sets, percent), "near-link")
    parts = connected_components(links)
    turn, turns, changed = 0, 1, True
    while True:  # until no bucket is open, or all members have been centres
        if changed:
            named = held.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
            spread = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            # a bucket's first centre has met all members, so two members need no further comparison
            members = named.where("size > 2 and cls <> centre").join(spread.where("hi > lo").select("key"), "key", "left_semi")
            before = F.expr("slice(keys, 1, band)").alias("before")
            open_ = cut(members.join(shared, "cls").select("key", "size", "cls", "comp", "n", "bits", before), "near-open")
            largest = open_.agg(F.max("size")).first()[0]
            if largest is None:
                break
            if not turn:
                first_largest = largest
                while 64**turns < largest:
                    turns += 1
        turn += 1
        if turn > turns:
            break
        pairs = _turn_pairs(open_.withColumn("turn", _turn(F.col("cls"), first_largest)), turn, percent)
        more = cut(_confirmed(pairs, sets, percent), "near-more")
        if changed := not more.isEmpty():
            links = links.unionAll(more)
            parts = connected_components(links)

    part = classes.select("cls", "least", "copies").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    part = part.withColumn("component", F.coalesce("component", "cls"))
    names = part.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(part.join(names, "component").select("cls", "component_id", "copies"), "near-named")
    hot, cold = split_hot(named, "copies", worded.count())
    marked = worded.select("id", "n", "cls").join(F.broadcast(hot.drop("copies").withColumn("hot", F.lit(True))), "cls", "left")
    here = marked.where("hot").select("id", "n", "component_id")
    there = marked.where("hot is null").select("id", "n", "cls").join(cold, "cls").select("id", "n", "component_id")
    full = here.unionAll(there)
    empty = sketch.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionAll(empty).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
