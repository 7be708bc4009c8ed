"""Filter audit and removal of repeated passages, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", f"s{i % 3}" if sources is None else sources[i], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, words, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(words))


# ---- 11 filter audit


def words_of(text):
    out, word = [], ""
    for ch in text + " ":
        if ch == " " or "\x09" <= ch <= "\x0d":
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def odd_texts():
    rng = random.Random(3)
    long = prose(rng, 260)
    return [long, long, None, "", " \n\t ", "one", "Zürich ½ 漢字 🙂 É", "A" * 50, long.upper(), "x " * 300, long + " #", "a\x1cb c\x0bd", prose(rng, 40_000), "w" * 3_000_000, "", long]


def test_counts_of_texts():
    from strandlake.llm.filter_audit import text_counts

    texts = odd_texts()
    got = text_counts(pa.array(texts).slice(1))
    for i, t in enumerate(texts[1:]):
        w = words_of(t or "")
        want = len(w), len(set(w)), sum("A" <= c <= "Z" for c in t or ""), sum(c in "#$%&*|" for c in t or ""), len(t or "")
        assert tuple(int(got[k][i]) for k in ("words", "distinct", "capitals", "symbols", "points")) == want


def test_equal_hashes_are_told_apart():
    from strandlake.llm.filter_audit import text_counts

    texts = ["ab cd ab ef", "one two two", "long short long"]
    got = text_counts(pa.array(texts), hashes=lambda data, s, e, _: np.zeros(len(s), np.uint64))
    assert got["distinct"].tolist() == [3, 2, 2]


def test_audit_matches_simulation(spark):
    from strandlake.llm.filter_audit import audit, failures

    texts, rng = odd_texts()[:12] + odd_texts()[14:], random.Random(1)
    texts += [prose(rng, rng.choice((20, 250)), "abAB#") for _ in range(30)]
    sources = [rng.choice(("s0", "s1", None, "")) for _ in texts]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, len(texts), 2)] + [(None, 1, 1), (0, 1, 0)]
    quality, toxic = Counter(), Counter()
    for i, q, t in labels:
        quality[i] |= q == 1
        toxic[i] |= t == 1
    fails = {}
    for i, t in enumerate(texts):
        t = t or ""
        w = words_of(t)
        fails[i] = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": any((texts[j] or "") == t for j in range(i)),
        }
    want, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in ("s0", "s1", ""):
            alive = {i for i in fails if (sources[i] or "") == part}
            gone: set = set()
            for step, f in enumerate(order, 1):
                out = {i for i in alive if fails[i][f]}
                redundant = sum(fails[i][f] for i in gone)
                alive, gone = alive - out, gone | out
                unique = sum(fails[i][f] and sum(fails[i].values()) == 1 for i in alive | gone)
                want[part, order, step] = [len(alive), len(out), redundant, unique, sum(quality[i] for i in out), sum(toxic[i] for i in out)]
                shapley[part, f] += len(out)
    got = audit(failures(docs(spark, texts, sources)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 3 * 600
    for r in got:
        assert list(r)[3:9] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_odd_tables(spark):
    from strandlake.llm.filter_audit import audit, failures

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failures(docs(spark, [])), labels).count() == 0
    rows = [(None, "same", "x", 1), (5, "same", None, 2), (5, "same", "", 3), (7, "same", "x", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int").withColumnRenamed("mask", "digest")
    got = sorted((r.id is None, r.id or 0, r.part, r["mask"] & 16) for r in failures(odd).collect())
    assert got == [(False, 5, "", 0), (False, 5, "", 0), (False, 7, "x", 16), (True, 0, "x", 0)]


# ---- 12 repeated passages


@pytest.mark.parametrize("letters,size", [("ab", 40), ("abcd", 300), ("a", 30)])
def test_suffix_ranks(spark, letters, size):
    from strandlake.llm.suffix_array import suffix_ranks

    rng = random.Random(size)
    strings = ["".join(rng.choices(letters, k=rng.randrange(1, size))) for _ in range(12)]
    strings += strings[:2] + [strings[0] + strings[1], "b", "a"]
    rows = [(s, i, ord(c)) for s, t in enumerate(strings) for i, c in enumerate(t)]
    got = {(r.s, r.i): r["rank"] for r in suffix_ranks(spark.createDataFrame(rows, "s long, i int, x long")).collect()}
    order = sorted(((strings[s][i:], s, i) for s, i, _ in rows))
    assert len(got) == len(rows)
    for (a, *x), (b, *y) in itertools.pairwise(order):
        assert got[tuple(x)] == got[tuple(y)] if a == b else got[tuple(x)] < got[tuple(y)], (a, b)


def without_repeats(texts, length):
    at = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        yield len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)


def check(spark, texts, length, window, gram, frame=None):
    from strandlake.llm.suffix_dedup import remove_repeats

    got = remove_repeats(docs(spark, texts) if frame is None else frame, length, window=window, gram=gram, texts=True).orderBy("doc_id").collect()
    want = list(without_repeats([(t or "").encode() for t in texts], length))
    for r, (n, removed, spans, kept) in zip(got, want, strict=True):
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, spans, kept), texts[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    return sum(w[1] for w in want)


@pytest.mark.parametrize("length,window,gram,letters", [(24, 7, 2, "ab"), (30, 16, 4, "abcé"), (16, 12, 4, "abcd"), (12, 1, 8, "ab")])
def test_repeats_match_brute_force(spark, length, window, gram, letters):
    rng = random.Random(length)
    texts = ["".join(rng.choices(letters, k=rng.randrange(5, 200))) for _ in range(25)]
    for _ in range(60):  # passages under, at and over the length, at starts, middles and ends, some with an edit
        a, b = rng.choice(texts), rng.choice(texts)
        at, n = rng.randrange(len(a)), rng.randrange(length - 4, 3 * length)
        passage = a[at : at + n]
        if rng.random() < 0.3 and passage:
            k = rng.randrange(len(passage))
            passage = passage[:k] + rng.choice(letters) + passage[k + 1 :]
        k = rng.randrange(len(b) + 1)
        texts.append(b[:k] + passage + b[k:] if rng.random() < 0.5 else passage + b[:10])
    texts += [None, "", "x", texts[0], "ab" * 60, "a" * 100, "a" * (length + 1), "b" * length]
    assert check(spark, texts, length, window, gram) > 0


def test_repeats_of_production_length(spark):
    rng = random.Random(9)
    passage = prose(rng, 90)
    base = prose(rng, 400)
    texts = [prose(rng, 200) + " " + passage[: 395 + i] + " " + prose(rng, 50) for i in range(12)]
    texts += [base, base, base[:700] + "#" + base[701:], base[:401], "q" * 900, "nothing of it"]
    assert check(spark, texts, 400, 128, 8) > 0


def test_repeats_in_odd_tables(spark):
    from strandlake.llm.suffix_dedup import remove_repeats

    assert remove_repeats(docs(spark, []), 20, window=5, gram=2).count() == 0
    text = prose(random.Random(2), 30)
    frame = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7), (None, None, 8)], "doc_id long, text string, key int")
    got = remove_repeats(frame, 20, window=5, gram=2).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 0, 0)] + [(0, len(text), len(text))] + [(1, len(text), len(text))] * 2


def test_texts_over_several_blocks(monkeypatch):
    import strandlake.llm.suffix_dedup as m

    rng = random.Random(5)
    texts = [prose(rng, 60), "", "short", prose(rng, 7)[:20], prose(rng, 40), "tail"]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [e + p for e, t in zip(ends, texts) for p in range(len(t) - 19)]
    for block in (64, 1 << 20):
        monkeypatch.setattr(m, "_BLOCK", block)
        parse, places = m.Parse(20, 5, 2), []
        for base, data, first, last, anchor in parse.blocks(np.frombuffer("".join(texts).encode(), np.uint8), ends):
            for lo, hi, a in zip(first, last, anchor, strict=True):
                assert all(p <= a < p + 5 for p in range(lo, hi + 1)) and hi + 20 <= len(data)
                places += range(base + lo, base + hi + 1)
        assert places == want


def test_tables_that_grow_are_not_broadcast(spark):
    """only what is bounded (bits of sieves, a row per range of a sort) goes through the driver."""
    import re

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rng = random.Random(11)
    passage = prose(rng, 12)
    texts = [prose(rng, 20) + passage[i % 5 :] + prose(rng, 10) for i in range(30)]
    assert check(spark, texts, 24, 7, 2) > 0
    plans = [x.physicalPlanDescription() for x in (store.executionsList(int(before), 100_000).apply(i) for i in range(store.executionsCount() - before))]
    sides = [re.search(r"Input \[\d+\]: \[(.*?)\]", x)[1] for p in plans for x in re.findall(r"\(\d+\) BroadcastExchange\n.*?\n\n", p, re.S)]
    assert len(plans) > 10 and sides
    assert [x for x in sides if "bitmap" not in x and "_carried" not in x] == []
