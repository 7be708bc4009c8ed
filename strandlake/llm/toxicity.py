"""Toxicity: a gap-weighted subsequence string-kernel support vector machine with Nystrom landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.arrow_batches import bounded, give_back, small_batches
from strandlake.llm.labelled import best_cut, labelled_rows, squash

_SPELT = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
LENGTH = 24  # characters of a unit; longer tokens are read in overlapping windows
SPAN = 7  # a subsequence of three characters spans at most this many
DECAY = 0.6
SYMBOLS = 96
_GAPS = [(a, a + b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def units(text: str | None) -> list[str]:
    """Tokens of the whole lower-cased text, and each spelt-out run of single characters as one more unit."""
    low = (text or "").lower()
    return low.split() + ["".join(m.split()) for m in _SPELT.findall(low)]


class SubsequenceKernel:
    """Similarity of two strings by the character triples they share, gaps allowed.

    Every triple of characters at i < j < k with k - i < SPAN counts DECAY ** (k - i + 1), and the kernel of two strings
    is divided by the root of their kernels with themselves, so K(x, x) = 1. An inserted character or a gap therefore
    only dampens the match. A kernel expansion over any landmarks is one weight per triple, so scoring costs the same
    for one landmark as for hundreds. The SYMBOLS - 2 most frequent characters of the fitted units are told apart, all
    others are one more character.
    """

    def __init__(self, texts: list[str]):
        common = Counter(c for t in texts for c in t)
        letters = sorted(sorted(common, key=lambda c: (-common[c], c))[: SYMBOLS - 2])
        self.code = {c: i + 2 for i, c in enumerate(letters)}  # 0: nothing, 1: any other character

    def codes(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, LENGTH) and lengths of strings of at most LENGTH characters."""
        get = self.code.get
        m = np.zeros((len(strings), LENGTH), np.int32)
        for i, s in enumerate(strings):
            m[i, : len(s)] = [get(c, 1) for c in s]
        return m, np.fromiter(map(len, strings), np.int64, len(strings))

    @staticmethod
    def norms(m: np.ndarray) -> np.ndarray:
        """Lengths of the strings' vectors: the weights of equal triples add up before they are squared."""
        keys, weights = [], []
        for a, e in _GAPS:
            if m.shape[1] > e:
                last = m[:, e:]
                keys.append(np.where(last > 0, (m[:, : m.shape[1] - e] * SYMBOLS + m[:, a : m.shape[1] - e + a]) * SYMBOLS + last, 0))
                weights += [DECAY ** (e + 1)] * last.shape[1]
        if not keys:
            return np.ones(len(m))
        key = np.concatenate(keys, 1)
        order = np.argsort(key, axis=1, kind="stable")
        key = np.take_along_axis(key, order, 1)
        weight = np.where(key > 0, np.array(weights)[order], 0.0)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        sums = np.add.reduceat(weight.ravel(), np.flatnonzero(first.ravel()))
        square = np.add.reduceat(sums**2, np.concatenate([[0], np.cumsum(first.sum(1))[:-1]]))
        return np.sqrt(np.where(square > 0, square, 1.0))

    def sparse(self, m: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, triples and weights of the strings' vectors."""
        rows, keys, values = [], [], []
        norm = self.norms(m)
        for a, e in _GAPS:
            last = m[:, e:]
            r, c = np.nonzero(last)
            keys.append((m[r, c] * SYMBOLS + m[r, c + a]) * SYMBOLS + m[r, c + e])
            rows.append(r)
            values.append(DECAY ** (e + 1) / norm[r])
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(values)

    def dense(self, strings: list[str]) -> np.ndarray:
        m, n = self.codes(strings)
        r, k, v = self.sparse(m, n)
        used, at = np.unique(k, return_inverse=True)
        out = np.zeros((len(strings), len(used)))
        np.add.at(out, (r, at), v)
        self.used = used
        return out

    def linear(self, strings: list[str], table: np.ndarray) -> np.ndarray:
        """Inner product of each string's vector with ``table`` (one weight per triple)."""
        out = np.zeros(len(strings))
        by_length = np.argsort(np.fromiter(map(len, strings), np.int64, len(strings)), kind="stable")
        for at in range(0, len(strings), 5_000):
            some = by_length[at : at + 5_000]
            m, n = self.codes([strings[i] for i in some])
            m = m[:, : max(int(n.max(initial=0)), SPAN)]
            s = np.zeros(len(some))
            for a, e in _GAPS:
                if m.shape[1] > e:
                    left, mid, last = m[:, : m.shape[1] - e], m[:, a : m.shape[1] - e + a], m[:, e:]
                    s += DECAY ** (e + 1) * table[(left * SYMBOLS + mid) * SYMBOLS + last].sum(1)
            out[some] = s / self.norms(m)
        return out


def windows(token: str) -> list[str]:
    """The token, or windows of LENGTH characters at every LENGTH / 2 if it is longer (all of it is covered)."""
    if len(token) <= LENGTH:
        return [token]
    half = LENGTH // 2
    return [token[i : i + LENGTH] for i in range(0, len(token) - half, half)]


def _svm(z: np.ndarray, y: np.ndarray, own: np.ndarray, cost: float = 200.0) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, rows weighted by ``own``, classes equally) by Newton steps on its active rows."""
    n, dim = z.shape
    x = np.hstack([z, np.ones((n, 1))])
    weight = own * np.where(y > 0, 0.5 / max(own[y > 0].sum(), 1e-9), 0.5 / max(own[y < 0].sum(), 1e-9)) * cost * 100
    w = np.zeros(dim + 1)
    reg = np.eye(dim + 1)
    reg[-1, -1] = 1e-6
    for _ in range(30):
        act = y * (x @ w) < 1
        xa, wa = x[act], weight[act]
        new = np.linalg.solve(reg + xa.T @ (xa * wa[:, None]), xa.T @ (wa * y[act]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class ToxicModel:
    kernel: SubsequenceKernel
    table: np.ndarray
    bias: float
    threshold: float
    scale: float

    def decide(self, tokens: list[str]) -> np.ndarray:
        """The SVM's decision on each token: its best window's."""
        parts = [windows(t) for t in tokens]
        if all(len(p) == 1 for p in parts):
            return self.kernel.linear(tokens, self.table) + self.bias
        flat = self.kernel.linear([w for p in parts for w in p], self.table) + self.bias
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        return np.maximum.reduceat(flat, starts)

    def margins(self, best: np.ndarray) -> np.ndarray:
        return squash(self.scale * (best - self.threshold))


_NEVER = -10.0  # decision of a text without any unit


def _ngrams(token: str) -> set[str]:
    s = f"^{token}"
    return {s[i : i + 4] for i in range(len(s) - 3)}


def suspects(pos: list[set[str]], neg: list[set[str]], surprise: float = 5.0, ratio: float = 8.0) -> list[str]:
    """Units of toxic documents that explain their label: a first guess, which leaves rare insults to the machine.

    An n-gram of characters is suspect if the number of toxic documents that hold it exceeds what clean documents
    lead to expect by ``surprise`` standard deviations and ``ratio`` times (toxic and clean documents may differ in
    length and language, which an excess alone would not rule out). The most surprising one is taken, the units that
    hold it are set aside, the others are counted again, and so on: a fragment of an insult that also occurs in
    harmless units is then no longer surprising. All units set aside are returned.
    """
    grams = {t: _ngrams(t) for b in (*pos, *neg) for t in b}
    seen, base = Counter(), Counter()
    for bags, count in ((pos, seen), (neg, base)):
        for bag in bags:
            count.update(set().union(*(grams[t] for t in bag)))
    share = len(pos) / len(neg)

    def excess(g: str, c: int) -> float:
        e = (base[g] + 2.0 * base[g] ** 0.5 + 4.0) * share  # near the upper end of what the clean count allows
        return (c - e) / (e + 1.0) ** 0.5 if c >= ratio * e else 0.0

    open_grams = {g for g, c in seen.items() if excess(g, c) >= surprise}
    held = [{t: grams[t] & open_grams for t in b if not grams[t].isdisjoint(open_grams)} for b in pos]
    count = Counter(g for h in held for g in set().union(*h.values()))
    aside: set[str] = set()
    while count:
        g = max(count, key=lambda x: (excess(x, count[x]), len(x), x))
        if excess(g, count[g]) < surprise:
            break
        for h in held:
            out = [t for t, own in h.items() if g in own]
            if out:
                before = set().union(*h.values())
                for t in out:
                    aside.add(t)
                    del h[t]
                count.subtract(before - set().union(*h.values()))
        count = +count
    return sorted(aside)


def _beginnings(token: str) -> set[str]:
    """What a unit is judged by beside itself: its beginnings and its runs of six characters."""
    s = f"^{token}"
    return {f"{s}$", *(s[:i] for i in range(4, min(len(s), 10) + 1)), *(s[i : i + 6] for i in range(len(s) - 5))}


def _evidence(some: list[set[str]], pos: list[set[str]], neg: list[set[str]], rate: Callable[[float, float], float]) -> dict[str, float]:
    """Of each unit of the documents ``some``, the highest ``rate`` among its parts, each counted over all documents."""
    parts = {t: _beginnings(t) for b in some for t in b}
    every = set().union(*parts.values())
    known: dict[str, set[str]] = {}
    counts = []
    for bags in (pos, neg):
        count: Counter = Counter()
        for bag in bags:
            for t in bag:
                if t not in known:
                    known[t] = _beginnings(t) & every
            count.update(set().union(*(known[t] for t in bag)))
        counts.append(count)
    seen, base = counts
    return {t: max(rate(seen[g], base[g]) for g in own) for t, own in parts.items()}


def _similarities(kernel: SubsequenceKernel, strings: list[str], phi: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Kernel values of strings with the landmarks whose vectors are the rows of ``phi``."""
    k = np.zeros((len(strings), len(phi)))
    columns = np.ascontiguousarray(phi.T)
    for at in range(0, len(strings), 500):
        m, n = kernel.codes(strings[at : at + 500])
        r, key, v = kernel.sparse(m, n)
        j = lookup[key]
        keep = np.flatnonzero(j >= 0)
        keep = keep[np.argsort(r[keep], kind="stable")]
        if len(keep):
            rows, starts = np.unique(r[keep], return_index=True)
            k[at + rows] = np.add.reduceat(columns[j[keep]] * v[keep, None], starts, axis=0)
    return k


def fit_sentences(
    sentences: list[tuple[int, int, list[str]]], landmarks: int = 256, seed: int = 3, positives: int = 6_000, negatives: int = 5_000, harder: int = 2_000
) -> ToxicModel | None:
    """Fit on (document, label, units) of labelled sentences: at most ``positives`` units of toxic documents, those of
    most weight, against ``negatives`` drawn units of clean ones and, three times, the ``harder`` ones among all clean units
    that the machine found hardest.

    A toxic document's label holds for some of its units only, as in multiple-instance learning. ``suspects`` is the
    first guess; a suspect that clean documents hold too is a positive by its excess over them and a negative by the
    rest. Each toxic document that no suspect explains spreads its label over all its units, by their excess at first
    and by the machine's decision after each turn, so an insult needs no least number of documents.
    Landmarks are half toxic, half clean units; the machine is trained on the Nystrom features
    K(x, L) K(L, L)^(-1/2), then again with the clean units that it found hardest, and is folded into one weight per
    triple, which gives the same decisions.
    """
    bags: dict[tuple[int, int], set[str]] = {}
    for doc, label, us in sentences:
        bags.setdefault((doc, label), set()).update(w for u in us for w in windows(u))
    order = sorted(bags)
    pos = [bags[k] for k in order if k[1] == 1]
    neg = [bags[k] for k in order if k[1] == 0]
    if not any(pos) or not any(neg):
        return None
    rng = np.random.default_rng(seed)
    clean = sorted(set().union(*neg))
    support, base = Counter(t for b in pos for t in b), Counter(t for b in neg for t in b)
    share = len(pos) / len(neg)

    def rate(a: float, b: float) -> float:
        """Excess of ``a`` toxic documents over what ``b`` clean ones lead to expect, small counts dampened."""
        e = b * share
        return max(0.002 * (a > e), a - e - 2.5 * (a + e) ** 0.5) / (a + e + 1.0)

    sure = {t: r for t in suspects(pos, neg) if (r := (support[t] - base[t] * share) / (support[t] + base[t] * share)) > 0}
    unexplained = [b for b in pos if b and max((sure.get(t, 0.0) for t in b), default=0.0) < 0.5]
    evidence = _evidence(unexplained, pos, neg, rate)

    def spread(decision: dict[str, float]) -> dict[str, float]:
        """Weight of each positive: a suspect's excess, or what unexplained documents give it, its evidence at most."""
        given: Counter = Counter()
        for b in unexplained:
            part = np.array([evidence[t] ** 3 * np.exp(2.0 * min(decision.get(t, 0.0), 10.0)) for t in b])
            for t, x in zip(b, part / max(part.sum(), 1e-300), strict=True):
                given[t] += x
        return {t: max(sure.get(t, 0.0), min(given[t], evidence.get(t, 0.0) ** 2)) for t in {*sure, *given}}

    weight = spread({})
    if not weight:
        return None
    unexplained = [sorted(b) for b in unexplained]
    best_of = {max(b, key=lambda t: (weight[t], t)) for b in unexplained}  # within the bound below every document has a unit
    toxic = sorted(weight, key=lambda t: (t not in sure, t not in best_of, -weight[t], -support[t], t))[:positives]
    toxic.sort(key=lambda t: (-weight[t], -support[t], t))
    inside = set(toxic)
    unexplained = [[t for t in b if t in inside] for b in unexplained]
    kernel = SubsequenceKernel(clean + toxic)
    half = landmarks // 2
    heavy = np.array([weight[t] for t in toxic])
    heavy = np.flatnonzero(heavy >= heavy[0] / 4)  # landmarks that stand for insults rather than for their neighbours
    marks = toxic[: half // 2] + [toxic[i] for i in rng.permutation(heavy)[: half // 2]]
    pool = [clean[i] for i in rng.permutation(len(clean))]
    marks = sorted({*marks, *pool[:half]})
    phi = kernel.dense(marks)
    used = kernel.used
    value, vector = np.linalg.eigh(phi @ phi.T)
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    lookup = np.full(SYMBOLS**3, -1, np.int64)
    lookup[used] = np.arange(len(used))
    z_toxic = _similarities(kernel, toxic, phi, lookup) @ whiten
    chosen = list(range(min(len(pool), negatives)))
    z_clean = _similarities(kernel, pool[:negatives], phi, lookup) @ whiten
    for turn in range(4):
        y = np.concatenate([np.ones(len(z_toxic)), -np.ones(len(z_clean))])
        own = np.array([weight.get(t, 0.0) for t in toxic] + [1.0 - weight.get(pool[i], 0.0) for i in chosen])
        w, bias = _svm(np.vstack([z_toxic, z_clean]), y, own)
        table = np.zeros(SYMBOLS**3, np.float32)
        table[used] = phi.T @ (whiten @ w)
        if turn < 3:
            weight = spread(dict(zip(toxic, (z_toxic @ w + bias).tolist(), strict=True)))
            taken = set(chosen)
            hardest = np.argsort(-kernel.linear(pool, table), kind="stable")[:harder]
            more = [int(i) for i in hardest if int(i) not in taken]
            chosen += more
            if more:
                z_clean = np.vstack([z_clean, _similarities(kernel, [pool[i] for i in more], phi, lookup) @ whiten])
    model = ToxicModel(kernel, table, bias, 0.0, 1.0)
    best = np.array([float(model.decide(sorted(bags[k])).max()) if bags[k] else _NEVER for k in order])
    return ToxicModel(kernel, table, bias, best_cut(best, np.array([k[1] for k in order])), 4.0)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1, rows: int = 3_000,
    longest: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
) -> ToxicModel | None:
    """Fit on the sentences of at most ``rows`` labelled documents (half of each class) outside the held-out fold and
    of at most ``longest`` bytes each: both bounds limit what the driver holds, and ``fit_sentences`` has bounds of its own.

    Cases: null texts are empty and have no units; rows that repeat an id or a text count once each; null ids have no
    label; other columns are ignored. None without labels of both classes (empty tables too).
    """
    short = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    few = labelled_rows(short, labels, label, parts, held, rows, id_col, by_class=True)
    got = sorted((r["label"], r["text"]) for r in few.select("label", "text").collect())
    sentences = [(i, y, units(s)) for i, (y, text) in enumerate(got) for s in _SENTENCE.split(text)]
    return fit_sentences(sentences)


def score_toxicity(
    docs: DataFrame, model: ToxicModel | None, text_col: str = "text", score_col: str = "score", remember: int = 300_000
) -> DataFrame:
    """``docs`` with ``score_col`` (0..1, 0.7 at the fitted threshold): the decision on the worst unit of the text.

    Whole texts are read, very long ones too, in batches of a few MB; a worker decides each distinct token once while it
    remembers it (``remember`` tokens at most). Null and empty texts score near 0, and so does everything without a
    model. Repeated rows get equal scores, other columns pass through (one named ``score_col`` is replaced), an empty
    table gives an empty table.
    """
    small_batches(docs.sparkSession)
    source = docs.drop(score_col)
    fields = [f"`{n}` {t}" for n, t in source.dtypes]
    at = source.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        fitted = sent.value
        for b in bounded(batches, at):
            texts = b.column(at).to_pylist()
            split = [units(t) for t in texts] if fitted is not None else [[] for _ in texts]
            every = set().union(*split)
            new = every.difference(known)
            if len(known) + len(new) > remember and known:
                known.clear()
                new = every
            tokens = list(new)
            if tokens:
                known.update(zip(tokens, fitted.decide(tokens).tolist(), strict=True))
            best = np.array([max(map(known.__getitem__, x), default=_NEVER) for x in split], float)
            s = squash(best * 4.0) if fitted is None else fitted.margins(best)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score_col])
        del known
        give_back()

    return source.mapInArrow(run, ", ".join([*fields, f"`{score_col}` double"]))
