"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.arrow_batches import give_back, small_batches
from strandlake.llm.labelled import labelled_rows, squash

_GROUPS = (
    bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\n", b"\n", bytes(range(128, 256)),
    b".,;:", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=+_/\\", b"'\"`-",
)
_CAPITALS = bytes(range(65, 91))
_PIECE = 1 << 20


def shouted(words: list[bytes]) -> int:
    """How many words hold two ASCII capitals or more and no small letter; time is linear in their bytes."""
    return sum(1 for w in words if w.isupper() and len(w.translate(None, _CAPITALS)) <= len(w) - 2)


def features(text: str | None) -> np.ndarray:
    """Fixed-length description of the whole text: character mix, repetition and shape of words and lines. Null is read
    as empty; time and memory are linear in the text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    mix = [counts[list(g)].sum() / n for g in _GROUPS]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    marked = counts[list(b"#$%&*@^~|!<>{}=")].sum() / w
    packed = sum(len(zlib.compress(raw[i : i + _PIECE], 1)) for i in range(0, len(raw), _PIECE))
    top = counts[[i for i in range(33, 128) if not chr(i).isalnum()]].max() / n
    return np.array(
        [
            *mix, min(marked, 4.0), top, packed / n, len(set(words)) / w, len(set(lines)) / max(len(lines), 1),
            (n - counts[32]) / w / 10, np.log1p(len(words)) / 10, np.log1p(n / max(len(lines), 1)) / 10,
            shouted(words) / w, counts[46] / w, max(map(len, words), default=0) ** 0.5 / 10,
        ]
    )


@dataclass(frozen=True)
class RankModel:
    """score = weights . (features - centre) / spread; a document is good from ``threshold`` on."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return squash(self.scale * (((x - self.centre) / self.spread) @ self.weights - self.threshold))


def quantile_cut(scores: np.ndarray, quantile: float) -> float:
    """A threshold below which ``quantile`` of the scores are, halfway between the scores on its two sides."""
    s = np.sort(scores)
    k = int(round(quantile * len(s)))
    if k <= 0:
        return float(s[0]) - 1e-9
    if k >= len(s):
        return float(s[-1]) + 1e-9
    return float((s[k - 1] + s[k]) / 2)


def preference_pairs(y: np.ndarray, pairs: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``pairs`` drawn rows of label 1, each with the row of label 0 that it is preferred to."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)


def fit_pairs(
    x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 5, quantile: float | None = None
) -> RankModel:
    """Bradley-Terry scores: P(good beats bad) = sigmoid(score difference), by Newton's method on the logistic loss
    (mean over ``pairs`` drawn preference pairs, plus ridge / 2 * |w|^2) of feature differences. The threshold is the
    ``quantile`` of the fitted rows' scores; by default their share of label 0, so that as many are rejected as labels say."""
    dim = x.shape[1] if x.ndim == 2 and len(x) else len(features(""))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(np.zeros(dim), np.ones(dim), np.zeros(dim), 0.0, 0.0, 1.0)
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / spread
    won, lost = preference_pairs(y, pairs, seed)
    d = z[won] - z[lost]
    w = np.zeros(dim)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(dim)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    q = float((y == 0).mean()) if quantile is None else quantile
    return RankModel(centre, spread, w, quantile_cut(s, q), q, 4.0 / max(float(s.std()), 1e-9))


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, rows: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> RankModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. Their features, not their texts, reach
    the driver.

    Cases: null and empty texts have the features of an empty text; rows that repeat an id or a text count once each;
    null ids have no label. Other columns are ignored. Without labels of both kinds (empty tables too) the model keeps
    everything (every score is 0.7).
    """
    small_batches(docs.sparkSession)
    few = labelled_rows(docs.select(id_col, text_col), labels, label, parts, held, rows, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(0)], names=["x", "y"])

    got = few.select("label", text_col).mapInArrow(run, "x array<double>, y int").collect()
    # collected rows arrive in any order; the fit must not depend on it
    got = sorted((tuple(r["x"]), r["y"]) for r in got)
    return fit_pairs(np.array([g[0] for g in got]), np.array([g[1] for g in got]))


def score_quality(docs: DataFrame, model: RankModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0..1; 0.7 at the fitted threshold) from each row's whole text alone.

    Null and empty texts get the score of an empty text; very long ones take time and memory in proportion; repeated
    rows get equal scores; other columns pass through (one named ``score_col`` is replaced); an empty table gives an
    empty table.
    """
    small_batches(docs.sparkSession)
    source = docs.drop(score_col)
    fields = [f"`{n}` {t}" for n, t in source.dtypes]
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            s = model.score(np.array([features(t) for t in texts])) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score_col])
        give_back()

    return source.mapInArrow(run, ", ".join([*fields, f"`{score_col}` double"]))


