"""Bounded, reproducible samples of labelled documents for fitting, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a decision at the fitted threshold comes out, so that ``score >= 0.7`` is the decision itself.
CUT = 0.7


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int, id_col: str = "doc_id",
    by_class: bool = False,
) -> DataFrame:
    """``docs`` rows with ``label`` (0/1) outside the held-out fold: the ``rows`` of least id hash, at most.

    ``by_class`` takes up to half of ``rows`` from each class. The chosen ids (``rows`` at most, by parameter) are
    broadcast; null labels and ids are left out, and of contradicting labels of one id the larger counts.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col, parts) != held))
        .groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    )
    by = F.xxhash64(id_col)
    if by_class:
        half = rows // 2
        picked = [known.where(F.col("label") == c).orderBy(by, id_col).limit(half) for c in (0, 1)]
        chosen = picked[0].unionAll(picked[1])
    else:
        chosen = known.orderBy(by, id_col).limit(rows)
    wanted = chosen.collect()  # at most ``rows`` pairs
    few = docs.sparkSession.createDataFrame(
        [(r[0], r[1]) for r in wanted], f"`{id_col}` {dict(docs.dtypes)[id_col]}, label int"
    )
    return docs.join(F.broadcast(few), id_col)


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the least balanced error, halfway between the scores on its two sides."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order].astype(float)
    pos, neg = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    err = np.concatenate([[1.0], 1.0 + np.cumsum(y / pos - (1 - y) / neg)])
    steps = np.concatenate([[True], s[1:] > s[:-1], [True]])
    err[~steps] = np.inf
    low = np.flatnonzero(err <= err.min() + 1e-12)
    k = int(low[len(low) // 2])
    if k == 0:
        return float(s[0]) - 1e-9
    if k == len(s):
        return float(s[-1]) + 1e-9
    return float((s[k - 1] + s[k]) / 2)


def squash(margin: np.ndarray) -> np.ndarray:
    """0..1, increasing, 0.7 at margin 0; the margin is limited so that distinct ones stay distinct."""
    return 1.0 / (1.0 + np.exp(-(20.0 * np.tanh(margin / 20.0)) - np.log(CUT / (1 - CUT))))
