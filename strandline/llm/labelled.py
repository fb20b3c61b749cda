"""Labelled documents for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_or_empty

#: Labels up to so many are broadcast as ids (about 16 MB); more are joined by an exchange.
BROADCAST_LABELS = 1_000_000


def held_out(modulus: int, held: int, doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, modulus) == held


#: One labelled document in so many is for calibration: models that are calibrated on it don't see it.
CALIBRATION = 4


def training(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int | None = None, calibrating: bool | None = None) -> DataFrame:
    """``text`` and ``label`` (0 or 1) of the documents that may be learned from.

    Rows with a null id or label aren't labelled; of repeated labels the largest
    holds.  With ``most``, a sample of so many labelled ids at most, those with
    the least hashes.  ``calibrating`` leaves those for calibration only, or
    the others.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out(modulus, held))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(label).cast("int").alias("label"))
    if calibrating is not None:
        ids = ids.where((F.pmod(F.xxhash64(F.lit("calibrates"), "labelled"), F.lit(CALIBRATION)) == 0) == F.lit(calibrating))
    if most is not None:
        ids = F.broadcast(ids.orderBy(F.xxhash64("labelled"), "labelled").limit(most))
    elif ids.count() <= BROADCAST_LABELS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", text_or_empty().alias("text")).join(ids, F.col("doc_id") == F.col("labelled")).select("text", "label")


class Logistic:
    """Regularised logistic regression on a few standardised features, by Newton steps that each lower the loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros(z.shape[1])
        ridge = np.diag([penalty] * x.shape[1] + [1e-6])

        def loss(w: np.ndarray) -> float:
            m = z @ w
            return float(np.logaddexp(0, m).sum() - m @ y + w @ ridge @ w / 2)

        now = loss(self.w)
        for _ in range(100):
            p = 1 / (1 + np.exp(-(z @ self.w).clip(-30, 30)))
            gradient = z.T @ (p - y) + ridge @ self.w
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, gradient)
            size = 1.0
            # Classes that are nearly apart make a whole step overshoot.
            while (then := loss(self.w - size * step)) > now - 1e-4 * size * float(gradient @ step) and size > 1e-10:
                size /= 2
            if size <= 1e-10:
                break
            self.w, before, now = self.w - size * step, now, then
            if before - now < 1e-9 * (1 + abs(now)):
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


