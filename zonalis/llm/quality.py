"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts, cut into segments as they are when they are scored.  A text is compressed with each, segment by segment, so that what a long text
has of its own does not replace the dictionary.  The difference of the two sizes over
the length of the text says which kind it resembles.  Logistic regression turns that difference, and how short the text is, into a
calibrated score.

Fitting uses a bounded sample of labelled rows: twice ``SAMPLE`` documents of each class, read
whole.  Scoring reads every text whole.

Defined results: a null text is scored as an empty one, which has the difference 0 and
the greatest shortness.  Documents whose label rows disagree, or are null, teach nothing.
With fewer than ``LEAST`` texts of either class every score is the good class's share (0.5 without labels).
A column named like the new one is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of

SAMPLE, LEAST = 1500, 4
DICTIONARY, LEVEL, SEGMENT = 112_640, 3, 1024
THRESHOLD = 0.7
#: Added to every length: a few bytes tell little.
SHORT = 128


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of at most ``size`` bytes and a quarter of the texts; the texts themselves where zstandard finds too little to train on."""
    parts = [t[at : at + SEGMENT] for t in texts for at in range(0, len(t), SEGMENT)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, parts)) // 4), parts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)


class Model:
    """Two dictionaries and the coefficients of the calibration."""

    def __init__(self, good: bytes, bad: bytes, coefficients: list[float]):
        self.state = (good, bad, coefficients)
        self.compress = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress for d in (good, bad)] if good and bad else []

    def __reduce__(self):
        return Model, self.state

    def evidence(self, text: bytes) -> tuple[float, float]:
        """Size with the bad dictionary less that with the good one, over the length; and the shortness."""
        size = len(text) + SHORT
        if not self.compress:
            return 0.0, SHORT / size
        good, bad = (sum(len(c(text[at : at + SEGMENT])) for at in range(0, len(text), SEGMENT)) for c in self.compress)
        return (bad - good) / size, SHORT / size

    def score(self, evidence: list[tuple[float, float]]) -> np.ndarray:
        a, b, c = self.state[2]
        x = np.array(evidence, dtype=np.float64).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> list[float]:
    """Intercept and slopes by Newton's method; rows weigh so that the classes have their true shares."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    # A slight pull towards zero keeps separable samples finite.
    pull = np.diag([1e-5, *(1e-4 * np.maximum(x.var(axis=0), 1e-9))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (weight * (y - p)) / len(x) - pull @ w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design / len(x) + pull
        step = np.linalg.solve(curve + 1e-12 * np.eye(3), gradient)
        w = w + step * min(1.0, 200 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents given; the caller leaves out those to be held out."""
    agreed = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most")
    shares = {r["y"]: r["count"] for r in agreed.groupBy("y").count().collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    chance = (F.xxhash64("doc_id", F.lit(8)).bitwiseAND(F.lit((1 << 62) - 1))).alias("chance")
    chosen = [agreed.filter(F.col("y") == y).select("doc_id", "y", chance).orderBy("chance").limit(2 * sample) for y in (0, 1)]
    # At most 4 * sample rows of ids, so this side may be broadcast.
    chosen = chosen[0].union(chosen[1])
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).filter("body <> ''")
    rows = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.first("chance").alias("chance"), F.min("body").alias("body")).collect()
    rows = sorted((r["chance"], r["y"], r["body"].encode()) for r in rows)
    return train([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], prior)


def train(good: list[bytes], bad: list[bytes], prior: float) -> Model:
    """Dictionaries of both classes, and the calibration for a share ``prior`` of good ones."""
    if min(len(good), len(bad)) < LEAST:
        edge = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(b"", b"", [float(np.log(edge / (1 - edge))), 0.0, 0.0])
    # Each half is measured with dictionaries of the other half; the final ones have both.
    found = []
    for half in (0, 1):
        model = Model(dictionary(good[half::2]), dictionary(bad[half::2]), [0.0, 0.0, 0.0])
        found += [(*model.evidence(t), y) for y, own in ((0, bad), (1, good)) for t in own[1 - half :: 2]]
    found = np.array(found, dtype=np.float64)
    return Model(dictionary(good), dictionary(bad), _logistic(found[:, :2], found[:, 2], prior))


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability that the label is 1."""
    # The model holds two dictionaries of at most DICTIONARY bytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array(own.score([own.evidence(t or b"") for t in bytes_of(texts)]), pa.float64())

    return docs.withColumn(into, run(F.col(text)))
