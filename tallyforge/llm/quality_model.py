"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams (indicators, hashed to 2^18 dimensions): byte 5-grams, and 6-grams of character classes
(which see capitals, symbols and table-like layouts). Indicators are scaled by
the log ratio of the two classes' smoothed counts, and a linear hinge-loss model is fitted by dual coordinate descent,
interpolated with its mean weight. A sigmoid fitted on a fifth of the sample turns margins into scores.

The model is fitted on a sample of at most about ``SAMPLE`` labelled rows, drawn by a hash of the id from rows that are
not held out; scores read the text only, the whole of it.

Defined results: null and empty texts have no n-grams and get the score of the bias; a null doc_id is never held out;
without labels of both classes every score is 0.5; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.langid import held_out
from tallyforge.llm.linear import fit_sigmoid, sigmoid, train_hinge
from tallyforge.llm.textops import append_from_texts
from tallyforge.plans.registry import table

DIM = 1 << 18
#: Expected number of training rows: the bound of the sample.
SAMPLE = 5000
CUT = 0.3
BETA = 0.25
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Character classes by byte: 1 upper, 2 lower, 3 digit, 4 beyond ASCII, 5 white space, others themselves."""
    kind = np.arange(256, dtype=np.uint64) + 8
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[[9, 10, 11, 12, 13, 32]] = 5
    return kind


_CLASS = _classes()


def _hashed(codes: np.ndarray, salt: int) -> np.ndarray:
    return (((codes + np.uint64(salt)) * _MIX) >> np.uint64(64 - 18)).astype(np.int64)


def indicators(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of a text, sorted."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    code = raw.astype(np.uint64)
    parts = []
    for symbols, n, bits, salt in ((code, 5, 8, 11), (_CLASS[raw], 6, 9, 23)):
        if len(symbols) >= n:
            m, gram = len(symbols) - n + 1, np.zeros(len(symbols) - n + 1, np.uint64)
            for k in range(n):
                gram = (gram << np.uint64(bits)) | symbols[k : k + m]
            parts.append(_hashed(gram, salt))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


class QualityModel:
    """Fitted weights (ratio times hinge weight in one vector, so scoring is a sum over indicators)."""

    def __init__(self, samples: list[tuple[str | None, int]], cost: float = 1.0) -> None:
        self.weights, self.bias, self.slope, self.offset = np.zeros(DIM, np.float32), 0.0, 1.0, 0.0
        rows = [indicators(t) for t, _ in samples]
        labels = np.array([q for _, q in samples], dtype=int)
        if len(set(labels.tolist())) < 2:
            return
        signs = np.where(labels == 1, 1.0, -1.0)
        check = np.arange(len(rows)) % 5 == 4
        if len(set(signs[~check])) < 2 or len(set(signs[check])) < 2:
            check[:] = False
        fit = np.flatnonzero(~check)
        count = np.ones((2, DIM))
        for i in fit:
            count[int(signs[i] > 0)][rows[i]] += 1
        ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
        scaled = []
        for i in fit:
            value = ratio[rows[i]]
            norm = np.sqrt(float(value @ value)) or 1.0
            scaled.append((rows[i], value / norm))
        weights = train_hinge(scaled, signs[fit], DIM, cost)
        mean = float(np.abs(weights[:DIM]).mean())
        self.weights = ((1 - BETA) * mean + BETA * weights[:DIM]).astype(np.float32)
        self.ratio = ratio.astype(np.float32)
        self.bias = float(BETA * weights[DIM])
        probe = np.flatnonzero(check) if check.any() else fit
        self.slope, self.offset = fit_sigmoid(np.array([self._margin(rows[i]) for i in probe]), signs[probe])

    def _margin(self, row: np.ndarray) -> float:
        if not len(row):
            return self.bias
        value = self.ratio[row]
        return float(self.weights[row] @ value) / (np.sqrt(float(value @ value)) or 1.0) + self.bias

    def score(self, text: str | None) -> float:
        """The chance of label 1."""
        if not hasattr(self, "ratio"):
            return 0.5
        return sigmoid(self.slope * self._margin(indicators(text)) + self.offset)


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[str | None, int]]:
    """About ``size`` labelled rows at most; the labels are drawn first, so that few texts move. Of conflicting labels the lower one holds."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    n = usable.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003
    drawn = usable.where(draw < min(1.0, size / max(n, 1))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").collect()  # about `size` rows
    return [(r["text"], r["quality"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))]


def score_quality(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = append_from_texts(keyed, lambda texts: [[shared.value.score(t) for t in texts]], "score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, QualityModel(training_sample(docs, table(spark, sf_dir, "labels"))))
