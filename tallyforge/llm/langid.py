"""Language identification by hierarchical discrimination.

A text is a vector of byte trigram frequencies (A-Z lower-cased, hashed to 2^16 dimensions, unit length). One-versus-rest
linear SVMs first choose the language family; inside it one-versus-one linear SVMs vote, ties go to the larger sum of
margins. The models are fitted on a sample of at most about ``PER_LANGUAGE`` rows of each label, drawn by a hash of
the id, from rows that are not held out; predictions read the text only, the whole of it.

Defined results: null texts and texts without a letter are ``und`` with score 0; a null doc_id is never held out and
never used for fitting; without labelled rows everything is ``und``; repeated rows each give a row; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.linear import Sparse, sigmoid, train_hinge
from tallyforge.llm.textops import append_from_texts
from tallyforge.plans.registry import table

DIM = 1 << 16
#: Expected number of training rows of a language: the bound of the sample.
PER_LANGUAGE = 1500
#: Margins are turned to scores with this slope.
SLOPE = 6.0
#: Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a Unicode letter category (L*); number forms and superscripts are none."""
    return any(c.isalpha() for c in text or "")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed_trigrams(text: str) -> np.ndarray:
    """The hash of the byte trigram at every position of the lower-cased text, with a space at both ends."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def sparse_row(text: str) -> Sparse:
    """Distinct hashed trigrams and their frequencies, scaled to unit length."""
    idx, count = np.unique(hashed_trigrams(text), return_counts=True)
    norm = np.sqrt(float((count.astype(float) ** 2).sum())) or 1.0
    return idx, count / norm


class LanguageModel:
    """The fitted hierarchy; ``weights`` has a column for each family and each pair of languages in a family."""

    def __init__(self, samples: list[tuple[str, str]], cost: float = 4.0) -> None:
        samples = [(t, lang) for t, lang in samples if has_letter(t)]
        rows = [sparse_row(t) for t, _ in samples]
        langs = np.array([lang for _, lang in samples], dtype=object)
        families = np.array([FAMILY_OF.get(x, x) for x in langs], dtype=object)
        self.languages = sorted(set(langs))
        self.families = sorted(set(families))
        self.members = {f: [x for x in self.languages if FAMILY_OF.get(x, x) == f] for f in self.families}
        columns: list[np.ndarray] = []
        for f in self.families if len(self.families) > 1 else []:
            columns.append(train_hinge(rows, np.where(families == f, 1.0, -1.0), DIM, cost))
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        for a, b in self.pairs:
            keep = np.flatnonzero((langs == a) | (langs == b))
            columns.append(train_hinge([rows[i] for i in keep], np.where(langs[keep] == a, 1.0, -1.0), DIM, cost))
        self.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        idx = hashed_trigrams(text)
        count = np.bincount(idx, minlength=DIM) if len(idx) > DIM else None
        if count is None:
            where, n = np.unique(idx, return_counts=True)
        else:
            where, n = np.flatnonzero(count), count[count > 0]
        n = n.astype(np.float32)
        margins = (n @ self.weights[where]) / np.sqrt(float(n @ n)) + self.weights[DIM]
        shift = len(self.families) if len(self.families) > 1 else 0
        first = int(np.argmax(margins[:shift])) if shift else 0
        family, score = self.families[first], sigmoid(SLOPE * float(margins[first])) if shift else 1.0
        members = self.members[family]
        votes = {x: [0, 0.0] for x in members}
        for k, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                m = float(margins[shift + k])
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(members, key=lambda x: (votes[x][0], votes[x][1]))
        if len(members) > 1:
            score *= sigmoid(SLOPE * votes[best][1] / (len(members) - 1))
        return best, score


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most about per_language (text, lang) rows of each label, never held out, drawn by the id's hash."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(part)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003
    rows = labelled.where(draw < part).select("text", "lang", "doc_id").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "", r["lang"]))]


def identify(docs: DataFrame, model: LanguageModel, keep_text: bool = False, prefix: str = "") -> DataFrame:
    """docs (any columns, with text) and lang_pred and score, behind a prefix where docs may have such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str | None]) -> list[list]:
        got = [shared.value.predict(t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got]]

    return append_from_texts(docs, compute, f"{prefix}lang_pred string, {prefix}score double", keep_text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), LanguageModel(training_sample(docs)))
