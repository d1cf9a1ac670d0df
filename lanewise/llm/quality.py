"""Quality rules: exact counts, and a calibrated classifier over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import BINARY, BOOL, DOUBLE, LONG, code_points, hash_sample, keep, struct
from lanewise.llm.features import counted, logistic, platt, scaled, sigmoid, with_share, word_keys

BLANKS = (" ", "\t", "\n", "\v", "\f", "\r")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows

ORDERS = (2, 3)
SLOTS = 4096
#: Labelled documents of each label that the classifier is fitted on, at most; every fourth calibrates it.
SAMPLE = 900
CALIBRATION = 4
#: Least calibrated probability of good quality.
MIN_QUALITY = 0.5


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly where both sides are equal; all stay below the length."""
    _, numbers = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
    return numbers


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of eight words that occurs twice or more in the text.

    Windows are numbered by doubling: pairs of words, pairs of these pairs, and
    so on, so equal numbers mean equal words. Texts whose windows all have
    different hashes, nearly all, need no numbers.
    """
    if len(words) <= WINDOW:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(len(words) - WINDOW + 1, dtype=np.uint64)
    for i in range(WINDOW):
        mixed = (mixed ^ hashes[i : len(mixed) + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    for step in (1, 2, 4):
        numbers = _pairs(numbers[:-step], numbers[step:])
    times = np.bincount(numbers)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    again = np.flatnonzero(times[numbers] > 1)
    marks[again] += 1
    np.subtract.at(marks, again + WINDOW, 1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line in seen:
            count += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    return count


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words)


def features(text: str | None) -> np.ndarray:
    """Scaled counts of hashed words, then of hashed character n-grams."""
    points = code_points(text)
    blank = ((points >= 9) & (points <= 13)) | (points == 32)
    keys, _, _ = word_keys(points, ~blank)
    words = np.bincount((keys >> np.uint64(64 - 12)).astype(np.int64), minlength=SLOTS)
    return np.concatenate([scaled(words), scaled(counted(points, ORDERS, SLOTS))])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    learned: bool

    def probability(self, row: np.ndarray) -> float:
        if not self.learned:
            return 1.0
        return float(sigmoid(self.slope * (row @ self.weights + self.bias) + self.shift))


@F.pandas_udf(BINARY)
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: features(t).astype(np.float16).tobytes())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, most: int) -> DataFrame:
    """At most ``most`` ids of each value of a 0/1 label: (_id, _label, nth).

    Nulls are no label; of contradicting rows the larger value holds. The
    choice reads the label table alone.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return hash_sample(known, "_label", "_id", most)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit and calibrate on at most ``sample`` documents of each quality label.

    Without labels of both kinds, nothing is learned and every text passes.
    """
    ids = labelled_sample(docs, labels, "quality", doc_id, sample)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    found = keep(rows.select("_label", "nth", _packed(F.col("_text")).alias("row")), "quality-sample").toPandas()
    found = found.sort_values(["_label", "nth", "row"], ignore_index=True)
    truth = found["_label"].to_numpy()
    if len(set(truth)) < 2:
        return Model(np.zeros(2 * SLOTS), 0.0, 1.0, 0.0, False)
    matrix = np.stack([np.frombuffer(r, dtype=np.float16) for r in found["row"]]).astype(np.float32)
    held = found["nth"].to_numpy() % CALIBRATION == 0
    if min(truth[held].sum(), (1 - truth[held]).sum()) == 0:
        held[:] = True
    fitted = ~held if not held.all() else held
    weights, bias = logistic(matrix[fitted], truth[fitted, None].astype(np.float32))
    weights, bias = weights[:, 0], float(bias[0])
    slope, shift = platt(matrix[held] @ weights + bias, truth[held])
    share = labels.filter(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    shift = with_share(shift, truth[held].mean(), share)
    return Model(weights, bias, slope, shift, True)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, quality_score, kept.

    Null and empty texts have no words and fail. Whole texts are counted;
    repeated rows are scored each for itself and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kinds = struct(
        n_words=LONG, word_chars=LONG, n_symbols=LONG, n_dup_lines=LONG, n_repeat_words=LONG,
        base_failed=BOOL, quality_score=DOUBLE, kept=BOOL,
    )

    @F.pandas_udf(kinds)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(**shared.value)
        for batch in texts:
            rows = []
            for text in batch:
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
                quality = model.probability(features(text))
                rows.append((*counts, failed, quality, not failed and quality >= MIN_QUALITY))
            yield pd.DataFrame(rows, columns=kinds.names)

    return docs.select(F.col(doc_id), judge(F.col(text)).alias("_found")).select(doc_id, "_found.*")


def rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return score(docs, train(docs, labels, doc_id, text), doc_id, text)
