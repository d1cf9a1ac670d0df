"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One logistic classifier over hashed
character n-grams predicts each bit. A text's language is the codeword with the
smallest loss against the predicted margins, each bit weighed by how well it
was learned; a text whose two best codewords are close is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import BINARY, BOOL, DOUBLE, STRING, code_points, crc, hash_sample, keep, struct
from lanewise.llm.features import counted, logistic, scaled, sigmoid

ORDERS = (1, 2, 3)
SLOTS = 4096
#: Documents of each language that classifiers are fitted on, at most.
SAMPLE = 600
#: Up to so many languages get every possible split into two sets as a bit.
EXHAUSTIVE = 6
#: Languages that one model may tell apart; more are an error, as codewords and samples go to the driver.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Least probability of the best language over the second best for a clear call.
MARGIN = 0.2


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # slots x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, from their codewords' weighted losses."""
        if not self.codes.shape[1]:
            return np.ones((len(rows), len(self.languages)))
        margins = rows @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :]) @ self.trust
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return odds / odds.sum(axis=1, keepdims=True)


def codewords(count: int) -> np.ndarray:
    """One row of +1 and -1 per language, all columns different and none constant.

    Few languages get all splits; more get the random code, of a fixed seed and
    about ten bits per doubling, whose closest rows are farthest apart.
    """
    if count <= EXHAUSTIVE:
        numbers = np.arange(1, 1 << max(0, count - 1))
        bits = (numbers[None, :] >> np.arange(count)[:, None]) & 1
        return 2.0 * bits - 1
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(count, ceil(10 * log2(count))))
        code = code[:, np.abs(code.sum(axis=0)) < count]
        distance = (code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(count)
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


def features(text: str | None) -> np.ndarray:
    return counted(code_points((text or "").lower()), ORDERS, SLOTS)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@F.pandas_udf(BINARY)
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: scaled(features(t)).astype(np.float32).tobytes())


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each language, chosen by a hash of the id.

    The choice reads ids and languages only; the chosen ids, at most ``sample``
    times ``MAX_LANGUAGES``, are then joined to the texts.
    """
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"))
    languages = sorted(r[0] for r in labelled.select("_lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages: {lang} does not look like a language column.")
    ids = hash_sample(labelled.distinct(), "_lang", "_id", sample).select("_id").distinct()
    texts = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = texts.join(F.broadcast(ids), texts[doc_id] == ids["_id"], "left_semi")
    found = keep(rows.select(F.col(lang).alias("lang"), _packed(F.col(text)).alias("row")), "language-sample").toPandas()
    codes = codewords(len(languages))
    if not len(found) or not codes.shape[1]:
        return Model(languages, codes[:, :0], np.zeros((SLOTS, 0)), np.zeros(0), np.zeros(0))
    found = found.sort_values(["lang", "row"], ignore_index=True)
    matrix = np.stack([np.frombuffer(r, dtype=np.float32) for r in found["row"]])
    which = found["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    bits = codes[which] > 0
    weights, bias = logistic(matrix, bits.astype(np.float32))
    right = ((matrix @ weights + bias > 0) == bits).mean(axis=0)
    return Model(languages, codes, weights, bias, np.maximum(2 * right - 1, 0.01))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, ambiguous.

    Whole texts are read, nothing else. Null texts, texts without a letter, and
    all texts if no language was learned, are ``und`` with score 0. Equal texts
    get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf(struct(lang_pred=STRING, score=DOUBLE, ambiguous=BOOL))
    def decode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(**shared.value)
        for batch in texts:
            names, scores, close = [], [], []
            for text in batch:
                if not model.languages or not _has_letter(text):
                    names.append(UNKNOWN), scores.append(0.0), close.append(True)
                    continue
                odds = model.decode(scaled(features(text))[None, :])[0]
                best = int(odds.argmax())
                second = np.sort(odds)[-2] if len(odds) > 1 else 0.0
                names.append(model.languages[best])
                scores.append(float(odds[best]))
                close.append(bool(odds[best] - second < MARGIN))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": close})

    return docs.select(F.col(doc_id), decode(F.col(text)).alias("_found")).select(doc_id, "_found.*")


FOLDS, HELD_OUT = 4, 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Languages of all documents, learned from those whose id's CRC-32 is not 2 modulo 4.

    Documents without an id are never learned from and count as held out.
    """
    fold = F.coalesce(crc(doc_id) % FOLDS, F.lit(HELD_OUT))
    model = train(docs.filter(fold != HELD_OUT), doc_id, text, lang)
    found = predict(docs, model, doc_id, text)
    return found.select(doc_id, (fold == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
