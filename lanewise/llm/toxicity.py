"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of lower-case words. A word enters the network as the
embedding of the word and the sum of the embeddings of its character n-grams, a
blank in front included, so words that share a stem are alike. Only words and
n-grams with evidence in the training sample have embeddings. Windows that
overlap by half run through a GRU in both directions, attention pools the
states of a window, and a text scores as its highest window, calibrated to a
probability. The network is trained in numpy on a bounded sample of labelled
texts; a positive text trains on the window that the network itself ranks
highest, as its label does not say where the toxic words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import BINARY, DOUBLE, code_points, crc, grouped, keep, ragged, released, struct
from lanewise.llm.features import platt, sigmoid, span_keys, with_share, word_keys
from lanewise.llm.quality import labelled_sample

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIMS, CHAR_DIMS = 8, 8, 8
#: Words and n-grams with an embedding, at most; length of n-grams in characters.
VOCABULARY = 2048
TABLE_BITS = 21
GRAM = 6
#: Labelled texts of each label in the training sample, and windows of one text in it, at most.
SAMPLE, SAMPLE_WINDOWS = 900, 64
#: Every fourth text of the sample calibrates and does not train.
CALIBRATION = 4
#: Times windows are chosen anew, passes over the chosen ones each time, and windows of one step.
ROUNDS, PASSES, STEP_WINDOWS = 4, 4, 512
#: Least number of training texts a word must occur in.
MIN_TEXTS = 3
#: Code points that are turned into words together, and windows that run through the network together.
TEXT_STEP, BATCH = 1 << 17, 512
#: Texts of an Arrow batch that are Python strings at the same time.
TEXTS = 500

_ALNUM = np.array([chr(c).isalnum() for c in range(0xD800)] + [True] * 0x2800)


@dataclass
class Words:
    """Keys of words, and keys of their character n-grams with the word each is in."""

    keys: np.ndarray
    grams: np.ndarray
    of_word: np.ndarray
    starts: np.ndarray


def words_of(points: np.ndarray) -> Words:
    """The words among lower-case code points, and their n-grams, one character in front included."""
    inside = _ALNUM[np.minimum(points, 0xFFFF)]
    keys, starts, ends = word_keys(points, inside)
    at = ragged(starts - 1, np.maximum(0, ends - starts + 2 - GRAM))
    of_word = np.repeat(np.arange(len(starts)), np.maximum(0, ends - starts + 2 - GRAM))
    if len(starts) and starts[0] == 0:  # nothing is in front of the first word
        points = np.concatenate([np.array([32], dtype=points.dtype), points])
        at = at + 1
    # What stands in front counts as a blank, whatever it is.
    fronted = points.copy()
    first = starts + (len(fronted) - len(inside)) - 1
    fronted[first] = 32
    return Words(keys, span_keys(fronted, at, at + GRAM), of_word, starts)


@dataclass
class Vocabulary:
    """Words that have an embedding: a table without collisions, found by trying multipliers."""

    keys: np.ndarray
    factor: np.uint64 = np.uint64(1)
    table: np.ndarray = field(default_factory=lambda: np.zeros(1 << TABLE_BITS, dtype=np.int16))

    def __post_init__(self) -> None:
        rng = np.random.default_rng(3)
        while True:
            self.factor = np.uint64(int(rng.integers(1, 1 << 63)) * 2 + 1)
            slots = self.slots(self.keys)
            if len(np.unique(slots)) == len(slots):
                break
        self.table[slots] = np.arange(1, len(slots) + 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.factor) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """1 and up for known words, 0 for others."""
        found = self.table[self.slots(keys)].astype(np.int64)
        known = np.concatenate([[np.uint64(0)], self.keys])
        found[known[found] != keys] = 0
        return found


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of texts laid end to end, and the text it belongs to."""
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(lengths) - lengths
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[text] + nth * STRIDE, text


def fresh(words: np.ndarray, grams: np.ndarray) -> dict[str, np.ndarray]:
    """Weights before training: the first dimension of an embedding is the evidence."""
    rng = np.random.default_rng(5)
    shapes = {
        "inputs": (WORD_DIMS + CHAR_DIMS, 6 * HIDDEN), "gate_bias": (6 * HIDDEN,),
        "forth": (HIDDEN, 3 * HIDDEN), "back": (HIDDEN, 3 * HIDDEN),
        "look": (2 * HIDDEN, HIDDEN), "ask": (HIDDEN,), "out": (2 * HIDDEN,), "out_bias": (1,),
    }
    found = {n: rng.normal(0, 0.8 / np.sqrt(s[0]), s) if "bias" not in n else np.zeros(s) for n, s in shapes.items()}
    for name, evidence, width in (("words", words, WORD_DIMS), ("grams", grams, CHAR_DIMS)):
        found[name] = rng.normal(0, 0.1, (len(evidence) + 1, width))
        found[name][1:, 0] = evidence
        found[name][0] = 0
    return {k: v.astype(np.float32) for k, v in found.items()}


def inputs(p: dict, numbers: np.ndarray, grams: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """What words enter the network as; ``grams`` are the known n-grams of words ``of_word``."""
    chars = np.zeros((len(numbers), CHAR_DIMS), dtype=p["grams"].dtype)
    np.add.at(chars, of_word, p["grams"][grams])
    return np.concatenate([p["words"][numbers], chars], axis=1)


def _run(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, weights: np.ndarray, order, tape: list | None):
    """States of one direction, per step. ``gates`` holds every word's inputs to reset, update and new state."""
    h = np.zeros((len(index), HIDDEN), dtype=gates.dtype)
    states = np.empty((WINDOW, len(index), HIDDEN), dtype=gates.dtype)
    two = 2 * HIDDEN
    for t in order:
        x, u = gates[index[:, t]], h @ weights
        ru = sigmoid(x[:, :two] + u[:, :two])
        r, z = ru[:, :HIDDEN], ru[:, HIDDEN:]
        new = np.tanh(x[:, two:] + r * u[:, two:])
        keep_old = 1 - mask[:, t, None] * (1 - z)
        following = keep_old * h + (1 - keep_old) * new
        if tape is not None:
            tape.append((t, h, u, r, z, new))
        h = states[t] = following
    return states


def forward(p: dict, x: np.ndarray, index: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logits of windows. ``x`` holds the inputs of all words, ``index`` the words of each window."""
    gates = x @ p["inputs"] + p["gate_bias"]
    three = 3 * HIDDEN
    tapes = ([], []) if tape is not None else (None, None)
    forth = _run(np.ascontiguousarray(gates[:, :three]), index, mask, p["forth"], range(WINDOW), tapes[0])
    back = _run(np.ascontiguousarray(gates[:, three:]), index, mask, p["back"], range(WINDOW - 1, -1, -1), tapes[1])
    states = np.concatenate([forth, back], axis=2)
    seen = np.tanh(states @ p["look"])
    asked = np.where(mask.T > 0, seen @ p["ask"], -1e9)
    weight = np.exp(asked - asked.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    logits = pooled @ p["out"] + p["out_bias"]
    if tape is not None:
        tape.update(tapes=tapes, states=states, seen=seen, weight=weight, pooled=pooled)
    return logits


def _run_back(dstates: np.ndarray, tape: list, weights: np.ndarray, mask: np.ndarray):
    """Gradients of one direction with respect to its gate inputs, by step and window, and its weights."""
    dgates = np.empty((WINDOW, dstates.shape[1], 3 * HIDDEN), dtype=dstates.dtype)
    dweights = np.zeros_like(weights)
    dh = np.zeros_like(dstates[0])
    for t, h, u, r, z, new in reversed(tape):
        m = mask[:, t, None]
        dh = dh + dstates[t]
        dnew = dh * m * (1 - z) * (1 - new * new)
        dz = dh * m * (h - new) * z * (1 - z)
        dr = dnew * u[:, 2 * HIDDEN :] * r * (1 - r)
        dgates[t] = np.concatenate([dr, dz, dnew], axis=1)
        du = np.concatenate([dr, dz, dnew * r], axis=1)
        dweights += h.T @ du
        dh = dh * (1 - m * (1 - z)) + du @ weights.T
    return dgates, dweights


def gradients(p: dict, numbers, grams, of_word, mask, truth, each) -> dict[str, np.ndarray]:
    """Gradients of the weighted logistic loss of windows.

    ``numbers`` are the words of each window, one after the other, and ``grams``
    the known n-grams of those at ``of_word``.
    """
    x = inputs(p, numbers, grams, of_word)
    index = np.arange(len(numbers)).reshape(mask.shape)
    tape: dict = {}
    logits = forward(p, x, index, mask, tape)
    states, seen, weight, pooled = (tape[k] for k in ("states", "seen", "weight", "pooled"))
    dlogit = ((sigmoid(logits) - truth) * each).astype(x.dtype)
    g = {"out": pooled.T @ dlogit, "out_bias": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * p["out"]
    dweight = (states * dpooled).sum(axis=2)
    dasked = weight * (dweight - (weight * dweight).sum(axis=0))
    dseen = dasked[:, :, None] * p["ask"] * (1 - seen * seen)
    g["ask"] = np.tensordot(dasked, seen, axes=([0, 1], [0, 1]))
    g["look"] = np.tensordot(states, dseen, axes=([0, 1], [0, 1]))
    dstates = weight[:, :, None] * dpooled + dseen @ p["look"].T
    forth, g["forth"] = _run_back(dstates[:, :, :HIDDEN], tape["tapes"][0], p["forth"], mask)
    back, g["back"] = _run_back(dstates[:, :, HIDDEN:], tape["tapes"][1], p["back"], mask)
    dgate = np.concatenate([forth, back], axis=2).transpose(1, 0, 2).reshape(len(x), -1)
    g["gate_bias"], g["inputs"] = dgate.sum(axis=0), x.T @ dgate
    g["words"] = np.zeros_like(p["words"])
    known = np.flatnonzero(numbers)
    np.add.at(g["words"], numbers[known], dgate[known] @ p["inputs"][:WORD_DIMS].T)
    g["grams"] = np.zeros_like(p["grams"])
    np.add.at(g["grams"], grams, dgate[of_word] @ p["inputs"][WORD_DIMS:].T)
    return g


@dataclass
class Model:
    keys: np.ndarray | None = None
    gram_keys: np.ndarray | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.words = None if self.keys is None else Vocabulary(self.keys)
        self.grams = None if self.gram_keys is None else Vocabulary(self.gram_keys)

    def known(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of words, numbers of the n-grams that have one, and the words these are in."""
        grams = self.grams.numbers(found.grams)
        has = np.flatnonzero(grams)
        return self.words.numbers(found.keys), grams[has], found.of_word[has]

    def window_logits(self, known: tuple, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logits of windows that start at word ``first`` in texts that end before word ``end``.

        Inputs are made for the words of one batch of windows at a time; n-grams
        come in the order of their words.
        """
        numbers, grams, of_word = known
        logits = np.empty(len(first), dtype=np.float32)
        for a in range(0, len(first), BATCH):
            index, mask = _placed(first[a : a + BATCH], end[a : a + BATCH])
            low, high = int(index.min()), int(index.max()) + 1
            g, h = np.searchsorted(of_word, [low, high])
            x = inputs(self.weights, numbers[low:high], grams[g:h], of_word[g:h] - low)
            logits[a : a + BATCH] = forward(self.weights, x, index - low, mask)
        return logits

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """Highest window logit of each text, minus infinity for texts without a word."""
        best = np.full(len(texts), -np.inf)
        for group in grouped(texts, TEXT_STEP):
            points = [code_points((texts[i] or "").lower()) for i in group]
            gap = np.array([32], dtype="<u4")
            laid = np.concatenate([part for p in points for part in (p, gap)])
            found = words_of(laid)
            ends = np.cumsum([len(p) + 1 for p in points])
            lengths = np.diff(np.searchsorted(found.starts, ends), prepend=0)
            if not len(found.keys):
                continue
            first, text = windows_of(lengths)
            logits = self.window_logits(self.known(found), first, np.cumsum(lengths)[text])
            np.maximum.at(best, np.array(group)[text], logits)
        return best

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        if self.words is None:
            return np.zeros(len(texts))
        best = self.highest(texts)
        return np.where(np.isfinite(best), sigmoid(self.slope * np.where(np.isfinite(best), best, 0) + self.shift), 0.0)


def _placed(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = first[:, None] + np.arange(WINDOW)
    mask = (index < end[:, None]).astype(np.float32)
    return np.minimum(index, end[:, None] - 1), mask


def _different(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different words and n-grams of each text, with its label."""
    for batch in batches:
        parts = []
        for text, label in zip(batch["_text"], batch["_label"]):
            found = words_of(code_points(text.lower()))
            for kind, keys in (("words", found.keys), ("grams", found.grams)):
                parts.append(pd.DataFrame({"kind": kind, "key": np.unique(keys).view(np.int64), "label": label}))
        if parts:
            yield pd.concat(parts)


def evidence(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Keys of the words and n-grams that tell labels apart most, and by how much.

    Evidence is the signed root of a key's deviance over the texts it occurs in,
    less what the largest of so many would reach by chance. At most
    ``VOCABULARY`` keys of each kind come to the driver.
    """
    share = F.col("up") / F.col("n")
    base = sample.agg(F.avg("_label")).first()[0] or 0.5
    down = F.col("n") - F.col("up")
    deviance = F.when(F.col("up") > 0, F.col("up") * F.log(share / base)).otherwise(0.0) + F.when(
        down > 0, down * F.log((1 - share) / (1 - base))
    ).otherwise(0.0)
    root = F.signum(share - base) * F.sqrt(F.greatest(F.lit(0.0), 2 * deviance))
    counted = (
        sample.mapInPandas(_different, "kind string, key long, label int")
        .groupBy("kind", "key")
        .agg(F.count("*").alias("n"), F.sum("label").alias("up"))
        .filter(F.col("n") >= MIN_TEXTS)
    )
    counted = keep(counted.select("kind", "key", root.alias("root")), "toxic-evidence")
    sizes = {r[0]: r[1] for r in counted.groupBy("kind").count().collect()}
    found = {}
    for kind in ("words", "grams"):
        least = float(np.sqrt(2 * np.log(max(2, sizes.get(kind, 0)))))
        size = F.abs("root")
        rows = counted.filter((F.col("kind") == kind) & (size > least)).orderBy(size.desc(), "key")
        top = rows.limit(VOCABULARY).toPandas()
        value = np.sign(top["root"].to_numpy(float)) * (np.abs(top["root"].to_numpy(float)) - least)
        keys = top["key"].to_numpy(np.int64).view(np.uint64)
        found[kind] = keys, (2 * value / max(1.0, np.abs(value).max(initial=1.0))).astype(np.float32)
    return found


def _sequences(word_keys: np.ndarray, gram_keys: np.ndarray):
    """A column function: training texts as known words and n-grams. Of very long texts, evenly spaced windows."""

    @F.pandas_udf(struct(numbers=BINARY, grams=BINARY, of_word=BINARY))
    def sequences(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(word_keys, gram_keys)
        for batch in texts:
            rows = []
            for text in batch:
                numbers, grams, of_word = model.known(words_of(code_points(text.lower())))
                if len(numbers) > SAMPLE_WINDOWS * WINDOW:
                    firsts = np.linspace(0, len(numbers) - WINDOW, SAMPLE_WINDOWS).astype(np.int64)
                    chosen = (firsts[:, None] + np.arange(WINDOW)).ravel()
                    place = np.full(len(numbers), -1)
                    place[chosen] = np.arange(len(chosen))
                    stays = place[of_word] >= 0
                    numbers, grams, of_word = numbers[chosen], grams[stays], place[of_word[stays]]
                kinds = ((numbers, np.int16), (grams, np.int16), (of_word, np.int32))
                rows.append([x.astype(kind).tobytes() for x, kind in kinds])
            yield pd.DataFrame(rows, columns=["numbers", "grams", "of_word"])

    return sequences


def _shares(rng: np.random.Generator, count: int) -> list[np.ndarray]:
    """All numbers below ``count`` in random order, in shares of about ``STEP_WINDOWS``."""
    return np.array_split(rng.permutation(count), -(-count // STEP_WINDOWS))


def fit(
    model: Model, value: dict[str, np.ndarray], texts: list[tuple], truth: np.ndarray, held: np.ndarray, share: float
) -> Model:
    """Train on texts as (numbers of words, numbers of n-grams, word of each n-gram).

    ``value`` is the evidence of words and n-grams, ``share`` how common label 1
    is outside the sample.
    """
    model.weights = fresh(value["words"], value["grams"])
    lengths = np.array([len(t[0]) for t in texts])
    begin = np.cumsum(lengths) - lengths
    numbers = np.concatenate([t[0] for t in texts])
    grams = np.concatenate([t[1] for t in texts])
    of_word = np.concatenate([t[2] + b for t, b in zip(texts, begin)])
    order = np.argsort(of_word, kind="stable")
    grams, of_word = grams[order], of_word[order]
    known = numbers, grams, of_word
    gram_count = np.bincount(of_word, minlength=len(numbers))
    gram_first = np.cumsum(gram_count) - gram_count
    first, text = windows_of(lengths)
    end = np.cumsum(lengths)[text]
    strength = np.concatenate([[0], np.maximum(value["words"], 0)])[numbers]
    np.add.at(strength, of_word, np.concatenate([[0], np.maximum(value["grams"], 0)])[grams])
    sums = np.concatenate([[0], np.cumsum(strength)])
    rank = sums[np.minimum(first + WINDOW, end)] - sums[first]
    rng = np.random.default_rng(17)
    moments = {n: (np.zeros_like(w), np.zeros_like(w)) for n, w in model.weights.items()}
    step = 0
    for _ in range(ROUNDS):
        best = np.lexsort([rng.random(len(text)), -rank, text])
        place = np.arange(len(best)) - np.searchsorted(text[best], text[best])
        chosen = best[(place == 0) | ((place < 2) & (truth[text[best]] == 0))]
        extra = rng.integers(0, len(text), len(texts))
        chosen = np.concatenate([chosen, extra[truth[text[extra]] == 0]])
        chosen = chosen[~held[text[chosen]]]
        label = truth[text[chosen]].astype(np.float32)
        each = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
        for part in (p for _ in range(PASSES) for p in _shares(rng, len(chosen))):
            step += 1
            index, mask = _placed(first[chosen[part]], end[chosen[part]])
            tokens, scale = index.ravel(), len(chosen) / len(part)
            own = grams[ragged(gram_first[tokens], gram_count[tokens])]
            places = np.repeat(np.arange(len(tokens)), gram_count[tokens])
            g = gradients(model.weights, numbers[tokens], own, places, mask, label[part], each[part] * scale)
            for name, w in model.weights.items():
                m, v = moments[name]
                slope = g[name] + (0 if name in ("words", "grams") else 1e-4) * w
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        rank = model.window_logits(known, first, end)
    high = np.full(len(texts), -np.inf)
    np.maximum.at(high, text, rank)
    use = held & np.isfinite(high)
    if len(set(truth[use])) < 2:
        use = np.isfinite(high)
    model.slope, model.shift = platt(high[use], truth[use])
    model.shift = with_share(model.shift, truth[use].mean(), share)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` texts of each label; without both labels every text scores 0."""
    ids = keep(labelled_sample(docs, labels, "toxic", doc_id, sample), "toxic-ids")
    share = labels.filter(F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    sample_rows = keep(rows.select("_id", "_label", "nth", "_text"), "toxic-sample")
    trains = sample_rows.filter(F.col("nth") % CALIBRATION != 0)
    if trains.select("_label").distinct().count() < 2:
        trains = sample_rows
    if sample_rows.select("_label").distinct().count() < 2:
        return Model()
    found = evidence(trains)
    model = Model(found["words"][0], found["grams"][0])
    sequences = _sequences(model.keys, model.gram_keys)
    texts = sample_rows.select("_id", "_label", "nth", sequences("_text").alias("s")).select("_id", "_label", "nth", "s.*")
    texts = texts.toPandas()
    texts = texts[texts["numbers"].str.len() > 0].sort_values(["_label", "_id", "numbers"], ignore_index=True)
    truth = texts["_label"].to_numpy().astype(np.float64)
    held = texts["nth"].to_numpy() % CALIBRATION == 0
    if len(set(truth)) < 2:
        return Model()
    if len(set(truth[~held])) < 2:
        held[:] = False
    kinds = {"numbers": np.int16, "grams": np.int16, "of_word": np.int32}
    parts = list(zip(*([np.frombuffer(x, dtype=kind) for x in texts[name]] for name, kind in kinds.items())))
    return fit(model, {k: v[1] for k, v in found.items()}, parts, truth, held, share)


def scorer(docs: DataFrame, model: Model):
    """A column function that scores whole texts; texts without a word score 0."""
    shared = docs.sparkSession.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model)})

    @F.arrow_udf(DOUBLE)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**shared.value)
        for batch in texts:
            places = range(0, len(batch), TEXTS)
            scores = [model.probabilities(batch.slice(a, TEXTS).to_pylist()) for a in places]
            yield pa.array(np.concatenate([np.empty(0), *scores]))
            released()

    return score


FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from; those without an id are not."""
    return F.coalesce(crc(doc_id) % FOLDS == HELD_OUT, F.lit(True))


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    return train(docs, labels.filter(~held_out(doc_id)), doc_id, text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are learned from rows whose id's CRC-32 is not 0 modulo 5; label,
    language, source and id are never inputs of a score. Null and empty texts
    score 0. Whole texts are read; equal texts score the same up to rounding.
    """
    score = scorer(docs, learned(docs, labels, doc_id, text))
    rows = docs.select(F.col(doc_id), held_out(doc_id).alias("held_out"), score(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score = scorer(docs, learned(docs, labels, doc_id, text))
    return docs.withColumn("_score", score(F.col(text))).filter(F.col("_score") < THRESHOLD).drop("_score")
