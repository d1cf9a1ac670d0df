"""Collocations by weighted acyclic automata over words.

Each task counts the n-grams of a shard of text and builds, from the sorted
n-grams, a count transducer: an acyclic automaton that accepts the n-grams, one
arc a word, and gives each its count as weight. States whose continuations and
weights are equal are one state. Words come first, then pairs of frequent words,
then triples of frequent pairs; tasks know these by a bitmap of fixed size. The transducer is cut by ranges of a keyed hash
of the first two words, so that neither a frequent word nor a frequent language
fills one range. Transducers of one range are united step by step, weights
summed, and paths below the least count dropped. Parts of the phrases that stay
are looked up by composing the automaton of the parts that are asked for in a
range with that range's transducer.

Words are 64-bit keys inside automata; spellings are kept with single words, and
one key for two spellings is an error. Transducers travel as Arrow lists, many in
one batch, and all steps are array operations over whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import BINARY, INT, LONG, STRING, keep, ragged, struct
from lanewise.llm.features import span_keys

LEAST = 10
SHARE = 50
TOP = 2000
#: Bytes of text for one range of n-grams, over all languages.
RANGE_TEXT = 32 << 20
#: Words that a task holds before those of its largest language become a shard, and bytes that are cut into words together.
SHARD = 1 << 20
TOGETHER = 1 << 19
#: Texts that are cut into words together at most.
TEXTS = 500
#: N-grams of united transducers that wait to be summed, and rows of transducers that are read together.
UNITED = 1 << 20
ROWS = 8
#: Bits, as a power of two, of the map of frequent words and pairs.
FILTER = 25
#: Rows in which the phrases of a language are ranked before the last ranking.
RANKINGS = 64

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.empty(0, dtype=np.int64)
_LOW = (1 << 32) - 1

# A row of transducers: one automaton of one language and range. ``size2`` and ``size3`` are the arcs of each state
# below the first and second word; ``state1`` and ``state2`` number these states from 1, 0 for none.
_LISTS = {
    "words": T.LongType(), "label1": INT, "weight1": LONG, "state1": INT, "spelled": BINARY,
    "size2": INT, "label2": INT, "weight2": LONG, "state2": INT, "size3": INT, "label3": INT, "weight3": LONG,
}
AUTOMATA = struct(lang=STRING, range=INT, total=LONG, **{k: T.ArrayType(v) for k, v in _LISTS.items()})
_ARROW = {LONG: pa.int64(), INT: pa.int32(), BINARY: pa.binary(), STRING: pa.string()}


def _stirred(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) if x.dtype != np.int64 else x.view(np.uint64)
    x = (x ^ x >> np.uint64(31)) * _STIR
    return x ^ x >> np.uint64(29)


def range_of(first: np.ndarray, second: np.ndarray | int, ranges: int) -> np.ndarray:
    """The range of n-grams that begin with these two words; 0 stands for no second word."""
    second = np.broadcast_to(np.asarray(second, dtype=np.int64), first.shape)
    return (_pair_hash(first, second) >> np.uint64(32)).astype(np.int64) * ranges >> 32


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _stirred((_stirred(first) * _SPREAD + _stirred(np.ascontiguousarray(second))).view(np.int64))


class Frequent:
    """A bitmap of fixed size with a bit for each frequent word or pair: it may take others for frequent, but these never for rare."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(1 << (FILTER - 6), dtype=np.int64)
        self.words[slots] = bits

    @staticmethod
    def place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (_pair_hash(first, second) & np.uint64((1 << FILTER) - 1)).astype(np.int64)

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.place(first, second)
        return (self.words[at >> 6] >> (at & 63) & 1).astype(bool)


@dataclass
class Grams:
    """Different n-grams of one language with their counts: words with spelling, pairs and triples of word keys."""

    words: np.ndarray
    counts: np.ndarray
    spelled: pa.Array
    pairs: np.ndarray
    pair_counts: np.ndarray
    triples: np.ndarray
    triple_counts: np.ndarray

    def __len__(self) -> int:
        return len(self.words) + len(self.pair_counts) + len(self.triple_counts)

    def at_least(self, count: int) -> Grams:
        w, p, t = (c >= count for c in (self.counts, self.pair_counts, self.triple_counts))
        return Grams(
            self.words[w], self.counts[w], self.spelled.filter(pa.array(w)),
            self.pairs[:, p], self.pair_counts[p], self.triples[:, t], self.triple_counts[t],
        )


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different columns of ``keys`` in order, their summed counts, and where each occurs first."""
    order = np.lexsort(keys[::-1])
    keys, counts = keys[:, order], counts[order]
    if not len(order):
        return keys, counts, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return keys[:, first], np.add.reduceat(counts, first), order[first]


def _same_spelling(keys: np.ndarray, spelled: pa.Array, words: np.ndarray, known: pa.Array) -> None:
    at = np.searchsorted(words, keys)
    if len(keys) and not pc.all(pc.equal(spelled, known.take(pa.array(at)))).as_py():
        raise ValueError("Two words have one key.")


def united(parts: list[Grams]) -> Grams:
    """The sum of n-gram counts."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([g.words for g in parts])
    spelled = pa.concat_arrays([g.spelled for g in parts])
    words, counts, first = _summed(keys[None], np.concatenate([g.counts for g in parts]))
    known = spelled.take(pa.array(first))
    _same_spelling(keys, spelled, words[0], known)
    pairs, pair_counts, _ = _summed(np.concatenate([g.pairs for g in parts], axis=1), np.concatenate([g.pair_counts for g in parts]))
    triples, triple_counts, _ = _summed(
        np.concatenate([g.triples for g in parts], axis=1), np.concatenate([g.triple_counts for g in parts])
    )
    return Grams(words[0], counts, known, pairs, pair_counts, triples, triple_counts)


# Counting


@dataclass
class Slice:
    """Words of some text: different keys and spellings, which of them each word is, and its piece."""

    keys: np.ndarray
    spelled: pa.Array
    which: np.ndarray
    piece: np.ndarray


def slices(text: np.ndarray) -> Iterator[Slice]:
    """Cut UTF-8 bytes into words; a slice ends at the end of a piece."""
    kind = _KIND[text]
    ends = np.flatnonzero(kind == _BREAK) + 1
    at = 0
    while at < len(text):
        i = np.searchsorted(ends, at + TOGETHER, side="right")
        end = ends[i - 1] if i and ends[i - 1] > at else ends[i] if i < len(ends) else len(text)
        found = _slice(text[at:end], kind[at:end])
        at = end
        if len(found.which):
            yield found


def _slice(text: np.ndarray, kind: np.ndarray) -> Slice:
    text = text + ((text >= 65) & (text <= 90)) * np.uint8(32)
    edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keys = span_keys(text, start, end).view(np.int64)
    keys[keys == 0] = 1
    different, example, which = np.unique(keys, return_index=True, return_inverse=True)
    size = end - start
    own, of = text[ragged(start, size)], ragged(start[example][which], np.minimum(size, size[example][which]))
    if (size != size[example][which]).any() or (own != text[of]).any():
        raise ValueError("Two words have one key.")
    offsets = np.concatenate([[0], np.cumsum(size[example])]).astype(np.int32)
    spelled = text[ragged(start[example], size[example])]
    known = pa.Array.from_buffers(pa.binary(), len(example), [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
    return Slice(different, known, which.astype(np.int32), np.cumsum(kind == _BREAK)[start])


def counted(parts: list[Slice], order: int, frequent: Frequent | None = None) -> Grams:
    """N-grams of one order of a shard: words, pairs of frequent words, or triples of frequent pairs.

    First words of pairs and first pairs of triples come with count 0. N-grams
    do not reach over the end of a piece.
    """
    keys, spelled = np.concatenate([s.keys for s in parts]), pa.concat_arrays([s.spelled for s in parts])
    words, first, back = np.unique(keys, return_index=True, return_inverse=True)
    known = spelled.take(pa.array(first))
    _same_spelling(keys, spelled, words, known)
    begins = np.cumsum([0] + [len(s.keys) for s in parts])
    ids = np.concatenate([back[b + s.which] for b, s in zip(begins, parts)])
    ahead = np.cumsum([0] + [int(s.piece[-1]) + 1 for s in parts])
    piece = np.concatenate([a + s.piece for a, s in zip(ahead, parts)])
    inside = np.flatnonzero(piece[1:] == piece[:-1])
    none = _no_grams()
    if order == 1:
        counts = np.bincount(ids, minlength=len(words)).astype(np.int64)
        return Grams(words, counts, known, none.pairs, none.pair_counts, none.triples, none.triple_counts)
    if order == 2:
        common = frequent.has(words, np.zeros(len(words), dtype=np.int64))[ids]
        inside = inside[common[inside] & common[inside + 1]]
        pairs, pair_counts = np.unique(ids[inside] << 32 | ids[inside + 1], return_counts=True)
        pair_keys = words[np.stack([pairs >> 32, pairs & _LOW])]
        return Grams(none.words, none.counts, none.spelled, pair_keys, pair_counts, none.triples, none.triple_counts)
    inside = inside[frequent.has(words[ids[inside]], words[ids[inside + 1]])]
    begin = inside[:-1][inside[1:] == inside[:-1] + 1]
    pairs, nth = np.unique(ids[begin] << 32 | ids[begin + 1], return_inverse=True)
    triples, triple_counts = np.unique(nth << 32 | ids[begin + 2], return_counts=True)
    pair_keys = words[np.stack([pairs >> 32, pairs & _LOW])]
    triple_keys = np.concatenate([pair_keys[:, triples >> 32], words[triples & _LOW][None]])
    return Grams(none.words, none.counts, none.spelled, pair_keys, np.zeros(len(pairs), dtype=np.int64), triple_keys, triple_counts)


# Automata


def _one_state_each(group: np.ndarray, size: np.ndarray, *arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States with equal arcs in the same group are one: the states that stay, in order, and the one for each state.

    ``arcs`` are columns of all arcs, those of one state after those of another.
    """
    if not len(size):
        return _NONE, _NONE
    begin = np.cumsum(size) - size
    seen = np.zeros(int(size.sum()), dtype=np.uint64)
    for column in arcs:
        seen = _stirred((seen * _SPREAD + column.view(np.uint64)).view(np.int64))
    seen = np.add.reduceat(seen, begin) + _stirred(size) + _stirred(group) * _SPREAD
    _, example, which = np.unique(seen, return_index=True, return_inverse=True)
    of = example[which]
    same = (size == size[of]).all() and (group == group[of]).all()
    if not same or any((column != column[ragged(begin[of], size)]).any() for column in arcs):
        return np.arange(len(size)), np.arange(len(size))
    order = np.argsort(example)
    rank = np.empty(len(example), dtype=np.int64)
    rank[order] = np.arange(len(example))
    return example[order], rank[which]


def automata(lang: str, grams: Grams, ranges: int, total: int | None = None) -> pa.RecordBatch:
    """The minimal count transducers of n-grams, one row for each range that has any, built from the last word to the first."""
    r1 = range_of(grams.words, 0, ranges)
    r2, r3 = (range_of(g[0], g[1], ranges) for g in (grams.pairs, grams.triples))
    p = np.lexsort((grams.pairs[1], grams.pairs[0], r2))
    t = np.lexsort((grams.triples[2], grams.triples[1], grams.triples[0], r3))
    (first, second), pair_counts, r2 = grams.pairs[:, p], grams.pair_counts[p], r2[p]
    triples, weight3 = grams.triples[:, t], grams.triple_counts[t]
    # states below pairs
    new = np.ones(len(t), dtype=bool)
    new[1:] = (triples[:2, 1:] != triples[:2, :-1]).any(axis=0)
    begin = np.flatnonzero(new)
    size3 = np.diff(begin, append=len(t))
    keep3, state = _one_state_each(r3[t][begin], size3, triples[2], weight3)
    has = np.zeros(len(p), dtype=np.int64)
    has[_places((r2, first, second), (r3[t][begin], *triples[:2, begin]))] = state + 1
    arcs3 = ragged(begin[keep3], size3[keep3])
    group3, size3, word3, weight3 = r3[t][begin][keep3], size3[keep3], triples[2][arcs3], weight3[arcs3]
    # arcs from the start: words that are counted here, and first words of pairs
    w = np.lexsort((grams.words, r1))
    tops = np.concatenate([np.stack([r1[w], grams.words[w]]), np.stack([r2, first])], axis=1)
    (group1, word1), _, _ = _summed(tops, np.ones(tops.shape[1], dtype=np.int64))
    weight1, example = np.zeros(len(word1), dtype=np.int64), np.full(len(word1), -1)
    own = _places((group1, word1), (r1[w], grams.words[w]))
    weight1[own], example[own] = grams.counts[w], w
    # states below first words
    new = np.ones(len(p), dtype=bool)
    new[1:] = (r2[1:] != r2[:-1]) | (first[1:] != first[:-1])
    begin = np.flatnonzero(new)
    size2 = np.diff(begin, append=len(p))
    keep2, state = _one_state_each(r2[begin], size2, second, pair_counts, has)
    state1 = np.zeros(len(word1), dtype=np.int64)
    state1[_places((group1, word1), (r2[begin], first[begin]))] = state + 1
    arcs2 = ragged(begin[keep2], size2[keep2])
    group2, size2 = r2[begin][keep2], size2[keep2]
    word2, weight2, state2 = second[arcs2], pair_counts[arcs2], has[arcs2]
    # one row for each range
    arc2, arc3 = np.repeat(group2, size2), np.repeat(group3, size3)
    letters = np.concatenate([np.stack([g, x]) for g, x in ((group1, word1), (arc2, word2), (arc3, word3))], axis=1)
    (group0, word0), _, _ = _summed(letters, np.ones(letters.shape[1], dtype=np.int64))
    found = np.unique(group0)
    totals = np.bincount(np.searchsorted(found, group1), weight1, len(found)).astype(np.int64) if total is None else np.full(len(found), total)
    ahead = lambda groups, of: np.searchsorted(groups, of)

    def lists(groups: np.ndarray, values, kind: pa.DataType) -> pa.Array:
        offsets = np.append(np.searchsorted(groups, found), len(groups)).astype(np.int32)
        values = values if isinstance(values, pa.Array) else pa.array(values.astype(kind.to_pandas_dtype()))
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    def label(groups: np.ndarray, words: np.ndarray) -> pa.Array:
        return lists(groups, _places((group0, word0), (groups, words)) - ahead(group0, groups), pa.int32())

    def target(groups: np.ndarray, states: np.ndarray, of: np.ndarray) -> pa.Array:
        return lists(groups, np.where(states > 0, states - ahead(of, groups), 0), pa.int32())

    spelled = grams.spelled.take(pa.array(np.maximum(example, 0), mask=example < 0)) if len(w) else pa.nulls(len(word1), pa.binary())
    columns = {
        "lang": pa.array([lang] * len(found), type=pa.string()),
        "range": pa.array(found.astype(np.int32)),
        "total": pa.array(totals),
        "words": lists(group0, word0, pa.int64()),
        "label1": label(group1, word1),
        "weight1": lists(group1, weight1, pa.int64()),
        "state1": target(group1, state1, group2),
        "spelled": lists(group1, spelled, pa.binary()),
        "size2": lists(group2, size2, pa.int32()),
        "label2": label(arc2, word2),
        "weight2": lists(arc2, weight2, pa.int64()),
        "state2": target(arc2, state2, group3),
        "size3": lists(group3, size3, pa.int32()),
        "label3": label(arc3, word3),
        "weight3": lists(arc3, weight3, pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _places(keys: tuple[np.ndarray, ...], wanted: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where each wanted row is among sorted rows that hold it."""
    if not len(wanted[0]):
        return _NONE
    group = np.searchsorted(keys[0], wanted[0])
    if len(keys) == 1:
        return group
    both = [np.concatenate([k, w]) for k, w in zip(keys, wanted)]
    order = np.lexsort(both[::-1])
    known = order < len(keys[0])
    found = np.empty(len(wanted[0]), dtype=np.int64)
    found[order[~known] - len(keys[0])] = (np.cumsum(known) - 1)[~known]
    return found


class Paths:
    """All paths of the automata of a batch, and the row that each is of."""

    def __init__(self, batch: pa.RecordBatch):
        flat, row = {}, {}
        for name in _LISTS:
            column = batch.column(name)
            offsets = np.asarray(column.offsets)
            values = column.flatten()
            flat[name] = values if name == "spelled" else np.asarray(values).astype(np.int64)
            row[name] = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        before = {n: np.searchsorted(row[n], np.arange(batch.num_rows)) for n in ("words", "size2", "size3")}
        word = {n: flat["words"][flat[f"label{n}"] + before["words"][row[f"label{n}"]]] for n in (1, 2, 3)}
        begin2, begin3 = (np.cumsum(flat[f"size{n}"]) - flat[f"size{n}"] for n in (2, 3))
        self.row1, self.words, self.counts, self.spelled = row["label1"], word[1], flat["weight1"], flat["spelled"]
        on = np.flatnonzero(flat["state1"] > 0)
        state = flat["state1"][on] - 1 + before["size2"][row["label1"][on]]
        size = flat["size2"][state]
        arc, self.above2 = ragged(begin2[state], size), np.repeat(on, size)
        self.pairs = np.stack([word[1][self.above2], word[2][arc]])
        self.pair_counts, self.row2 = flat["weight2"][arc], self.row1[self.above2]
        on = np.flatnonzero(flat["state2"][arc] > 0)
        state = flat["state2"][arc[on]] - 1 + before["size3"][self.row2[on]]
        size = flat["size3"][state]
        arc3, self.above3 = ragged(begin3[state], size), np.repeat(on, size)
        self.triples = np.concatenate([self.pairs[:, self.above3], word[3][arc3][None]])
        self.triple_counts, self.row3 = flat["weight3"][arc3], self.row2[self.above3]

    def grams(self) -> Grams:
        own = self.counts > 0
        return Grams(
            self.words[own], self.counts[own], self.spelled.filter(pa.array(own)),
            self.pairs, self.pair_counts, self.triples, self.triple_counts,
        )


def shards(texts: DataFrame, ranges: int, order: int, frequent: Broadcast | None = None) -> DataFrame:
    """Count transducers of all shards of ``texts (lang, text)``, by language and range: see ``counted``."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[Slice]] = {}
        held: dict[str, int] = {}

        def shard(lang: str) -> pa.RecordBatch:
            held.pop(lang)
            return automata(lang, counted(waiting.pop(lang), order, frequent and frequent.value), ranges)

        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                text = batch.column("text").filter(pc.equal(langs.indices, code)).cast(pa.large_binary())
                ended = pc.binary_join_element_wise(text, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                for part in slices(np.frombuffer(ended.buffers()[2] or b"", dtype=np.uint8)):
                    waiting.setdefault(lang, []).append(part)
                    held[lang] = held.get(lang, 0) + len(part.which)
                    if sum(held.values()) >= SHARD:
                        yield shard(max(held, key=held.get))
        while held:
            yield shard(next(iter(held)))

    return texts.mapInArrow(built, AUTOMATA)


def frequent_starts(merged: DataFrame, order: int) -> Broadcast:
    """The bitmap of the words or pairs of united transducers; bits meet in Spark, the driver sees the map, which has a fixed size."""
    place = struct(slot=LONG, bit=LONG)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = Paths(batch).grams()
            at = Frequent.place(*(grams.pairs if order == 2 else (grams.words, np.zeros(len(grams.words), dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=place.names)

    bits = merged.mapInArrow(places, place).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = Frequent(*(np.asarray(bits.column(c).combine_chunks()) for c in ("slot", "bits")))
    return merged.sparkSession.sparkContext.broadcast(found)


def unions(found: DataFrame, ranges: int, least: int) -> DataFrame:
    """One transducer for each language and range: weights and totals summed, n-grams below ``least`` dropped."""

    def union(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total = [_no_grams()], 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            waiting.append(Paths(batch).grams())
            total += pc.sum(batch.column("total")).as_py()
            if sum(map(len, waiting[1:])) > max(UNITED, len(waiting[0])):
                waiting = [united(waiting)]
        rows = automata(key[0].as_py(), united(waiting).at_least(least), ranges, total)
        if rows.num_rows:
            yield rows
        elif total:  # nothing is frequent, but the words count
            yield _bare(key[0].as_py(), key[1].as_py(), total)

    return found.groupBy("lang", "range").applyInArrow(union, AUTOMATA)


def _no_grams() -> Grams:
    return Grams(_NONE, _NONE, pa.array([], type=pa.binary()), np.empty((2, 0), np.int64), _NONE, np.empty((3, 0), np.int64), _NONE)


def _bare(lang: str, at: int, total: int) -> pa.RecordBatch:
    lists = {n: pa.array([[]], type=pa.list_(_ARROW[k])) for n, k in _LISTS.items()}
    row = {"lang": pa.array([lang]), "range": pa.array([at], type=pa.int32()), "total": pa.array([total], type=pa.int64())}
    return pa.RecordBatch.from_pydict(row | lists)


CANDIDATES = struct(lang=STRING, w1=LONG, w2=LONG, w3=LONG, a=LONG, head=LONG)
PARTS = struct(lang=STRING, range=INT, w1=LONG, w2=LONG)
ANSWERS = struct(lang=STRING, w1=LONG, w2=LONG, f=LONG, spelled=STRING)


def candidates(merged: DataFrame) -> DataFrame:
    """Phrases of two and three words: keys (``w3`` null for two), count ``a``, and of three the count of the first two."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = Paths(batch)
            none = np.zeros(len(paths.pair_counts), dtype=np.int64)
            keys = [np.concatenate(x) for x in zip((*paths.pairs, none), tuple(paths.triples))]
            absent = np.arange(len(keys[0])) < len(none)
            rows = pa.array(np.concatenate([paths.row2, paths.row3]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(rows),
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                    pa.array(keys[2], mask=absent),
                    pa.array(np.concatenate([paths.pair_counts, paths.triple_counts])),
                    pa.array(np.concatenate([none, paths.pair_counts[paths.above3]]), mask=absent),
                ],
                names=CANDIDATES.names,
            )

    return merged.mapInArrow(listed, CANDIDATES)


def parts(phrases: DataFrame, ranges: int) -> DataFrame:
    """Parts of phrases that are in other ranges, each once: single words (``w2`` 0), and the last two of three."""
    c = F.col
    asked = phrases.select(
        "lang",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(c("w1"), F.lit(0).cast("long").alias("w2")),
                    F.struct(c("w2").alias("w1"), F.lit(0).cast("long").alias("w2")),
                    F.when(c("w3").isNotNull(), F.struct(c("w3").alias("w1"), F.lit(0).cast("long").alias("w2"))),
                    F.when(c("w3").isNotNull(), F.struct(c("w2").alias("w1"), c("w3").alias("w2"))),
                )
            )
        ).alias("part"),
    )

    @F.arrow_udf(INT)
    def placed(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(range_of(np.asarray(first), np.asarray(second), ranges).astype(np.int32))

    different = asked.select("lang", "part.*").distinct()
    return different.select("lang", placed("w1", "w2").alias("range"), "w1", "w2")


def composed(asked: DataFrame, merged: DataFrame) -> DataFrame:
    """Weights of the parts asked for: the automaton of the parts of a range, composed with its count transducer."""

    def compose(key: tuple, wanted: pa.Table, known: pa.Table) -> pa.Table:
        acceptor = np.stack([np.asarray(wanted.column(c).combine_chunks()) for c in ("w1", "w2")])
        acceptor = acceptor[:, np.lexsort(acceptor[::-1])]
        single = acceptor[1] == 0
        if not known.num_rows:
            raise ValueError("A part is missing that its phrase implies.")
        grams = Paths(known.combine_chunks().to_batches()[0]).grams()
        order = np.argsort(grams.words)
        at = order[np.searchsorted(grams.words[order], acceptor[0][single])]
        pairs = grams.pairs[:, by := np.lexsort(grams.pairs[::-1])]
        at2 = by[_places(tuple(pairs), tuple(acceptor[:, ~single]))]
        if (grams.words[at] != acceptor[0][single]).any() or (grams.pairs[:, at2] != acceptor[:, ~single]).any():
            raise ValueError("A part is missing that its phrase implies.")
        keys = np.concatenate([acceptor[:, single], acceptor[:, ~single]], axis=1)
        spelled = pa.concat_arrays([grams.spelled.take(pa.array(at)).cast(pa.string()), pa.nulls(len(at2), pa.string())])
        counts = pa.array(np.concatenate([grams.counts[at], grams.pair_counts[at2]]))
        lang = pa.array([key[0].as_py()] * keys.shape[1], type=pa.string())
        return pa.table([lang, pa.array(keys[0]), pa.array(keys[1]), counts, spelled], names=ANSWERS.names)

    by = ("lang", "range")
    return asked.groupBy(*by).cogroup(merged.groupBy(*by)).applyInArrow(_where_asked(compose), ANSWERS)


def _where_asked(compose):
    empty = pa.schema([(f.name, _ARROW[f.dataType]) for f in ANSWERS.fields]).empty_table()
    return lambda key, wanted, known: compose(key, wanted, known) if wanted.num_rows else empty


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks
    and tabs. Phrases are of two or three words and occur ``least`` times or
    more (``a``); ``n`` counts the words of the language. The cut into two parts
    with the lowest score gives ``l``, ``r`` and the score, floor(1000000 a a /
    (l r)), ties to the earliest cut. Phrases inside a longer one with at least
    ``share`` percent of their count are dropped. Ties of the score go to the
    more frequent phrase, then by its bytes. A null text is empty, a null
    language ``und``. Repeated rows count as often as they occur. A table without
    words gives no rows. Other columns are not read.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + size // RANGE_TEXT
    merged = keep(unions(shards(texts, ranges, 1), ranges, least), "word-transducers")
    for order in (2, 3):
        longer = shards(texts, ranges, order, frequent_starts(merged, order - 1))
        merged = keep(unions(merged.unionByName(longer), ranges, least), "count-transducers")
    totals = merged.groupBy("lang").agg(F.sum("total").alias("n"))
    phrases = keep(candidates(merged), "phrases")
    longer = phrases.where("w3 IS NOT NULL").select(
        "lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("inner")
    )
    cover = longer.groupBy("lang", "inner.w1", "inner.w2").agg(F.max("a").alias("longer"))
    covered = F.col("w3").isNull() & (100 * F.coalesce("longer", F.lit(0)) >= share * F.col("a"))
    left = keep(phrases.join(cover, ["lang", "w1", "w2"], "left").where(~covered).drop("longer"), "open-phrases")
    answers = keep(composed(parts(left, ranges), merged), "part-counts")

    def answer(name: str, pair: bool = False) -> DataFrame:
        rows = answers.where("w2 <> 0" if pair else "w2 = 0")
        keys = [F.col("w1").alias("w2"), F.col("w2").alias("w3")] if pair else [F.col("w1").alias(name)]
        return rows.select("lang", *keys, F.col("f").alias(f"f_{name}"), F.col("spelled").alias(f"s_{name}"))

    full = left
    for name in ("w1", "w2", "w3"):
        full = keep(full.join(answer(name), ["lang", name], "left"), f"with-{name}")
    full = full.join(answer("tail", pair=True).drop("s_tail"), ["lang", "w2", "w3"], "left")

    def score(l: str, r: str):
        a, l, r = (F.col(c).cast("decimal(16,0)") for c in ("a", l, r))
        return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)

    two, late = F.col("w3").isNull(), score("head", "f_w3") < score("f_w1", "f_tail")
    best = full.select(
        "lang",
        F.concat_ws(" ", "s_w1", "s_w2", "s_w3").alias("phrase"),
        "a",
        F.when(two | ~late, F.col("f_w1")).otherwise(F.col("head")).alias("l"),
        F.when(two, F.col("f_w2")).when(late, F.col("f_w3")).otherwise(F.col("f_tail")).alias("r"),
    ).withColumn("score", score("l", "r"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANKINGS))
    near = Window.partitionBy("lang", "salt").orderBy(*order)
    short = best.withColumn("salt", salt).withColumn("near", F.row_number().over(near)).where(F.col("near") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = short.drop("salt", "near").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
