"""SentencePiece tokens with seeded merge-dropout, and back.

The vocabulary of a public SentencePiece BPE model decides which symbols merge
and in which order. Candidate merges wait in an agenda, the best first; each,
named by its document, the place of its stretch in the text and its own place in
the stretch, is skipped if a keyed hash of it falls below the dropout rate. A
stretch is a run of blanks and the word behind it, as no piece spans more. Each
occurrence of a word is drawn for itself; segmentations always spell the same
text, and are the same on every run.

Stretches are merged together: in each round every stretch takes the best
candidate of its agenda, as arrays over the stretches of many texts. Different
stretches are merged without dropout first. Occurrences that drop some of the
candidates met there are merged again without these, those of one stretch and
with the same dropped candidates as one, until no occurrence drops another.
Very long stretches have an agenda of their own, a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import BOOL, INT, LONG, STRING, code_points, grouped, ragged, released, struct
from lanewise.llm.features import span_keys

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 13
#: Slots, as a power of two, of the hash tables of merges.
SLOTS = 18
#: Stretches of so many characters or more are merged with a heap.
LONG_STRETCH = 64
#: Characters of texts that are encoded together; a longer text is a group of its own.
TOGETHER = 1 << 19
#: Texts of an Arrow batch that are Python strings at the same time.
TEXTS = 500

_MASK = (1 << 64) - 1
_NEVER = 1 << 40
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPREAD = 0xBF58476D1CE4E5B9
_BLANK = 32
_NOTHING = np.empty(0, dtype=np.int64)
#: Occurrences that are the same so far and fewer than this are merged each for itself.
SHARED = 4


def _slot(pairs: np.ndarray, factor: int) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(factor) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _tables(pairs: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Hash tables of pairs and ranks; what meets another pair in one table goes to the next."""
    found = []
    while len(pairs):
        factor = _PLACES[len(found) % 3] + 2 * len(found)
        slots, ranked = np.full(1 << SLOTS, -2), np.zeros(1 << SLOTS, dtype=np.int64)
        at, first = np.unique(_slot(pairs, factor), return_index=True)
        slots[at], ranked[at] = pairs[first], ranks[first]
        found.append((slots, ranked, factor))
        later = np.ones(len(pairs), dtype=bool)
        later[first] = False
        pairs, ranks = pairs[later], ranks[later]
    return found


class Vocabulary:
    """Pieces of a model, blanks written as such, and the merges they allow."""

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        normal: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                piece = piece.replace("▁", " ")
                if " " in piece.lstrip(" "):
                    raise ValueError("Pieces that span words are not supported.")
                normal[piece] = i
                self.bytes_of.append(piece.encode())
        by_score = sorted(normal.values(), key=lambda i: (-model.get_score(i), i))
        self.of_rank = np.array(by_score, dtype=np.int64)
        rank = {i: r for r, i in enumerate(by_score)}
        merges: dict[int, int] = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left << 20 | right] = rank[i]
        self.tables = _tables(np.array(list(merges), dtype=np.int64), np.array(list(merges.values()), dtype=np.int64))
        self.merges = merges
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        self.of_byte = np.array(self.byte_ids, dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, ``_NEVER`` if they do not merge."""
        wanted = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        found = np.full(len(wanted), _NEVER)
        for pairs, ranks, factor in self.tables:
            at = _slot(wanted, factor)
            found = np.where(pairs[at] == wanted, ranks[at], found)
        return found

    def in_bytes(self, symbols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with the pieces of the UTF-8 bytes for characters (-1) that have no piece, and how many each became."""
        size = np.where(symbols >= 0, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        if (symbols >= 0).all():
            return symbols, size
        of = np.repeat(np.arange(len(symbols)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        total, point = size[of], points[of].astype(np.int64)
        tail = point >> (6 * (total - 1 - nth)) & 0x3F | 0x80
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total] | point >> (6 * (total - 1))
        byte = np.where(total == 1, point, np.where(nth == 0, lead, tail))
        return np.where(symbols[of] >= 0, symbols[of], self.of_byte[byte & 0xFF]), size


def _kept(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    mixed = (key + start * _PLACES[0] + middle * _PLACES[1] + end * _PLACES[2]) & _MASK
    mixed = (mixed ^ mixed >> 29) * _SPREAD & _MASK
    return mixed >> 32 >= limit


def _kept_all(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    mixed = key.copy()
    for place, factor in zip((start, middle, end), _PLACES):
        mixed += place.astype(np.uint64) * np.uint64(factor)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(_SPREAD)
    return mixed >> np.uint64(32) >= np.uint64(limit)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ keys >> np.uint64(29)) * np.uint64(_SPREAD)
    return (keys ^ keys >> np.uint64(32)) * np.uint64(_PLACES[1])


def merge_one(words: Vocabulary, points: np.ndarray, key: int, limit: int) -> tuple[list[int], list[int]]:
    """Symbols of one stretch and where they start, by an agenda of candidates, best rank first, then leftmost."""
    merges, of_rank, size = words.merges, words.of_rank, len(points)
    symbols, after, before = words.of_point[points].tolist(), list(range(1, size + 1)), list(range(-1, size - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < size and symbols[left] >= 0 and symbols[right] >= 0:
            r = merges.get(symbols[left] << 20 | symbols[right])
            if r is not None and (not limit or _kept(key, left, right, after[right], limit)):
                heapq.heappush(agenda, (r, left, right, after[right]))

    for left in range(size - 1):
        offer(left)
    gone = [False] * size
    while agenda:
        r, left, right, end = heapq.heappop(agenda)
        if gone[left] or gone[right] or after[left] != right or after[right] != end:
            continue
        symbols[left], gone[right], after[left] = int(of_rank[r]), True, end
        if end < size:
            before[end] = left
            offer(left)
        if before[left] >= 0:
            offer(before[left])
    starts = [i for i in range(size) if not gone[i]]
    return [symbols[i] for i in starts], starts


def _named(stretch: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for a candidate of a stretch shorter than ``LONG_STRETCH``."""
    return ((stretch << 7 | start) << 7 | middle) << 7 | end


def merge_together(
    words: Vocabulary,
    points: np.ndarray,
    lengths: np.ndarray,
    keys: np.ndarray | None = None,
    limit: int = 0,
    dropped: np.ndarray = _NOTHING,
    met: list | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of many stretches laid end to end, where each starts in its stretch, and the stretch it is of.

    Skipped are candidates drawn by ``keys``, one for each stretch, or those named
    in ``dropped``, in order. Others are added to ``met``, as arrays of their
    stretch, start, middle and end.
    """
    word = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbol = words.of_point[points].astype(np.int64)

    def ranks(at: np.ndarray) -> np.ndarray:
        """Ranks of the candidates that begin at the symbols ``at``."""
        found = np.full(len(at), _NEVER)
        has = np.flatnonzero(at < len(word) - 1)
        has = has[word[at[has]] == word[at[has] + 1]]
        i = at[has]
        rank = words.rank_of(symbol[i], symbol[i + 1])
        if keys is not None or len(dropped) or met is not None:
            last = (i + 2 >= len(word)) | (word[np.minimum(i + 2, len(word) - 1)] != word[i])
            end = np.where(last, lengths[word[i]], start[np.minimum(i + 2, len(word) - 1)])
            if keys is not None:
                rank[~_kept_all(keys[word[i]], start[i], start[i + 1], end, limit)] = _NEVER
            elif len(dropped):
                name = _named(word[i], start[i], start[i + 1], end)
                rank[dropped[np.minimum(np.searchsorted(dropped, name), len(dropped) - 1)] == name] = _NEVER
            if met is not None:
                can = rank < _NEVER
                met.append((word[i][can], start[i][can], start[i + 1][can], end[can]))
        found[has] = rank
        return found

    rank = ranks(np.arange(len(word)))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        best = np.minimum.reduceat(rank, first)
        count = np.diff(first, append=len(word))
        active = np.repeat(best < _NEVER, count)
        if not active.all():
            done.append((symbol[~active], start[~active], word[~active]))
            symbol, start, word, rank = (x[active] for x in (symbol, start, word, rank))
            count, best = count[best < _NEVER], best[best < _NEVER]
            if not len(word):
                break
        at = np.flatnonzero(rank == np.repeat(best, count))
        at = at[np.diff(word[at], prepend=-1) != 0]
        symbol[at] = words.of_rank[best]
        stays = np.ones(len(word), dtype=bool)
        stays[at + 1] = False
        symbol, start, word, rank = (x[stays] for x in (symbol, start, word, rank))
        at -= np.arange(len(at))
        rank[at] = ranks(at)
        left = at[at > 0] - 1
        left = left[word[left] == word[left + 1]]
        rank[left] = ranks(left)
    if not done:
        return symbol, start, word
    symbol, start, word = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbol[order], start[order], word[order]


def _shared(at: np.ndarray, which: np.ndarray, example: np.ndarray, dropped: np.ndarray, alone: list) -> tuple:
    """The occurrences that share their stretch with enough others; the rest is added to ``alone``."""
    many = np.bincount(which, minlength=len(example)) >= SHARED
    alone.append(at[~many[which]])
    number = np.cumsum(many) - 1
    stretch = dropped >> 21
    named = number[stretch] << 21 | dropped & (1 << 21) - 1
    return at[many[which]], number[which[many[which]]], example[many], named[many[stretch]]


class Tokenizer:
    """Encodes and decodes whole texts."""

    def __init__(self, proto: bytes, dropout: float = DROPOUT, seed: int = SEED):
        self.words = Vocabulary(proto)
        self.limit = round(dropout * (1 << 32))
        self.seed = np.uint64(xxhash.xxh64_intdigest(b"pieces", seed))

    def segment(self, points: np.ndarray, lengths: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of stretches laid end to end, and how many each stretch has."""
        symbol, start, word = merge_together(self.words, points, lengths, **how)
        first = np.cumsum(lengths) - lengths
        pieces, size = self.words.in_bytes(symbol, points[first[word] + start])
        return pieces, np.bincount(word, weights=size, minlength=len(lengths)).astype(np.int64)

    def segment_long(self, points: np.ndarray, key: np.uint64) -> np.ndarray:
        symbols, starts = merge_one(self.words, points, int(key), self.limit)
        return self.words.in_bytes(np.array(symbols, dtype=np.int64), points[starts])[0]

    def encode_all(self, texts: list[str], names: np.ndarray | None = None) -> list[np.ndarray]:
        """Piece ids of texts; like in SentencePiece each gets a blank in front.

        ``names`` are 64-bit numbers that tell apart documents with equal texts.
        """
        names = np.zeros(len(texts), dtype=np.uint64) if names is None else names
        found: list[np.ndarray] = []
        for group in grouped(texts, TOGETHER):
            found += self._encode_group([texts[i] for i in group], names[group])
        return found

    def _encode_group(self, texts: list[str], names: np.ndarray) -> list[np.ndarray]:
        laid = [code_points(" " + t if t else t) for t in texts]
        sizes = np.array([len(p) for p in laid])
        points = np.concatenate(laid)
        if not len(points):
            return [np.empty(0, dtype=np.int32) for _ in texts]
        blank = points == _BLANK
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        begin = np.cumsum(sizes) - sizes
        starts[begin[sizes > 0]] = True
        starts = np.flatnonzero(starts)
        lengths = np.diff(starts, append=len(points))
        text = np.searchsorted(begin[sizes > 0], starts, side="right") - 1
        text = np.flatnonzero(sizes > 0)[text]
        nth = np.arange(len(starts)) - np.searchsorted(starts, begin)[text]
        documents = _mixed(span_keys(points, begin, begin + sizes) ^ self.seed) + names
        keys = _mixed(_mixed(documents)[text] + nth.astype(np.uint64) * np.uint64(_PLACES[0]))
        counts = np.zeros(len(starts), dtype=np.int64)
        offsets = np.zeros(len(starts), dtype=np.int64)
        pool: list[np.ndarray] = []

        def put(at: np.ndarray, pieces: np.ndarray, size: np.ndarray, which: np.ndarray | slice = slice(None)) -> None:
            """The stretches ``at`` get the pieces, of which there are ``size`` for each of ``which``."""
            filled = sum(map(len, pool))
            pool.append(pieces)
            counts[at], offsets[at] = size[which], (filled + np.cumsum(size) - size)[which]

        short = np.flatnonzero(lengths < LONG_STRETCH)
        content = span_keys(points, starts[short], starts[short] + lengths[short])
        _, example, which = np.unique(content, return_index=True, return_inverse=True)
        example, dropped, left, alone = short[example], _NOTHING, short, []
        while len(left):
            if self.limit:
                left, which, example, dropped = _shared(left, which, example, dropped, alone)
                if not len(left):
                    break
            met: list | None = [] if self.limit else None
            inside = ragged(starts[example], lengths[example])
            found, size = self.segment(points[inside], lengths[example], dropped=dropped, met=met)
            put(left, found, size, which)  # later rounds put others in place of those that drop more
            if not met:
                break
            left, which, example, dropped = self._varied(keys, left, which, dropped, met)
        rare = np.concatenate([_NOTHING, *alone])
        # so that arrays stay small where one text is very long
        for at in np.split(rare, np.flatnonzero(np.diff(np.cumsum(lengths[rare]) // TOGETHER)) + 1):
            inside = ragged(starts[at], lengths[at])
            put(at, *self.segment(points[inside], lengths[at], keys=keys[at], limit=self.limit))
        for at in np.flatnonzero(lengths >= LONG_STRETCH):
            own = self.segment_long(points[starts[at] : starts[at] + lengths[at]], keys[at])
            put(np.array([at]), own, np.array([len(own)]))
        ids = np.concatenate(pool)[ragged(offsets, counts)].astype(np.int32)
        per_text = np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_text)[:-1])

    def _varied(
        self, keys: np.ndarray, at: np.ndarray, which: np.ndarray, dropped: np.ndarray, met: list
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences ``at`` that drop candidates met by the stretches ``which`` that stand for them, and new stretches to stand for these.

        Occurrences of one stretch that drop the same candidates share one: the
        next round merges it without them. Candidates that it then meets are
        drawn in turn, until no occurrence drops a further one.
        """
        stretch, *places = (np.concatenate(x) for x in zip(*met))
        order = np.argsort(stretch, kind="stable")
        stretch, *places = (x[order] for x in (stretch, *places))
        different = int(which.max()) + 1
        count = np.bincount(stretch, minlength=different)
        first = np.cumsum(count) - count
        whose, what = [], []
        for a in range(0, len(at), TOGETHER):
            own = which[a : a + TOGETHER]
            met_at, of = ragged(first[own], count[own]), np.repeat(np.arange(len(own)), count[own])
            drops = ~_kept_all(keys[at[a + of]], *(x[met_at] for x in places), self.limit)
            whose.append(a + of[drops])
            what.append(met_at[drops])
        whose, what = np.concatenate(whose), np.concatenate(what)
        # a number for what each occurrence drops: occurrences differ by their stretch, too
        begin = np.flatnonzero(np.diff(whose, prepend=-1))
        size = np.diff(begin, append=len(whose))
        if not len(begin):
            return at[:0], which[:0], at[:0], dropped[:0]
        mixed = _mixed(what.astype(np.uint64) + np.uint64(1))
        sums = np.add.reduceat(mixed, begin) ^ _mixed(which[whose[begin]].astype(np.uint64) * np.uint64(_PLACES[2]))
        _, example, now = np.unique(sums, return_index=True, return_inverse=True)
        same = size == size[example][now]
        theirs = ragged(begin[example][now], np.where(same, size, 0))
        own = ragged(begin, np.where(same, size, 0))
        same[np.repeat(np.arange(len(begin)), np.where(same, size, 0))[what[own] != what[theirs]]] = False
        if not same.all():  # two sets with one number: each occurrence for itself
            example, now = np.arange(len(begin)), np.arange(len(begin))
        picked = ragged(begin[example], size[example])
        new = np.repeat(np.arange(len(example)), size[example])
        more = _named(new, *(x[what[picked]] for x in places))
        before = which[whose[begin[example]]]
        low, high = (np.searchsorted(dropped, before + k << 21) for k in (0, 1))
        again = dropped[ragged(low, high - low)] & (1 << 21) - 1
        again |= np.repeat(np.arange(len(example)), high - low) << 21
        left = at[whose[begin]]
        return left, now, left[example], np.sort(np.concatenate([more, again]))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        spelled = b"".join(map(self.words.bytes_of.__getitem__, ids))
        return spelled.decode("utf-8", "surrogatepass")[1:]


def _shared_model(spark: SparkSession, model: str):
    with open(model, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(tokenizer: Tokenizer, batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Structs (n_pieces, pieces, lossless) for batches of names and texts, handed on ``TEXTS`` at a time: pieces take more room than texts."""
    for names, batch in batches:
        for at in range(0, len(batch), TEXTS):
            part = batch.slice(at, TEXTS).to_pylist()
            numbers = names.slice(at, TEXTS).filter(batch.slice(at, TEXTS).is_valid())
            texts = [t for t in part if t is not None]
            found = iter(tokenizer.encode_all(texts, np.asarray(numbers).view(np.uint64)))
            ids = [None if t is None else next(found) for t in part]
            lossless = [i is None or tokenizer.decode(i.tolist()) == t for i, t in zip(ids, part)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([0 if i is None else len(i) for i in ids], type=pa.int64()),
                    pa.array(ids, type=pa.list_(pa.int32())),
                    pa.array(lossless, type=pa.bool_()),
                ],
                names=["n_pieces", "pieces", "lossless"],
            )
            del part, texts, found, ids, lossless
        released()


def encode(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
    copy: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_pieces, pieces, lossless.

    ``model`` is the path of a SentencePiece BPE model on the driver; executors
    get its bytes, less than a megabyte. ``lossless`` says that the pieces were
    decoded again to exactly the text. An empty text has no pieces; a null text
    has null pieces and counts as lossless. Pieces follow from the seed, the id, the
    text, and the number in the column ``copy``, if one is named; rows that are
    equal in these have equal pieces, however rows are dealt to tasks. Other
    columns are not read.
    """
    shared = _shared_model(docs.sparkSession, model)

    @F.arrow_udf(struct(n_pieces=LONG, pieces=T.ArrayType(INT), lossless=BOOL))
    def pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from encoded(Tokenizer(shared.value, dropout, seed), batches)

    name = F.xxhash64(*(c for c in (doc_id, copy) if c))
    return docs.select(F.col(doc_id), pieces(name, F.col(text)).alias("_found")).select(doc_id, "_found.*")


def decode(tokens: DataFrame, doc_id: str = "doc_id", pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """One row per row of ``tokens``: doc_id and the text that its pieces spell; null for null."""
    shared = _shared_model(tokens.sparkSession, model)

    @F.pandas_udf(STRING)
    def spelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer(shared.value, 0.0)
        for batch in batches:
            yield pd.Series([None if ids is None else tokenizer.decode(ids) for ids in batch], dtype=object)

    return tokens.select(F.col(doc_id), spelled(F.col(pieces)).alias("text"))
