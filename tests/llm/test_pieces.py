import random

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from lanewise.llm import pieces
from lanewise.llm.common import code_points

with open(pieces.MODEL, "rb") as file:
    PROTO = file.read()

ALPHABET = list("abcdeehiknorst  ttheinger.,\n\t") + ["é", "ß", "▁", "漢", "😀", "<0x41>", " the", "    ", "​"]


def texts(n=400):
    rng = random.Random(6)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_without_dropout_the_library_agrees():
    plain = pieces.Tokenizer(PROTO, dropout=0.0)
    model = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    for text in texts() + ["Hello world, this is the interesting thing.", "internationalization" * 9]:
        if "▁" not in text:  # the library turns this character into a blank
            assert plain.encode(text) == model.encode(text), text


def test_round_trip_and_variation():
    one, two = pieces.Tokenizer(PROTO, seed=1), pieces.Tokenizer(PROTO, seed=2)
    same = pieces.Tokenizer(PROTO, seed=1)
    differs = 0
    for text in texts():
        ids = one.encode(text)
        assert one.decode(ids) == text and ids == same.encode(text)
        differs += ids != two.encode(text)
    assert differs > 200
    again = one.encode(" international" * 8)
    assert one.decode(again) == " international" * 8
    assert len(set(map(tuple, np.array_split(np.array(again), 8)))) > 1 or len(again) % 8


def test_rounds_and_agendas_agree():
    t = pieces.Tokenizer(PROTO, dropout=0.0)
    stretches = [code_points(x[: pieces.LONG_STRETCH - 1]) for x in texts()]
    lengths = np.array([len(p) for p in stretches])
    symbol, start, word = pieces.merge_together(t.words, np.concatenate(stretches), lengths)
    for i, p in enumerate(stretches):
        assert (symbol[word == i].tolist(), start[word == i].tolist()) == pieces.merge_one(t.words, p, 0, 0)


def test_texts_do_not_touch_each_other():
    t = pieces.Tokenizer(PROTO)
    some = texts(60) + ["", " ", "end ", "", " start", "x" * 500, "b" * 64 + " é漢" * 40]
    together = [i.tolist() for i in t.encode_all(some)]
    assert together == [t.encode(x) for x in some]
    assert [t.decode(i) for i in together] == some


def test_table(documents):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b"), (None, "x"), (5, "lo" * 200000 + " ng" * 50000)]
    found = pieces.encode(documents(rows))
    by_id = {r.doc_id: r for r in found.collect()}
    assert all(r.lossless for r in by_id.values()) and by_id[1].pieces is None and by_id[2].pieces == []
    back = {r.doc_id: r.text for r in pieces.decode(found).collect()}
    assert back == dict(rows)
    assert pieces.encode(documents([])).collect() == []


def test_every_occurrence_is_drawn_for_itself(documents):
    t = pieces.Tokenizer(PROTO)
    word, n = " international", 4000
    ids = t.encode((word * n)[1:])
    forms, at, plain = set(), 0, 0
    bare = tuple(pieces.Tokenizer(PROTO, dropout=0.0).encode(word[1:]))
    for _ in range(n):
        spelled, first = b"", at
        while len(spelled) < len(word):
            spelled += t.words.bytes_of[ids[at]]
            at += 1
        assert spelled.decode() == word
        forms.add(tuple(ids[first:at]))
        plain += tuple(ids[first:at]) == bare
    assert at == len(ids) and len(forms) > 20 and 0.1 * n < plain < 0.9 * n
    # a word of one merge is varied as often as the rate says
    split = sum(len(t.encode((" a" * 50)[1:] + str(i))) > 50 + len(str(i)) for i in range(40))
    assert split > 30
    text = "the international interesting thing " * 20
    rows = pieces.encode(documents([(1, text), (2, text)])).collect()
    assert len({tuple(r.pieces) for r in rows}) == 2 and all(r.lossless for r in rows)


def test_pieces_do_not_depend_on_how_rows_are_dealt(documents):
    text = "the international interesting thing " * 20
    docs = documents([(i // 3, text + str(i // 6)) for i in range(60)])
    dealt = [pieces.encode(docs.repartition(n).sortWithinPartitions(order)) for n, order in ((1, "doc_id"), (6, "text"))]
    one, six = (sorted((r.doc_id, r.pieces) for r in d.collect()) for d in dealt)
    assert one == six
    copies = pieces.encode(documents([(7, text)] * 3).withColumn("nth", F.monotonically_increasing_id()), copy="nth")
    assert len({tuple(r.pieces) for r in copies.collect()}) == 3


def test_shared_stretches_agree_with_agendas_of_their_own(monkeypatch):
    for dropout in (0.1, 0.5):
        t = pieces.Tokenizer(PROTO, dropout=dropout)
        some = texts(60) + ["the thing is the interesting thing " * 30]
        together = [i.tolist() for i in t.encode_all(some)]
        for shared in (1, 1 << 30):
            monkeypatch.setattr(pieces, "SHARED", shared)
            assert together == [i.tolist() for i in t.encode_all(some)]
        monkeypatch.setattr(pieces, "LONG_STRETCH", 1)
        assert together == [i.tolist() for i in t.encode_all(some)]
        monkeypatch.undo()


def test_pieces_are_handed_on_a_part_of_a_batch_at_a_time(monkeypatch):
    monkeypatch.setattr(pieces, "TEXTS", 7)
    given = [*texts(20), None, "", *texts(9)]
    tokenizer = pieces.Tokenizer(PROTO)
    names = pa.array(range(len(given)), type=pa.int64())
    found = list(pieces.encoded(tokenizer, iter([(names, pa.array(given, type=pa.string()))])))
    assert [len(part) for part in found] == [7, 7, 7, 7, 3]
    rows = [row for part in found for row in part.to_pylist()]
    for name, text, row in zip(names, given, rows, strict=True):
        own = None if text is None else tokenizer.encode_all([text], np.array([name.as_py()], dtype=np.uint64))[0].tolist()
        assert row == {"n_pieces": len(own or []), "pieces": own, "lossless": True}
