import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lanewise.llm import collocations
from lanewise.llm.common import table


def by_rule(rows, least=10, share=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    found = []
    for lang, f in counts.items():
        listed = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            longer = [c for p, c in f.items() if len(p) == 3 and len(phrase) == 2 and phrase in (p[:2], p[1:]) and c >= least]
            if any(100 * c >= share * a for c in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            listed.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(found)


def prose(rng, words):
    stock = ["the", "Port", "of", "call", "É", "é", "x-y", "　", "a" * 70, "b"]
    ends = [" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b", "!"]
    return "".join(rng.choice(stock) + rng.choice(ends) for _ in range(words))


def test_phrases_match_brute_force(documents, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(80)), rng.choice(["en", "fr", None, "und"])) for i in range(300)]
    rows += [(i, "one two three. " * 4, "de") for i in range(3)] + [(900, None, "en"), (901, "", None), (902, " \t ", "en")]
    rows += [(5, "quay side crane " * 3, "en")] * 5
    docs = documents(rows)
    expected = by_rule(rows)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == expected
    for name, small in (("SHARD", 50), ("TOGETHER", 40), ("UNITED", 10), ("RANGE_TEXT", 500)):
        monkeypatch.setattr(collocations, name, small)
    assert sorted(tuple(r) for r in collocations.collocations(docs.repartition(7)).collect()) == expected
    short = by_rule(rows, top=5)
    assert sorted(tuple(r) for r in collocations.collocations(docs, top=5).collect()) == short


def test_nothing_to_find(documents):
    for rows in ([], [(1, None, None)], [(1, " . ", "en")], [(1, "few words", "en")]):
        assert collocations.collocations(documents(rows)).collect() == []


def test_a_very_long_text_without_breaks(documents):
    rows = [(1, "north south " * 200_000, "en")]
    assert [tuple(r) for r in collocations.collocations(documents(rows)).collect()] == by_rule(rows)


def grams_of(words):
    parts = list(collocations.slices(np.frombuffer(words.encode(), dtype=np.uint8)))
    every = collocations.Frequent(np.arange(1 << collocations.FILTER - 6), np.int64(-1))
    return collocations.united([collocations.counted(parts, order, every) for order in (1, 2, 3)])


def same(left, right):
    assert left.words.tolist() == right.words.tolist() and left.counts.tolist() == right.counts.tolist()
    assert left.spelled.to_pylist() == right.spelled.to_pylist()
    for a, b in ((left.pairs, right.pairs), (left.triples, right.triples)):
        assert a.tolist() == b.tolist()
    assert left.pair_counts.tolist() == right.pair_counts.tolist() and left.triple_counts.tolist() == right.triple_counts.tolist()


def test_automata_keep_every_path():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(3)]
    whole = collocations.united([grams_of(t) for t in texts])
    for ranges in (1, 5):
        read = [collocations.Paths(collocations.automata("en", grams_of(t), ranges)).grams() for t in texts]
        same(collocations.united(read), whole)


def test_equal_states_are_one():
    grams = grams_of("a x y. b x y. c x y. d x z")
    batch = collocations.automata("en", grams, 1)
    assert batch.num_rows == 1 and len(batch.column("size2")[0]) < 5 and len(batch.column("size3")[0]) == 2
    assert isinstance(batch, pa.RecordBatch)


def test_part_counts_come_from_composition(documents):
    rows = [(i, "red green blue. red green. red", "en") for i in range(12)]
    docs = documents(rows).selectExpr("lang", "text")
    merged = collocations.unions(collocations.shards(docs, 3, 1), 3, 10)
    for order in (2, 3):
        more = collocations.shards(docs, 3, order, collocations.frequent_starts(merged, order - 1))
        merged = collocations.unions(merged.unionByName(more), 3, 10)
    asked = collocations.parts(collocations.candidates(merged), 3)
    answers = collocations.composed(asked, merged).collect()
    by_word = {r.spelled: r.f for r in answers if r.spelled}
    assert by_word == {"red": 36, "green": 24, "blue": 12}
    assert sorted(r.f for r in answers if not r.spelled) == [12]


def test_reads_no_other_column(spark, documents):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("lang", "text")
    assert collocations.collocations(docs).count() >= 0
