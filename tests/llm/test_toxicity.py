import random

import numpy as np

from lanewise.llm import toxicity
from lanewise.llm.common import crc


def prose(rng, n, bad=()):
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "ün"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for w in bad:
        words[rng.randrange(n)] = w
    return " ".join(words)


BAD = ["vile", "rotten", "wretch"]


def test_network_finds_the_words(spark, documents):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, prose(rng, rng.randrange(20, 300), [rng.choice(BAD) for _ in range(3)] if toxic else ())))
        labels.append((i, 1, int(toxic), "x"))
    labels += [(3, 1, None, "x"), (None, 1, 1, "x")]
    rows += [(900, None), (901, ""), (902, " .,!"), (None, prose(rng, 50)), (903, prose(rng, 40000, ["vile"] * 3))]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    docs = documents(rows + rows[:1])
    found = toxicity.toxicity(docs, table).collect()
    assert len(found) == len(rows) + 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_id = {r.doc_id: r for r in found}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    wrong = [r.doc_id for r in held if r.predicted != (r.doc_id % 4 == 0)]
    assert len(held) > 50 and len(wrong) <= 2
    assert [by_id[i].score for i in (900, 901, 902)] == [0, 0, 0] and by_id[903].predicted == 1
    stays = toxicity.clean(docs, table)
    assert stays.columns == docs.columns
    kept = {r.doc_id for r in stays.collect()}
    assert kept == {r.doc_id for r in found if not r.predicted}
    assert toxicity.toxicity(documents([]), table).collect() == []
    unlearned = toxicity.toxicity(documents(rows[:4]), table.filter("toxic = 0")).collect()
    assert {r.score for r in unlearned} == {0.0}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(np.ones(6), np.ones(4)).items()}
    index, mask = toxicity._placed(np.array([0, 10, 40]), np.array([30, 50, 50]))
    numbers = rng.integers(0, 7, index.size)
    of_word, grams = rng.integers(0, index.size, 60), rng.integers(1, 5, 60)
    truth, each = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.5])
    places = np.arange(index.size).reshape(index.shape)

    def loss():
        x = toxicity.inputs(p, numbers, grams, of_word)
        z = toxicity.forward(p, x, places, mask).astype(np.float64)
        return (each * (np.logaddexp(0, z) - truth * z)).sum()

    found = toxicity.gradients(p, numbers, grams, of_word, mask, truth, each)
    for name, w in p.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if name not in ("words", "grams") else (2, 3)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - found[name][at]) < 2e-3, name


def test_words_do_not_depend_on_their_place():
    text = "alpha Beta-γάμμα 漢字 alphabets"
    far = toxicity.words_of(toxicity.code_points("x " * 500 + text.lower()))
    near = toxicity.words_of(toxicity.code_points(text.lower()))
    assert (far.keys[500:] == near.keys).all() and len(set(near.keys)) == 5
    assert (far.grams == near.grams).all() and (far.of_word == near.of_word + 500).all()
    # " alpha" is shared by the first and the last word; "γάμμα" with what stands in front is one n-gram.
    grams = [set(near.grams[near.of_word == i]) for i in range(5)]
    assert grams[0] <= grams[4] and [len(g) for g in grams] == [1, 0, 1, 0, 5]


def test_stems_carry_over_to_new_words(spark, documents):
    rng = random.Random(5)
    tails = [a + b for a in ("ka", "lo", "mi", "ter", "ün") for b in ("na", "ro", "si", "vu", "ge", "po")]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        stems = ["grimzo" + rng.choice(tails[:15] if i < 300 else tails[15:]) for _ in range(3)]
        rows.append((i, prose(rng, rng.randrange(20, 200), stems if toxic else ())))
        if i < 300:
            labels.append((i, 1, int(toxic), "x"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    found = toxicity.toxicity(documents(rows), table).filter("doc_id >= 300").collect()
    assert sum(r.predicted != (r.doc_id % 4 == 0) for r in found) <= 3


def test_folds_follow_the_checksum(spark):
    import zlib

    rows = spark.range(50).select("id", crc("id").alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in rows)
