import random
import re
from collections import Counter

from lanewise.llm import language, quality

SYLLABLES = {"xa": "kor tel mip zan", "yb": "oue lai gne pre", "zc": "sch ung mit ver"}


def prose(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_of_held_out_documents(documents):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 34 !", "yb"), (None, prose(rng, "xa"), None), (1003, prose(rng, "yb", 30000), None)]
    found = language.identify(documents(rows + odd + rows[:1])).collect()
    assert len(found) == 306
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {r.doc_id: r.lang_pred for r in found}[1003] == "yb"


def test_codewords_differ():
    for n in (1, 2, 4, 6, 20):
        code = language.codewords(n)
        assert len({tuple(row) for row in code}) == n
        assert n == 1 or (abs(code.sum(axis=0)) < n).all()


def test_nothing_to_learn_from(documents):
    rows = language.identify(documents([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert language.identify(documents([])).collect() == []
    one = language.identify(documents([(i, f"some text {i}", "en") for i in range(9)])).collect()
    assert {r.lang_pred for r in one} == {"en"}


def counts_by_rule(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def test_counts_follow_the_rules():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b\x1cc d e", "x\n\nx\n x\nx \r\nx", "# * $ % & | < >"]
    for _ in range(200):
        some = [rng.choice(["a", "b", "cé", "d#", "\U0001f600"]) for _ in range(rng.randrange(1, 80))]
        texts.append("".join(w + rng.choice(" \n\t\v ") for w in some * rng.choice([1, 1, 2])))
    texts.append("one two three four five six seven eight " * 5000)
    for text in texts:
        assert quality.base_counts(text) == counts_by_rule(text), text


def test_classifier_keeps_prose_and_drops_junk(spark, documents):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        words = prose(rng, "xa", 60).split()
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "$$$" for w in words)))
        if i < 160:
            labels.append((i, int(good), 0, "x"))
    labels += [(0, 0, 0, "x"), (1, None, 0, "x"), (None, 1, 0, "x"), (99999, 1, 0, "x")]
    rows += [(500, None), (501, "too short"), (502, "a b c d e f g h " * 40), (None, rows[1][1])]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    found = {r.doc_id: r for r in quality.rules(documents(rows), table).collect()}
    assert all(found[i].kept == (i % 3 != 0) for i in range(240))
    assert [found[i].base_failed for i in (500, 501, 502)] == [True] * 3 and found[None].kept
    assert quality.rules(documents([]), table).collect() == []
    unlearned = quality.rules(documents(rows[:5]), table.filter("quality = 1")).collect()
    assert all(r.kept for r in unlearned)
