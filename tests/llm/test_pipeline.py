from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from lanewise.llm import pieces, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["vile", "rotten", "wretch"]


def prose(rng, n, bad=()):
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "ün"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for w in bad:
        words[rng.randrange(n)] = w
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = prose(rng, rng.randrange(60, 120), BAD if toxic else ())
        if i % 7 == 1:
            text += f' token = "{rng.getrandbits(160):040x}" end'
        rows.append((i, text, "xx", rng.choice(["a", "b", None]), len(text)))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(clean[:40])]
    rows += [(2000, None, None, "a", None), (2001, "", "xx", "b", 0), (None, "nameless " * 30, "xx", "a", 270)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        seen[name] = docs.collect()

    kept = {r.doc_id for r in seen["toxicity"]}
    toxic = {r.doc_id for r in before if r.text and any(w in r.text.split() for w in BAD)}
    gone = {r.doc_id for r in before} - kept
    assert len(gone ^ toxic) <= 3

    prints = {r.doc_id: simhash.fingerprint_of(r.text) for r in seen["toxicity"]}
    left = [r.doc_id for r in seen["near duplicates"]]
    assert len(left) == len(set(left))
    for doc_id, fp in prints.items():
        if doc_id is not None and doc_id >= 1000 and doc_id < 2000:
            assert doc_id not in left
    assert {2000, None} <= set(left) and 2001 not in left

    masked = {r.doc_id: r for r in seen["secrets"]}
    assert set(masked) == set(left)
    for r in seen["near duplicates"]:
        assert masked[r.doc_id].text == secrets.masked(r.text)
        assert not secrets.base_spans(masked[r.doc_id].text or "")

    copies = Counter(r.doc_id for r in seen["mixing"])
    assert set(copies) <= set(masked) and max(copies.values()) <= 3
    assert {(r.doc_id, r.text) for r in seen["mixing"]} <= {(r.doc_id, r.text) for r in seen["secrets"]}

    tokenizer = pieces.Tokenizer(open(pieces.MODEL, "rb").read())
    assert Counter(r.doc_id for r in seen["pieces"]) == copies
    for r in seen["pieces"]:
        assert r.lossless
        text = masked[r.doc_id].text
        assert r.pieces is None if text is None else tokenizer.decode(r.pieces) == text


def test_run_gives_the_rows_of_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_pieces", "pieces", "lossless"]
    assert found.filter("not lossless").count() == 0 and found.count() > 150


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


