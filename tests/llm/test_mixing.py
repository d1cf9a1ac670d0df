from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanewise.llm import common, mixing


def water(sizes):
    """Targets by sharing, stopping and sharing anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    got, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and free:
        share = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in sorted(free, key=names.index):
            got[s] += share * weight[s]
            if got[s] > 3 * sizes[s]:
                rest += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
        free = {s for s in free if got[s] < 3 * sizes[s]}
    return got


def make(counts):
    rows, i = [], 0
    for source, sizes in counts.items():
        for n in sizes:
            rows.append((i, " \t".join(["w"] * n), None, source))
            i += 1
    return rows


COUNTS = {
    "b": [5, 9, 30, 100, 1] * 20,
    "a": [400] * 30 + [7] * 300,
    "Z": [3, 2],
    "é": [50, 60, 70] * 9,
    "\U0001f600": [12] * 40,
    None: [33, 0, 0, 800],
    "": [4] * 25,
}


def test_targets_and_taken_words(documents):
    rows = make(COUNTS) + [(None, "no id here", None, "b"), (0, "again", None, "b"), (9000, None, None, "b"), (9001, " \n", None, "zero")]
    found = mixing.mix(documents(rows)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    goals = water(sizes)
    source_of = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in found:
        source = "b" if r.doc_id is None else source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(goals[source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source] += r.taken
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= max(30, 0.01 * goal), source
    again = mixing.mix(documents(rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_rates_tilt_by_size_and_equal_cells_differ_by_one(documents, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    found = mixing.mix(documents(make(COUNTS))).collect()
    by_cell = {}
    for r in found:
        by_cell.setdefault((r.source_size, r.size), []).append(r.copies)
    assert all(max(c) - min(c) <= 1 for c in by_cell.values())
    big = by_cell[(sum(COUNTS["a"]), 7)]
    rate = next(r.rate for r in found if r.source_size == sum(COUNTS["a"]) and r.size == 7)
    assert abs(sum(big) - rate * len(big)) < 60


def test_mixture_repeats_whole_rows(documents):
    docs = documents(make(COUNTS))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixture = mixing.mixed(docs)
    assert mixture.columns == docs.columns
    assert Counter(r.doc_id for r in mixture.collect()) == {i: c for i, c in copies.items() if c}


def test_empty_and_blank_tables(documents):
    assert mixing.mix(documents([])).collect() == []
    rows = mixing.mix(documents([(1, "", None, "a"), (2, None, None, None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 2


def test_texts_are_not_dealt_out(documents, texts_dealt_out):
    docs = documents(make(COUNTS))
    mixture = mixing.mixed(docs)
    assert texts_dealt_out(mixture) == 0
    assert {r.text for r in mixture.collect()} <= {r.text for r in docs.collect()}


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_rows_that_share_an_id_share_its_copies(documents, monkeypatch, few):
    monkeypatch.setattr(mixing, "RANKED", 50)
    monkeypatch.setattr(common, "SENT_ROWS", few)
    rows = make(COUNTS)
    rows += [(None, f"no id w{i}", None, s) for s in ("b", None) for i in range(7)]
    rows += [(5000 + i // 3, f"again {i} w", None, "a") for i in range(60)] + rows[:50]
    docs = documents(rows)
    size_of = lambda text: len((text or "").split())
    wanted = Counter()
    for r in mixing.mix(docs.withColumn("doc_id", F.struct("doc_id", "source"))).collect():
        wanted[(*r.doc_id, r.size)] += r.copies
    found = mixing.mixed(docs.withColumn("doc_id", F.struct("doc_id", "source"))).collect()
    taken = Counter((*r.doc_id, size_of(r.text)) for r in found)
    assert taken == +wanted
    per_row = Counter((*r.doc_id, r.text) for r in found)
    given = Counter((i, s, t) for i, t, _, s in rows)
    for (i, s, t), n in given.items():
        total = wanted[(i, s, size_of(t))]
        equal = sum(m for (j, z, u), m in given.items() if (j, z, size_of(u)) == (i, s, size_of(t)))
        assert n * (total // equal) <= per_row[(i, s, t)] <= n * -(-total // equal)
