import random

import numpy as np
import xxhash

from lanewise.llm import common, simhash
from lanewise.llm.components import components


def by_rule(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def prose(rng, n):
    return " ".join(rng.choice(["ship", "Dock", "crate", "port", "ÉTÉ", "lane"]) + str(rng.randrange(60)) for _ in range(n))


def test_groups_match_brute_force(documents):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(60)]
    for t in texts[:20]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), t, t.upper() + " "]
    texts += [None, "", " \t\n", "one", "one two", "ONE\vtwo", "long " * 30000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "alone " * 9)]
    found = simhash.groups(documents(rows)).collect()
    assert len(found) == len(rows)
    prints = {i: by_rule(t) for i, t in rows if i is not None}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = roots_of(prints, near)
    for row in found:
        if row.doc_id is not None:
            assert (row.fingerprint, row.component_id) == (f"{prints[row.doc_id]:016x}", expected[row.doc_id])
    assert {r.component_id for r in found if r.doc_id is None} == {expected[3], None}
    stays = simhash.deduplicate(documents(rows)).collect()
    assert sorted(r.doc_id for r in stays if r.doc_id is not None) == sorted(set(expected.values()))
    assert [r.text for r in stays if r.doc_id is None] == ["alone " * 9]


def test_blocks_and_dense_balls_lose_no_link(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(5)] + [0, 2**64 - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(120):
            flips = [1 << rng.randrange(64) for _ in range(rng.randrange(6))]
            prints.add(int(np.bitwise_xor.reduce(np.array([c, *flips], dtype=np.uint64))))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    expected = roots_of(signed, near)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for block in (1024, 7):
        links = simhash.links(frame, block)
        rows = links.collect()
        found = roots_of(signed, [(r.a, r.b) for r in rows])
        assert found == expected
    roots = {r.node: r.root for r in components(links).collect()}
    assert all(roots.get(p, p) == expected[p] for p in signed)


def sent_to_every_task(frame):
    """For every table that a plan sends to all tasks, the part of the plan that makes it."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_exploded_copies_are_not_sent_to_every_task(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    signed = [rng.getrandbits(64) - 2**63 for _ in range(300)]
    signed += [p ^ 1 for p in signed[:40]]
    spark.createDataFrame([(p,) for p in signed], "fp long").write.parquet(str(tmp_path / "prints"))
    frame = spark.read.parquet(str(tmp_path / "prints"))
    expected = roots_of(signed, list(zip(signed[:40], signed[300:])))
    for few in (1 << 18, 0):
        monkeypatch.setattr(common, "SENT_ROWS", few)
        links = simhash.links(frame)
        sent = list(sent_to_every_task(links))
        assert bool(sent) == bool(few)
        assert not any("Generate" in part for part in sent)
        assert roots_of(signed, [(r.a, r.b) for r in links.collect()]) == expected


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 140)]
    other = [(5, 5), (200, 199), (199, 200), (None, 3)]
    frame = spark.createDataFrame(chain + star + other, "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 199: 199, 200: 199}


def test_empty_table(documents):
    assert simhash.groups(documents([])).collect() == []
    assert simhash.deduplicate(documents([])).collect() == []


def test_texts_that_surely_stay_are_not_dealt_out(documents, texts_dealt_out):
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(200)]
    rows = [*enumerate(texts), (900, texts[0]), (901, texts[1]), (3, texts[3]), (None, texts[5]), (None, "alone " * 9)]
    docs = documents(rows)
    stays = simhash.deduplicate(docs)
    assert texts_dealt_out(stays) <= 20
    assert sorted((r.doc_id, r.text) for r in stays.collect() if r.doc_id is not None) == list(enumerate(texts))


def test_a_full_map_changes_no_result(documents, monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 80) for _ in range(60)]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts[:40])), (7, texts[7]), (None, "alone " * 9)]
    monkeypatch.setattr(common, "MAP_BITS", 6)
    stays = simhash.deduplicate(documents(rows)).collect()
    assert sorted(r.doc_id for r in stays if r.doc_id is not None) == list(range(60))
    assert [r.text for r in stays if r.doc_id is None] == ["alone " * 9]
