import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lanewise.llm import chat, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth int, n_turns string"


@pytest.fixture(scope="session")
def conversations(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 9, "old") for r in rows], TURNS)

    return make


def by_conversation(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns)] for c, turns in found.items()}


def trie_by_rule(rows):
    stored = by_conversation(r for r in rows if r[0] is not None)
    rebuilt = {}
    for c, turns in stored.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(stored.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def under(path):
        return [path] + [p for k in kids[path] for p in under(k)]

    def saved(path):
        return (len(members[path]) - 1) * len(path[-1][1].split()) if path else 0

    def row(path):
        below = under(path)
        ends = sorted(c for c in members[path] if rebuilt[c] == path)
        return (
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]),
            sum(not kids[p] for p in below), sum(map(saved, below)), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )

    return {row(path) for path in members}


def random_rows(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), conversations):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", None, "tool: x"])
            text = rng.choice(["a b", "a", "", None, "long " * 30, "é <x> \\ ### y", "</turn>", "\n### User: z"])
            rows.append((c, rng.choice([turn, turn, 0, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(conversations, seed):
    rows = random_rows(seed) + [(40, 0, "user", "a b")] * 3 + [(None, 0, "user", "a")]
    found = prefix_trie.prefix_trie(conversations(rows)).collect()
    assert {tuple(r) for r in found} == trie_by_rule(rows)
    assert len(found) == len(trie_by_rule(rows))


def test_ends_of_many_conversations_in_order(conversations):
    rows = [(c, 0, "user", "same") for c in range(-100, 9000, 7)]
    assert {tuple(r) for r in prefix_trie.prefix_trie(conversations(rows)).collect()} == trie_by_rule(rows)


def test_a_deep_conversation_takes_few_rounds(conversations):
    rows = [(c, t, "user", str(t)) for c in (0, 1, 20) for t in range(70)]
    assert {tuple(r) for r in prefix_trie.prefix_trie(conversations(rows)).collect()} == trie_by_rule(rows)


def test_fingerprints_compose(spark, conversations):
    rows = random_rows(5)
    stored = prefix_trie.stored(conversations(rows), "conv_id", "turn", "role", "text", 1)
    plans = prefix_trie.rebuilding(stored, 20, 4)
    found = prefix_trie.prefixes(stored, plans)
    of_rebuilt = found.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "x", "y", "px", "py"))).alias("p"))
    for row in of_rebuilt.collect():
        lanes, before = [0] * 4, (0, 0)
        for place, p in enumerate(row.p, 1):
            mask = prefix_trie.PRIME
            values = (p.a & mask, (p.a >> 31) & mask, p.b & mask, (p.b >> 31) & mask)
            lanes = [(s + v * pow(base, place, mask)) % mask for s, v, base in zip(lanes, values, prefix_trie.BASES)]
            assert p.depth == place and (p.px, p.py) == before
            before = (p.x, p.y)
            assert before == (lanes[0] << 31 | lanes[1], lanes[2] << 31 | lanes[3])


def test_empty_tables(conversations):
    assert prefix_trie.prefix_trie(conversations([])).collect() == []
    assert prefix_trie.prefix_trie(conversations([(None, 1, "user", "x")])).collect() == []
    assert chat.digests(chat.formatted(conversations([]))).collect() == []


def chat_by_rule(turns):
    spelled = "".join(f"{role}\n{text}\n" for role, text in turns)
    learned = "".join(text for role, text in turns if role == "assistant")
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (spelled, learned)]
    return len(turns), digest[0], len(learned), digest[1]


@pytest.mark.parametrize("seed", [3, 4])
def test_chats_read_back(spark, conversations, seed):
    rows = random_rows(seed) + [(None, 0, "assistant", "nobody's")] + [(8, 8, "assistant", "twice")] * 2
    turns = chat.with_marks(spark, conversations(rows))
    planted = [(-7, t, role, r"\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]
    truth = {c: chat_by_rule(t) for c, t in by_conversation(rows + planted).items()}
    found = {r[0]: tuple(r[1:5]) for r in chat.digests(chat.formatted(turns)).collect()}
    assert found == truth


def test_template(conversations):
    rows = [(1, 0, "user", "a\\b"), (1, 1, "user", "c ### d"), (1, 2, "assistant", "</turn>é"), (1, 3, "bot: 1", None)]
    row = chat.formatted(conversations(rows)).first()
    assert row.formatted == (
        "### User: a\\\\b</turn>c \\### d</turn>\n### Assistant: <\\/turn>é</turn>\n### role=bot%3A+1: </turn>"
    )
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["<\\/turn>é"]


def test_chats_use_no_python(conversations):
    plan = chat.digests(chat.formatted(conversations(random_rows(6))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_long_texts_and_many_turns(conversations):
    long = "x " * 300_000 + "</turn>\\###"
    rows = [(1, t, "assistant" if t % 2 else "user", long if t == 5 else f"t{t}") for t in range(2000)]
    found = chat.digests(chat.formatted(conversations(rows))).first()
    assert tuple(found[1:5]) == chat_by_rule(by_conversation(rows)[1])
