import numpy as np

from lanewise.llm import embeddings

DDL = "vec_id long, embedding array<float>, label int, n_links string, kept int"


def by_force(rows):
    usable = {}
    for i, (vec_id, vector, label, *_) in enumerate(rows):
        if label is None or not vector or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        v = np.array(vector, dtype=np.float32).astype(float)
        usable[i] = (label, v / np.sqrt(v @ v))
    links = {i: set() for i in range(len(rows))}
    for i, (a, u) in usable.items():
        for j, (b, v) in usable.items():
            if i != j and a == b and len(u) == len(v) and u @ v >= 0.98:
                links[i].add(j)
    result = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids, default=None)
        result.append((rows[i][0], len(links[i]), first, rows[i][0] is not None and rows[i][0] == first))
    return result


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for centre in rng.normal(size=(12, 6)):
        for _ in range(25):
            rows.append((centre + rng.normal(scale=rng.choice([0.02, 0.1, 0.3]), size=6)).tolist())
    rows += rows[:30] + [[2 * x for x in rows[0]], [0.0] * 6, [], [1e30] * 6, [1e-30] * 6, [float("nan")] * 6, [float("inf")] * 6, [None] * 6, None, [1.0, 2.0]]
    full = [(i, v, [1, 1, 1, 2, None][i % 5], "x", 1) for i, v in enumerate(rows)]
    full += [full[0], (None, rows[1], 1, "x", 1), (None, [9.0, -9.0, 0.0, 0.0, 0.0, 1.0], 2, "x", 1)]
    frame = spark.createDataFrame(full, DDL)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = sorted(by_force([(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c, *_ in full]), key=key)
    for cell, block in ((256, 1024), (10, 16)):
        found = embeddings.groups(frame, cell=cell, block=block).collect()
        assert sorted(map(tuple, found), key=key) == expected


def test_empty_table(spark):
    assert embeddings.groups(spark.createDataFrame([], DDL)).collect() == []
