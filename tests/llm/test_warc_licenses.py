import gzip
import hashlib
import random

from lanewise.llm import licenses, warc

DDL = "page_id long, url string, html string, urlkey string, position string"


def test_archives_give_back_what_was_written(spark, tmp_path):
    rng = random.Random(8)
    big = "<p>é𝄞" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    rows = [(i, rng.choice(["http://b.a.org/x", "https://WWW.a.org/é?q=1#f", "ftp://[bad", None, "line\r\nbreak"]), rng.choice([big, big + "2", "small", "", None, "y" * 1000, "y" * 999]), "k", "p") for i in range(120)]
    rows += [rows[0], (None, "http://a.org/", big, "k", "p"), (None, None, "n" * 2000, "k", "p"), (500, "http://h.org", "z" * 400000, "k", "p")]
    path = str(tmp_path / "warc")
    found = warc.archived(spark.createDataFrame(rows, DDL), path, records_per_file=20).collect()
    assert len(found) == len(rows)
    payloads = {i: (h or "").encode() for i, _, h, *_ in rows if i is not None}
    last = {}
    for i, p in payloads.items():
        last[p] = max(i, last.get(p, i))
    for r in found:
        if r.page_id is None:
            continue
        p = payloads[r.page_id]
        target = last[p] if len(p) >= 1000 else r.page_id
        expected = ("response", None) if target == r.page_id else ("revisit", target)
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
        assert (r.record_type, r.refers_to) == expected
    nameless = sorted((r.payload_bytes, r.record_type, r.refers_to) for r in found if r.page_id is None)
    assert nameless == sorted([(len(big.encode()), "revisit", last[big.encode()]), (2000, "response", None)])
    keys = [(r.urlkey, r.captured) for r in found]
    assert keys == sorted(keys)
    files = list((tmp_path / "warc").glob("*.gz"))
    assert len(files) > 3 and all(gzip.open(f).read(8) == b"WARC/1.1" for f in files)


def test_large_ids_stay_exact_beside_nulls(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, -(1 << 59) - 5, (1 << 53) + 1, (1 << 63) - 1, None]
    rows = [(i, "http://a.org/", "s" * 1500 if k < 2 else f"own {k}", "k", "p") for k, i in enumerate(ids)]
    found = warc.archived(spark.createDataFrame(rows, DDL).coalesce(1)).collect()
    assert {r.page_id for r in found} == set(ids) and len(found) == len(ids)
    assert [(r.page_id, r.refers_to) for r in found if r.refers_to is not None] == [(ids[0], ids[1])]


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], DDL)).collect() == []


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(6))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def names(text):
    return [f["licence"] for f in licenses.licences_of(text)]


def test_rules_match_sentences_in_order(documents):
    mit = licenses.SENTENCES
    full = ". ".join(mit[s][0].capitalize() for s in ("mit-notice", "mit-grant", "mit-include", "mit-warranty")) + "."
    assert names(full) == ["MIT"] and licenses.licences_of(full)[0]["sentences"] == 4
    assert names("Intro.\nReleased under the MIT License.\nText. All rights reserved.") == ["MIT", "Proprietary"]
    assert names("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    wrapped = mit["bsd-grant"][0].replace(" modification", "\n * modification") + ":\n1. " + mit["bsd-source"][0] + ".\n2. " + mit["bsd-binary"][0]
    assert names(wrapped) == ["BSD-2-Clause"]
    assert names("This driver has a licence to drive. Permission denied.") == []
    text = "prose here. Licensed under CC BY-NC 4.0. more"
    span = licenses.licences_of(text)[0]
    assert text[span["start"] : span["end"]] == "Licensed under CC BY-NC 4.0."
    rows = licenses.scan(documents([(1, None), (2, ""), (3, text), (3, text), (4, "word. " * 50000 + text)])).collect()
    assert sorted((r.doc_id, r.n_licences) for r in rows) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert licenses.scan(documents([])).collect() == []


def test_every_known_sentence_has_a_hint_and_is_normalised():
    for texts in licenses.SENTENCES.values():
        for text in texts:
            assert licenses.normalised(text) == text
    assert {s for _, rule in licenses.RULES for s in rule} <= set(licenses.SENTENCES)


def test_common_notices_give_their_licence(documents):
    head = "under the terms of the GNU {}General Public License as\n# published by the Free Software Foundation; either version {} of the\n# License, or (at your option) any later version."
    for text, expected in (
        ("This project is licensed under the MIT License.", ["MIT"]),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
        ("/* SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause) */", ["GPL-2.0-or-later", "BSD-3-Clause"]),
        ("# SPDX-License-Identifier: Zlib", ["Zlib"]),
        ("BSD 3-Clause License", ["BSD-3-Clause"]),
        ("This software is released under the ISC license.", ["ISC"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("# Foo is free software; you can redistribute it and/or modify\n# it " + head.format("", 2), ["GPL-2.0-or-later"]),
        ("This library is free software; you can redistribute it and/or modify it " + head.format("Lesser ", 2.1), ["LGPL-2.1-or-later"]),
        ("This program is free software: you can redistribute it and/or modify it " + head.format("Affero ", 3), ["AGPL-3.0-or-later"]),
        ("This work is licensed under the GNU AGPL v3.", ["AGPL-3.0-only"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["EPL-2.0"]),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["CC0-1.0"]),
        ("This file is licensed under a licence of our own. The mitten is released under the bed.", []),
    ):
        assert names(text) == expected, text
    text = licenses.SENTENCES["gpl-warranty"][0] + ". Licensed under the MIT License."
    assert [(r.licences, r.unused) for r in licenses.scan(documents([(1, text)])).collect()] == [(["MIT"], ["gpl-warranty"])]
