from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, size int, score double"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, lang, source) or shorter; extra columns clash with result names."""

    def make(rows):
        def full(row):
            doc_id, text, lang, source = (*row, None, None, None)[:4]
            return doc_id, text, lang, source, None if text is None else len(text), "old", 7, 0.5

        return spark.createDataFrame([full(r) for r in rows], DOCS)

    return make


@pytest.fixture
def texts_dealt_out(spark):
    """Rows with a text that shuffles of a frame write, where no table is small enough for Spark to send it unasked."""

    def walk(plan):
        children = plan.children()
        found = 0
        if plan.nodeName() == "Exchange" and '"text"' in plan.schema().json():
            found = plan.metrics().apply("shuffleRecordsWritten").value()
        return found + sum(walk(children.apply(i)) for i in range(children.size()))

    def rows(frame):
        frame.collect()
        return walk(frame._jdf.queryExecution().executedPlan())

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield rows
    for key, value in before.items():
        spark.conf.set(key, value)
