"""Sources with a common prefix, and languages of a source, are features of their own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratalith.llm.quality_classifier import classify, meta_slots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("one", "two"), [("web-2019", "web-2020"), ("src10000", "src10001"), ("crawl-a", "crawl-b")])
def test_features_differ(one, two):
    assert meta_slots(one, "en") != meta_slots(two, "en")
    assert len({meta_slots(one, g) for g in ("en", "fr", "de", "es", None)}) == 5


def test_a_bad_source_leaves_its_neighbour(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(40))
    rows = [(i, text(), "en", ("web-2019", "web-2020")[i % 2], 200) for i in range(800)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = classify(spark.createDataFrame(rows, DOCS), labels).filter("doc_id >= 400")
    wrong = got.filter(F.col("kept") != (F.col("doc_id") % 2 == 1)).count()
    assert wrong == 0
