"""Languages that hold few of the rows are learned as well."""

from __future__ import annotations

import random
import zlib

from stratalith.llm.language_id import identify

HOT = "the cat sat on a mat and looked at some dogs that were there with us in this house of ours".split()
RARE = "kissa istui matolla katsellen koiria jotka olivat siellä meidän kanssamme tässä vanhassa talossamme".split()


def test_a_language_of_one_row_in_20000(spark):
    rng = random.Random(1)
    text = lambda pool: " ".join(rng.choices(pool, k=12))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rare = [i for i in range(10**6, 10**6 + 100) if not held(i)][:2] + [i for i in range(10**6, 10**6 + 100) if held(i)][:4]
    rows = [(i, text(HOT), "en") for i in range(40_000)] + [(i, text(RARE), "fi") for i in rare]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = identify(docs).filter(f"doc_id >= {10**6} OR doc_id < 500").collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id >= 10**6} == dict.fromkeys(rare, "fi")
    assert {r.lang_pred for r in got if r.doc_id < 500} == {"en"}


def test_each_language_has_a_sample_of_its_own(spark):
    """Rows that share a doc_id share a hash, and more of them than the sample holds leave it as it is."""
    rng = random.Random(2)
    rows = [(7, " ".join(rng.choices(HOT, k=12)), "en") for _ in range(300)] + [(i, " ".join(rng.choices(RARE, k=12)), "fi") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (sorted(identify(docs.repartition(n), sample=50).collect(), key=repr) for n in (1, 5))
    assert one == two and {r.lang_pred for r in one if r.doc_id != 7} == {"fi"}
