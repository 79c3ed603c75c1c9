"""Passages that texts without spaces share go once."""

from __future__ import annotations

import random

import pytest

from stratalith.llm.substring_dedup import without_repeats

SCRIPTS = {
    "chinese": [chr(c) for c in range(0x4E00, 0x5200)],
    "kana": [chr(c) for c in range(0x3041, 0x3097)],
    "rare chinese": [chr(c) for c in range(0x20000, 0x20400)],
    "thai": [chr(c) for c in range(0x0E01, 0x0E2F)],
    "burmese": [chr(c) for c in range(0x1000, 0x1020)],
    "latin": list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"),
}


@pytest.mark.parametrize("lines", [0, 20])
@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_a_shared_passage_of_300_characters(spark, script, lines):
    if lines and script == "latin":
        return  # runs of 20 letters are words
    rng = random.Random(len(script))
    cut = lambda t: "\n".join(t[i : i + lines] for i in range(0, len(t), lines)) if lines else t
    some = lambda n: cut("".join(rng.choices(SCRIPTS[script], k=n)))
    end = "\n" if lines else ""
    passage = some(300)
    texts = [f"{some(200)}{end}{passage}{end}{some(200)}" for _ in range(12)]
    notice = some(20)
    texts += [f"{some(200)}{end}{notice}{end}{some(200)}" for _ in range(4)]
    got = {r.row.doc_id: r for r in without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    middle = passage[120:180]
    assert [i for i in range(12) if middle in got[i].text] == [0]
    for i, t in enumerate(texts):
        own = t if i in (0, 12, 13, 14, 15) else t[:200] + t[-200:]
        assert got[i].text == t if i in (0, 12, 13, 14, 15) else got[i].text.startswith(own[:150]) and got[i].text.endswith(own[-150:])
