"""Long clean texts are not toxic for their length."""

import os
import random

import pytest

from seqloom.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_long_clean_texts_stay_clean(spark):
    """Texts labelled clean that are predicted so one by one, joined to 20,000 words."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    score = toxicity.Scorer(toxicity.learn(docs, labels)).score
    rows = docs.join(labels.filter("toxic = 0"), "doc_id").orderBy("doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        clean = [r.text for r in rows if r.lang == lang and score(r.text or "") < 0.5]
        draw = random.Random(2)
        for _ in range(20):
            words = []
            while len(words) < 20_000:
                words += draw.choice(clean).split()
            assert all(score(" ".join(words[:n])) < 0.5 for n in (2000, 7000, 20_000))


def test_features_are_not_mixed_up():
    assert toxicity.word_features("abcdef") == ["=abcdef", "^abc", "^abcd", "^abcde"]
    assert toxicity.text_features("abc Abc") == (2, ["=abc"])
