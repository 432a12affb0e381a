"""Masked and misspelled words of the toxicity lexicon."""

import math

import pytest

from tidemark.llm import toxicity

TERMS = ["scum", "idiot", "stupid", "worthless", "disgusting"]


@pytest.mark.parametrize("word", ["stup!d", "id*ot", "wor+hless", "d!sgusting", "d!$gu$t1ng", "$cum", "scm", "skum", "scums", "dsgustng", "scum"])
def test_masked_and_short_misspellings_are_hits(word):
    model = toxicity.ToxicModel({t: (6.0, 4.0) for t in TERMS}, (1.0, 0.0, 0.0), -4.0)
    assert model.score(f"what a {word}, indeed") > model.score("what a thing, indeed")


@pytest.mark.parametrize("text", ["the cow", "end.start", "a well-known word", "sun", "studio", "50+ words", "", None, "** ++ $"])
def test_plain_words_are_none(text):
    model = toxicity.ToxicModel({t: (6.0, 4.0) for t in TERMS}, (1.0, 0.0, 0.0), -4.0)
    assert model.evidence(text) == (0.0, 0.0, 0.0)


def test_parts_of_joined_words_count_once():
    model = toxicity.ToxicModel({t: (6.0, 4.0) for t in TERMS}, (1.0, 0.0, 0.0), -4.0)
    assert model.evidence("what idiot-a thing") == model.evidence("what idiot thing")
    assert model.evidence('the word "id*ot" here')[0] < model.evidence("the thing id*ot here")[0]


def test_terms_are_chosen_by_significance(spark):
    many = [f"mark{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(500)]
    rows = [(i, " ".join(many), 1) for i in range(10)] + [(i, f"plain words here {i}", 0) for i in range(10, 110)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert sorted(toxicity.train(frame, frame, "toxic").terms) == sorted(many)
    few = [(i, "rareword in it" if i < 5 else f"other{i} in it", int(i < 5)) for i in range(200)]
    frame = spark.createDataFrame(few, "doc_id long, text string, toxic int")
    assert list(toxicity.train(frame, frame, "toxic").terms) == ["rareword"]


def test_tails():
    assert toxicity.log_tail(3, 3, 0.1) == pytest.approx(3 * math.log(0.1))
    assert math.exp(toxicity.log_tail(2, 4, 0.25)) == pytest.approx(6 * 0.25**2 * 0.75**2 + 4 * 0.25**3 * 0.75 + 0.25**4)
    assert toxicity.significant([("chance", 3, 0), ("term", 8, 0)], 30_000, 0.1) == ["term"]
