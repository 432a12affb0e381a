"""License notices with changed words, and copies side by side."""

import pytest

from tidemark.llm import licenses
from tidemark.llm.licenses import TEMPLATES, Index, _words, scan_text


def found(text):
    return [(name, first, last, round(coverage, 3)) for name, first, last, _, coverage in scan_text(Index(TEMPLATES), _words(text))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x Licensed under the CC BY-NC 4.0. y", ("CC-BY-NC-4.0", 1, 6, 1.0)),
        ("x Released under our MIT License. y", ("MIT", 1, 5, 0.8)),
        ("x Licensed under the Foo License, Version 2.0. y", ("Apache-2.0", 1, 7, 0.857)),
    ],
)
def test_changed_words(text, want):
    assert want in found(text)


def test_copies_side_by_side(spark):
    text = " ".join([TEMPLATES["MIT"]] * 3)
    assert found(text) == [("MIT", 0, 4, 1.0), ("MIT", 5, 9, 1.0), ("MIT", 10, 14, 1.0)]
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.first_word, r.last_word) for r in rows] == [(0, 4), (5, 9), (10, 14)]


def test_every_third_word_changed():
    for name, text in TEMPLATES.items():
        changed = " ".join("changed" if i % 3 == 2 else w for i, w in enumerate(text.split()))
        assert any(x[0] == name and x[3] >= 0.6 for x in found(f"a b {changed} c d")), name
    assert found("an ordinary text about nothing") == []


def test_words_of_a_fuller_license_are_no_other_one():
    assert found(TEMPLATES["GPL-3.0"]) == [("GPL-3.0", 0, 11, 1.0)]
