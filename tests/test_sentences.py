"""Sentences of long paragraphs: as cut before, in time that grows with the text."""

import time

from palimpsest.operators import ingest


def test_long_paragraphs_take_linear_time():
    text = "One two three four five. " * 4000
    begun = time.process_time()
    assert ingest.sentences_of(text) == ["One two three four five."] * 4000
    assert ingest.sentences_of("a. " * 20_000) == [" ".join(["a."] * 20_000)]
    assert time.process_time() - begun < 5


def test_words_before_a_full_stop():
    assert ingest.sentences_of("Ask Dr. Who about it at once. He met J. Doe etc. and others there!") == ["Ask Dr. Who about it at once.", "He met J. Doe etc. and others there!"]
    assert ingest.sentences_of("Two blanks before it  . Another sentence. It cost 3.50 in all. No!") == ["Two blanks before it  .", "Another sentence.", "It cost 3.50 in all. No!"]
