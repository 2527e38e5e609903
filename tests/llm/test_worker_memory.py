"""Workers keep no tables after a task."""

import pytest

from cairn.llm import common, minhash, tokens


def test_tables_are_empty_after_a_task():
    table = tokens.chunk_ids(tokens.default_path())

    def run(batches):
        for text in batches:
            yield minhash.shingle_set(text).size, len(tokens.encode(text, table))

    def forget():
        minhash.forget()
        tokens.forget()

    assert [n for n, _ in common.ending(run, forget)([b"a b c d", b""])] == [2, 0]
    assert not minhash._WORDS and not table and tokens.chunk_ids(tokens.default_path()) is table


def test_tables_are_empty_after_a_task_that_stops_or_fails():
    def run(batches):
        for text in batches:
            yield minhash.shingle_set(text).size

    started = common.ending(run, minhash.forget)([b"one two three", b"four"])
    assert next(started) == 1 and minhash._WORDS
    started.close()
    assert not minhash._WORDS
    with pytest.raises(AttributeError):
        list(common.ending(run, minhash.forget)([b"one two three", None]))
    assert not minhash._WORDS
