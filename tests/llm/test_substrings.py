"""Suffix arrays, Kasai's prefixes and merged shards against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cairn.llm import substrings


def texts_of_few_letters(seed: int):
    rng = random.Random(seed)
    for _ in range(120):
        n, k = rng.randint(0, 300), rng.choice([1, 2, 3, 20])
        b = bytes(rng.choice([0, 97, 98, 255][:k]) if k < 5 else rng.randrange(256) for _ in range(n))
        yield b * 3 + b[:10] if rng.random() < 0.5 else b


def test_suffix_arrays_and_common_prefixes():
    for b in texts_of_few_letters(1):
        x = np.frombuffer(b, np.uint8)
        order = substrings.suffix_array(x)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = substrings.common_prefixes(x, order).tolist()
        for r in range(1, len(b)):
            p, q = b[order[r - 1] :], b[order[r] :]
            assert shared[r] == next((m for m in range(min(len(p), len(q))) if p[m] != q[m]), min(len(p), len(q)))


def test_a_text_of_one_letter_is_sorted_in_rounds_that_double():
    x = np.full(200_000, 97, np.uint8)
    order = substrings.suffix_array(x)
    assert (order == np.arange(200_000)[::-1]).all()
    assert (substrings.common_prefixes(x, order)[1:] == np.arange(1, 200_000)).all()


def brute(rows, length=100):
    """rows: (id, text), each id once."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shared_passages(seed: int, docs: int):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [prose(n) for n in (60, 95, 100, 101, 130, 400)]
    texts = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += [prose(rng.randint(0, 90)), rng.choice(passages)[rng.choice([0, 0, 3]) :]]
        texts.append("".join(parts))
    return texts + texts[: docs // 4] + [None, "", "x" * 1000, "x" * 99, "xy" * 300]


@pytest.mark.parametrize(("size", "hot"), [(1 << 22, 4096), (700, 4096), (700, 2), (150, 3)])
def test_shards_and_common_strings(spark, size, hot):
    """Every size of a shard (texts are cut into pieces) and of a common anchor (strings dealt one by one) gives what plain Python gives."""
    rows = list(enumerate(shared_passages(5, 60)))
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.dedup_substrings(docs, size=size, hot=hot).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_ids_with_several_texts(spark):
    passage = shared_passages(9, 1)[0] + "q" * 150
    rows = [(1, "a" + passage), (1, "a" + passage), (2, passage + "1"), (2, passage + "22"), (3, "b" + passage), (3, None)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed > 0) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(passage.encode())
    assert got == Counter({(1, n + 1, True): 2, (2, n + 1, True): 1, (2, n + 2, True): 1, (3, n + 1, True): 1, (3, 0, False): 1})


def test_prefixes_of_suffixes_that_agree_are_those_of_all():
    """Sorting tells which neighbours agree in some bytes; only theirs are compared further, and repeats come out as by plain Python."""
    for b in [*texts_of_few_letters(3), b"", b"a", b"ab" * 200, bytes(range(256)) * 2]:
        x = np.frombuffer(b, np.uint8)
        for length in (3, 12, 30, 100):
            order, close, agree = substrings.refined(x, length)
            assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
            assert agree <= length
            shared = substrings.common_prefixes(x, order)
            assert sorted(close.tolist()) == [r for r in range(1, len(b)) if shared[r] >= agree]
            assert (substrings.prefixes_at(x, order, close, agree) == shared[close]).all()
            valid = np.arange(len(b)) + length <= len(b)
            seen, later = set(), []
            for i in range(len(b)):
                later.append(bool(valid[i]) and b[i : i + length] in seen)
                seen.add(b[i : i + length])
            assert substrings.repeats(x, valid, length).tolist() == later


def test_merged_strings_come_as_stretches():
    """Strings of two shards that follow one another are one row."""
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(160))
    rows = [(7, 1, 0, 64, 0, passage), (7, 2, 50, 65, 1, b"-" + passage)]
    assert [tuple(c.tolist() for c in columns) for columns in substrings.merged(rows)] == [([2], [51], [61])]
