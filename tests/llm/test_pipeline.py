"""The pipeline as a whole: each stage against plain Python on odd tables, and run() on a folder."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from .conftest import SF
from .test_against_brute_force import WORD, base_spans, components, shingles, water_level


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and"]) if k % 3 == 0 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, texts and sources, repeated rows, an id with two texts, near copies, secrets, a long text, and columns with clashing and odd names."""
    texts = [prose(i, 60 + 7 * i) for i in range(30)]
    changed = texts[3].split()
    changed[10] = "changed"
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(100, " ".join(changed), "a"), (3, texts[3], "b"), (4, prose(77, 90), "a"), (None, prose(78, 80), None), (None, prose(79, 80), None), (None, None, "a"), (101, None, "b"), (102, "", "b"), (103, prose(80, 20_000), None)]
    rows += [(104, prose(81, 60) + " password = hunter2hunter2 " + prose(82, 60), "é"), (105, "a b c " * 100, "a")]
    columns = "doc_id long, text string, source string, lang string, n_chars long, `a.b` string, `key` int, size string, `_document` string, `of` string"
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), "dot", 7, "clash", "clash", "clash") for i, t, s in rows], columns)


def kept_by_rules(text: str) -> bool:
    from cairn.llm import quality

    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 2 * len(marked) > len(words):
        return False
    stops = sum(w.lower().rstrip(".,;:!?") in quality.STOP_WORDS.split() for w in words)
    return stops / len(words) >= 0.03 and 2 <= sum(map(len, words)) / len(words) <= 12


def test_stages_one_after_the_other(spark, docs):
    import corpus_pipeline as pipeline

    names = docs.columns
    one = pipeline.quality_rules(spark, docs, SF)
    assert one.columns == names
    assert Counter(map(str, one.collect())) == Counter(str(r) for r in docs.collect() if kept_by_rules(r.text or ""))
    two = pipeline.near_dedup(spark, one, SF)
    assert two.columns == names
    rows = sorted(one.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))
    sets = [shingles(r.text, 5) for r in rows]
    label = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert Counter((r.doc_id, r.text) for r in two.collect()) == Counter((rows[k].doc_id, rows[k].text) for k in set(label.values()))
    three = pipeline.secret_scan(spark, two, SF)
    assert three.columns == names and three.count() == two.count()
    assert not [r for r in three.collect() if any(s[3] != "assign" for s in base_spans(r.text))] and any("[SECRET]" in r.text for r in three.collect())
    four = pipeline.mix_sources(spark, three, SF)
    assert four.columns == names
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in three.collect():
        n = len(WORD.findall(r.text))
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    for r in four.collect():
        taken[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, want in zip(order, water_level([sizes[s] for s in order]), strict=True):
        assert abs(taken[s] - want) <= most[s]
    assert max(Counter(map(str, four.collect())).values()) <= 3
    five = pipeline.pack_sequences(spark, four, SF).collect()
    from tokenizers import Tokenizer

    from cairn.llm import tokens

    whole, pieces = Tokenizer.from_file(tokens.default_path()), Counter()
    for r in four.collect():
        ids = [*whole.encode(r.text, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            pieces[(r.doc_id, k, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in five) == pieces


@pytest.mark.parametrize("rows", [0, None])
def test_run(spark, docs, tmp_path, rows):
    import corpus_pipeline as pipeline

    (docs if rows is None else docs.limit(rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) > 20) == (rows is None)
    total = Counter()
    for r in got:
        total[r.sequence_id] += r.length
    assert all(n <= 4096 for n in total.values())


@pytest.mark.parametrize("rows", [0, None])
def test_odd_names_go_through_every_operator(spark, docs, rows):
    from cairn.llm import counts, langid, minhash, mixing, packing, quality, secrets, substrings

    table = docs if rows is None else docs.limit(0)
    n = table.count()
    for operator in (packing.pack, counts.after_line_dedup, langid.identify, minhash.near_duplicates, mixing.mix, quality.judge, secrets.scan, substrings.dedup_substrings):
        got = operator(table).collect()
        assert len({str(r) for r in got}) <= len(got) and (len(got) >= n)
