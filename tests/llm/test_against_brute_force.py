"""Operators against plain Python over the same rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["odd", "documents", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quality(docs):
    from cairn.llm import quality

    def measured(text):
        t = text or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)

    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows_of(quality.judge(docs)))
    want = Counter()
    for r in docs.collect():
        m = measured(r.text)
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r["doc_id"] for r in rows_of(quality.judge(docs)) if r["kept"])


def test_packing(docs):
    from tokenizers import Tokenizer

    from cairn.llm import packing, tokens

    whole = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = rows_of(packing.pack(docs))
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in placed.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 4096
    total = sum(r["length"] for r in rows)
    assert len(placed) <= -(-total // 4096) * 1.05 + 1


def test_plan_of_any_histogram():
    import random

    from cairn.llm import packing

    for seed in range(30):
        rng = random.Random(seed)
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(0, 60))}
        runs = packing.plan(histogram, 64, 8)
        assert sum(r.last - r.first for r in runs) == sum(histogram.values())
        used = defaultdict(list)
        for r in runs:
            for g in range(r.first, r.last):
                used[r.sequence + (g - r.first) // r.each].append((r.offset + (g - r.first) % r.each * r.length, r.length))
        assert Counter(n for spans in used.values() for _, n in spans) == Counter(histogram)
        for spans in used.values():
            end = 0
            for at, n in sorted(spans):
                assert at == end
                end += n
            assert end <= 64


def shingles(text, size):
    w = [x.encode() for x in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_near_duplicates(docs, percent, size):
    from cairn.llm import minhash

    sets = {r.doc_id: shingles(r.text, size) for r in docs.collect()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = components(ids, links)
    rows = rows_of(minhash.near_duplicates(docs, percent, size))
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    one = minhash.one_of_each(docs, percent, size)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(label.values()))


def test_links_of_large_groups():
    """Matrix products and pairwise intersections join the same sets."""
    from cairn.llm import minhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - 3 * (i % 40)], rng.integers(0, 1 << 62, 3 * (i % 40)).astype(np.uint64)])) for i in range(700)]
    links = [(a, b) for a in range(700) for b in range(a + 1, 700) if (x := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) * 100 >= 85 * (len(sets[a]) + len(sets[b]) - x)]
    assert components(range(700), links) == components(range(700), minhash.links_among(sets, 85))


def water_level(sizes, weights=(5, 2, 1), most=3):
    """Targets by bisection: each source gets its weight times a level, at most `most` times its size."""
    total, low, high = sum(sizes), 0.0, float(most * sum(sizes) + 1)
    at = lambda level: [min(level * weights[i % len(weights)], most * n) for i, n in enumerate(sizes)]
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle)) < total else (low, middle)
    return at(high)


def test_mixing(docs):
    from cairn.llm import mixing

    sizes, sources = defaultdict(int), {}
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        sources[r.doc_id] = r.source
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water_level([sizes[s] for s in order]), strict=True))
    rows = rows_of(mixing.mix(docs))
    assert len(rows) == docs.count()
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 3
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in order:
        assert abs(taken[s] - want[s]) <= most[s]
    assert Counter(map(str, rows)) == Counter(map(str, rows_of(mixing.mix(docs))))
    remixed = mixing.remix(docs)
    assert remixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in remixed.collect()) == sum(taken.values())


def test_flight_keeps_totals():
    from cairn.llm import mixing

    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 5000, 3000), np.full(3000, 0.37)
    moved = mixing.flight(size, p, (1, 2), False)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert abs((size * (moved - p)).sum()) < 1 and abs((moved - p).sum()) < 1e-3
    landed = mixing.flight(size, p, (1, 2), True)
    assert set(landed) <= {0.0, 1.0} and abs((size * (landed - p)).sum()) <= size.max()


def base_spans(text):
    kinds = [
        ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ]
    out = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(docs):
    from cairn.llm import secrets

    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    rows = rows_of(secrets.scan(docs))
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r["doc_id"]].pop() or ""
        spans = base_spans(text)
        said = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        own = r["spans"].split(",") if r["spans"] else []
        assert [x for x in own if not x.startswith("random")] == said


def test_random_tokens_are_found_and_words_are_not(spark):
    import random
    import string

    from cairn.llm import secrets

    rng = random.Random(1)
    token = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    plain = ["internationalisationalities", "Donaudampfschifffahrtsgesellschaft", "honorificabilitudinitatibus", "this_is_a_plain_variable_name", "http//example/org/some/long/path"]
    rows = [(i, f"text {token(40)} more") for i in range(40)] + [(100 + i, f"text {w} more") for i, w in enumerate(plain)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:5:45" for i in range(40)) >= 38
    assert all(got[100 + i] == "" for i in range(len(plain)))


@pytest.mark.parametrize(("alphabet", "least"), [("a-z0-9", 40), ("A-Z0-9", 40), ("a-z2-7", 48), ("A-Z2-7", 48), ("a-z", 96), ("A-Z", 96), ("a-zA-Z", 24), ("a-zA-Z0-9", 20), ("a-zA-Z0-9+/", 20), ("a-zA-Z0-9_-", 20)])
def test_recall_of_every_alphabet_at_every_length(spark, alphabet, least):
    """A secret is not the less found the longer it is. Below `least` a token of the alphabet is too like text."""
    import random
    import string

    from cairn.llm import secrets

    ranges = {"a-z": string.ascii_lowercase, "A-Z": string.ascii_uppercase, "0-9": string.digits, "2-7": "234567"}
    symbols = "".join(ranges.get(x, x) for x in re.findall(r"\w-\w|.", alphabet))
    rng, rows = random.Random(11), []
    for n in (20, 24, 32, 40, 48, 64, 96, 128, 192, 256):
        rows += [(1000 * n + i, f"text {''.join(rng.choice(symbols) for _ in range(n))} more") for i in range(100) if n >= least]
    got = {r.doc_id: r.spans.split(",") for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(i // 1000 for i, spans in got.items() if f"random:5:{5 + i // 1000}" in spans)
    assert min(found[i // 1000] for i in got) >= 90, found


def test_redaction(odd):
    from cairn.llm import secrets

    before = {r.doc_id: r for r in odd.collect()}
    after = secrets.redact(odd)
    assert after.columns == odd.columns
    for r in after.collect():
        text, at, parts = before[r.doc_id].text, 0, []
        if not base_spans(text) and "[SECRET]" not in (r.text or ""):
            assert r == before[r.doc_id]
            continue
        assert "[SECRET]" in r.text and r.n_chars == len(r.text)
        del at, parts
        assert not [s for s in base_spans(r.text) if s[3] != "assign"]
