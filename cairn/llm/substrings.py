"""Exact removal of repeated strings of 100 bytes, by suffix arrays of shards.

A shard is some whole texts of one input partition (a text longer than a shard is
cut into pieces that overlap by 99 bytes, so that each string lies in one of them). Its
suffixes are sorted by Larsson-Sadakane refinement: suffixes that still tie are
sorted again by the rank of what follows, at doubled depth. Kasai's common
prefixes of sorted neighbours tell which strings of 100 bytes are equal. (Kasai's
step, that a suffix shares at most one byte less than the suffix before it in the
text, holds with equality unless the bytes before differ; so only those exceptions
are compared byte by byte and the rest follow from them in one pass. Neighbours
that sorting told apart within 100 bytes need no prefix.)

Across shards, what stays of each shard, its distinct strings, is merged by
binary search. Equal strings must meet for that: the least hash of the 32-byte
strings within a string (its anchor) depends on the string alone, so strings are
dealt by their anchor, neighbours with one anchor as one segment. Anchors that
occur once in all shards are left out before any text is moved. In a task, the sorted
runs of two shards at a time are merged by binary search of one in the other. An
anchor with more than HOT segments is split: its strings are dealt one by one, by
their own content, so that no text however common makes one large task.

A string counts as repeated if it starts earlier in a smaller doc_id or earlier in
the same document; strings are judged on the input, and overlapping ones count.
Nulls: a null text is empty. Rows with a null doc_id are compared too, after all
ids below 2^62, in the order of a hash of their texts; those of one text are rows of
one document. Texts under 100 bytes stay. Repeated rows are one document and each is
returned; rows of one doc_id with other texts are documents of their own, in the order
of a hash of the text. Empty table: no rows. Other columns are left out. Places
are 64-bit, so a text has no greatest length.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, drop, in_order, settle

LENGTH, GRAM = 100, 32
#: Bytes of a shard at most; places and ranks within one then fit a word together.
SHARD = 2 << 20
#: Segments of one anchor beyond which its strings are dealt one by one; segments merged at a time, about.
HOT, AT_ONCE = 4096, 16_000

_M = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)]


def words_at(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number, zeros beyond the end; one more place than x has."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(x) + 1, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def _way(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and the keys in it. Places are packed beside keys where both fit a word: plain sorts are far faster than those of places."""
    beside = len(key).bit_length()
    if bits + beside <= 64:
        both = np.sort((key << np.uint64(beside)) | np.arange(len(key), dtype=np.uint64))
        return (both & np.uint64((1 << beside) - 1)).astype(np.int64), both >> np.uint64(beside)
    way = np.argsort(key)
    return way, key[way]


def _grams(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The numbers, in order, of the short strings at every place and, as zeros, beyond the end; bits of a number; bytes of a string."""
    # letters are numbered from 1, 0 is beyond the end; of the strings of a few letters few occur, so that their numbers are short
    letters = np.bincount(x, minlength=256) > 0
    bits = int(letters.sum()).bit_length()
    size = min(21 // bits, 64)
    code = np.concatenate([np.cumsum(letters).astype(np.uint32)[x], np.zeros(64 + size, np.uint32)])
    gram = np.zeros(len(code) - size + 1, np.uint32)
    for k in range(size):
        gram = (gram << np.uint32(bits)) | code[k : k + len(gram)]
    found = np.zeros(1 << (bits * size), bool)
    found[gram] = True
    number = np.cumsum(found, dtype=np.uint32) - np.uint32(1)
    return number[gram].astype(np.uint64), max(1, int(number[-1]).bit_length()), size


def refined(x: np.ndarray, length: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of all suffixes in order, beyond the end counts as least; the places there of those that agree with the one before in some bytes; and how many bytes, at most `length`."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    # first by as many bytes as fit
    gram, bits, size = _grams(x)
    pieces = max(1, min((64 - n.bit_length()) // bits, 64 // size))
    key, depth = np.zeros(n, np.uint64), pieces * size
    for k in range(pieces):
        key = (key << np.uint64(bits)) | gram[k * size : k * size + n]
    order, key = _way(key, bits * pieces)
    # ranks are read at random: as small numbers more of them are near
    rank, tied = np.empty(n, np.int32 if n < 1 << 31 else np.int64), np.arange(n)
    suffix, close, agree = order, tied[1:], 0
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        if depth <= length:
            close, agree = tied[~head], depth
        begin = np.nonzero(head)[0]
        rank[suffix] = np.repeat(tied[begin], np.diff(np.append(begin, len(tied))))
        again = ~head | np.append(~head[1:], False)
        tied = tied[again]
        if not len(tied):
            return order, close, agree
        suffix, group = order[tied], np.cumsum(head[again]) - 1
        after = suffix + depth
        follows = rank[np.minimum(after, n - 1)] + np.int64(depth + 1)
        beyond = np.nonzero(after >= n)[0]
        follows[beyond] = n - suffix[beyond]
        wide = (n + depth + 1).bit_length()
        way, key = _way((group.astype(np.uint64) << np.uint64(wide)) | follows.astype(np.uint64), int(group[-1]).bit_length() + wide)
        suffix = suffix[way]
        order[tied] = suffix
        depth *= 2


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; beyond the end counts as least."""
    return refined(x)[0]


def _agree(x: np.ndarray, a: int, b: int, done: int) -> int:
    most, step = len(x) - max(a, b), 1024
    while done < most:
        upto = min(done + step, most)
        differ = x[a + done : a + upto] != x[b + done : b + upto]
        if differ.any():
            return done + int(differ.argmax())
        done, step = upto, min(2 * step, 1 << 20)
    return most


def prefixes_at(x: np.ndarray, order: np.ndarray, close: np.ndarray, agree: int) -> np.ndarray:
    """How many bytes the suffixes at the places `close` of the order share with the one before. All that share `agree` bytes are there, and no others."""
    n, word = len(x), words_at(x)
    way = np.argsort(order[close])
    place = close[way]
    a, b = order[place], order[place - 1]
    # its value is that of the suffix one place earlier in the text, less one
    follows = np.concatenate([[False], (np.diff(a) == 1) & (np.diff(b) == 1) & (x[a[:-1]] == x[b[:-1]])])[: len(a)]
    own = np.nonzero(~follows)[0]
    a, b = a[own], b[own]
    shared = np.full(len(own), agree)
    active = np.arange(len(own))
    while len(active) > 200:
        p, q = a[active] + shared[active], b[active] + shared[active]
        d = word[np.minimum(p, n)] ^ word[np.minimum(q, n)]
        same = np.full(len(d), 8)
        some = np.nonzero(d)[0]
        same[some] = sum((d[some] < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        shared[active] += same
        active = active[(same == 8) & (np.maximum(p, q) + 8 < n)]
    for k in active.tolist():
        shared[k] = _agree(x, int(a[k]), int(b[k]), int(shared[k]))
    shared = np.minimum(shared, n - np.maximum(a, b))
    times = np.diff(np.append(own, len(way)))
    out = np.empty(len(way), np.int64)
    out[way] = np.repeat(shared + own, times) - np.arange(len(way))
    return out


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix, in order, shares with the one before it."""
    return np.concatenate([[0], prefixes_at(x, order, np.arange(1, len(x)), 0)])[: len(x)].astype(np.int64)


def repeats(x: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of the valid starts, those of strings that start earlier in x as well."""
    order, close, agree = refined(x, length)
    near = np.zeros(len(x), bool)
    near[close[prefixes_at(x, order, close, agree) >= length]] = True
    met = np.nonzero(near | np.append(near[1:], False)[: len(near)])[0]
    start, group = order[met], np.cumsum(~near[met])
    usable = valid[start]
    key = np.sort((group[usable] << 32) | start[usable])
    later = np.zeros(len(x), bool)
    again = np.concatenate([[False], (key[1:] >> 32) == (key[:-1] >> 32)])[: len(key)]
    later[key[again] & 0xFFFFFFFF] = True
    return later


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M[3]
    h = (h ^ (h >> np.uint64(29))) * _M[4]
    return h ^ (h >> np.uint64(32))


def gram_hashes(x: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of all strings of `size` (a power of two) bytes."""
    with np.errstate(over="ignore"):
        h = _final(x.astype(np.uint64) + _M[5])
        step, k = 1, 0
        while step < size:
            h = h[:-step] * _M[k % 3] + (h[step:] ^ (h[step:] >> np.uint64(29)))
            step, k = 2 * step, k + 1
        return _final(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width`."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def segments(x: np.ndarray, kept: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Stretches of kept starts with one anchor: anchor's hash, first start, number of strings, anchor's place from the first start. x: at most 2^28 bytes."""
    if len(x) < length:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(x, gram)
    low = np.uint64((1 << 28) - 1)
    least = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = np.nonzero(kept[: len(least)])[0]
    anchor = (least[at] & low).astype(np.int64)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)])[: len(at)]
    begin = np.nonzero(new)[0]
    first, anchor = at[begin], anchor[begin]
    return h[anchor].view(np.int64), first, np.diff(np.append(begin, len(at))), anchor - first


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def in_stretches(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first start, number of starts that follow one another there."""
    way = np.lexsort((start, key))
    key, start = key[way], start[way]
    begin = np.nonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(start) != 1)])[: len(key)])[0]
    return key[begin], start[begin], np.diff(np.append(begin, len(key)))


def shards(texts: DataFrame, length: int = LENGTH, size: int = SHARD) -> DataFrame:
    """anchor, key, at, n, shard. With an anchor: a segment of strings the shard has not had before; at is start * 2^14 + strings * 2^7 + anchor's place. Without: n strings from the start `at` on, which the shard had before."""
    names = ["anchor", "key", "at", "n", "shard"]

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId() << 32, 0

        def done(pieces):
            pieces.sort(key=lambda p: p[:2])
            pieces = [p for k, p in enumerate(pieces) if not k or p[:2] != pieces[k - 1][:2]]
            x = np.concatenate([p[2] for p in pieces])
            base = np.concatenate([[0], np.cumsum([len(p[2]) for p in pieces])])
            valid = np.arange(len(x)) + length <= np.repeat(base[1:], np.diff(base))
            later = repeats(x, valid, length)
            keys, starts = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64) - base[:-1]
            anchor, first, count, place = segments(x, valid & ~later, length)
            begin, n = _stretches(later)
            which, where = np.searchsorted(base, first, "right") - 1, np.searchsorted(base, begin, "right") - 1
            columns = [
                pa.array(np.concatenate([anchor, np.zeros(len(begin), np.int64)]), mask=np.arange(len(anchor) + len(begin)) >= len(anchor)),
                pa.array(np.concatenate([keys[which], keys[where]])),
                pa.array(np.concatenate([((starts[which] + first) << 14) + (count << 7) + place, starts[where] + begin])),
                pa.array(np.concatenate([np.zeros(len(anchor), np.int64), n])),
                pa.array(np.full(len(anchor) + len(begin), task + made, np.int64)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        pieces, held = [], 0
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            x = np.frombuffer(data, np.uint8) if len(data) else np.zeros(0, np.uint8)
            for i, key in enumerate(batch.column("key").to_pylist()):
                for start in range(0, int(offsets[i + 1] - offsets[i]) - length + 1, size - length + 1):
                    piece = x[offsets[i] + start : min(offsets[i + 1], offsets[i] + start + size)]
                    if held and held + len(piece) > size:
                        yield done(pieces)
                        pieces, held, made = [], 0, made + 1
                    pieces.append((key, start, piece.copy()))
                    held += len(piece)
        if held:
            yield done(pieces)

    return texts.where("text is not null").select("key", "text").mapInArrow(cut, "anchor long, key long, at long, n long, shard long")


def _lists(column, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets, and the fields as flat arrays, of a column of lists of structs; a null list is empty."""
    values = column.flatten()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), [values.field(f).to_numpy(zero_copy_only=False) for f in fields]


class Run:
    """Distinct strings in order, with where each occurred first."""

    def __init__(self, strings: np.ndarray, key: np.ndarray, start: np.ndarray):
        self.strings, self.key, self.start = strings, key, start

    def merge(self, other: Run, later: list) -> Run:
        """Both as one, by binary search of the smaller in the larger; of equal strings the earlier stays, the other goes to `later`."""
        a, b = (self, other) if len(self.strings) >= len(other.strings) else (other, self)
        at = np.searchsorted(a.strings, b.strings)
        met = a.strings[np.minimum(at, len(a.strings) - 1)] == b.strings
        x, y = at[met], np.nonzero(met)[0]
        swap = (b.key[y] < a.key[x]) | ((b.key[y] == a.key[x]) & (b.start[y] < a.start[x]))
        other_place = (b.key[y] != a.key[x]) | (b.start[y] != a.start[x])
        late_key, late_start = np.where(swap, a.key[x], b.key[y]), np.where(swap, a.start[x], b.start[y])
        later.append((late_key[other_place], late_start[other_place]))
        a.key[x[swap]], a.start[x[swap]] = b.key[y[swap]], b.start[y[swap]]
        new = ~met
        return Run(np.insert(a.strings, at[new], b.strings[new]), np.insert(a.key, at[new], b.key[new]), np.insert(a.start, at[new], b.start[new]))


def merged(rows: list[tuple], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, start, strings of segments' strings that occur earlier in another shard's. rows: (anchor, key, start, place, shard, content), whole anchors."""
    # segments that are equal as a whole are merged at once
    whole: dict[tuple, tuple] = {}
    out = []
    for r in rows:
        name = (r[3], r[5])
        first = whole.get(name)
        if first is None:
            whole[name] = r
        elif first[1:3] != r[1:3]:
            if r[1:3] < first[1:3]:
                whole[name], r = r, first
            out.append((r[1], r[2], len(r[5]) - length + 1))
    # a string that two segments share agrees with half of what it has beside the anchor, on one side at least
    half = (length - gram) // 2
    rows = list(whole.values())
    sides = [((r[0], r[5][r[3] - half : r[3]]) if r[3] >= half else None, (r[0], 0, r[5][r[3] + gram : r[3] + gram + half]) if len(r[5]) >= r[3] + gram + half else None) for r in rows]
    times = Counter(s for both in sides for s in both if s is not None)
    rows = [r for r, both in zip(rows, sides, strict=True) if any(s is not None and times[s] > 1 for s in both)]
    found = [tuple(np.array([o[k] for o in out], np.int64) for k in range(3))] if out else []
    if len(rows) > 1:
        rows.sort(key=lambda r: r[4])
        text = b"".join(r[5] for r in rows)
        sizes = np.array([len(r[5]) for r in rows], np.int64)
        base, count = np.cumsum(sizes) - sizes, sizes - length + 1
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        strings = np.ndarray((len(text) - length + 1,), f"S{length}", text, 0, (1,))[np.repeat(base, count) + inner]
        key = np.repeat(np.array([r[1] for r in rows], np.int64), count)
        start = np.repeat(np.array([r[2] for r in rows], np.int64), count) + inner
        shard = np.repeat(np.array([r[4] for r in rows], np.int64), count)
        cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(shard)]
        later: list = []
        runs = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            way = lo + np.argsort(strings[lo:hi], kind="stable")
            runs.append(Run(strings[way], key[way], start[way]))
        while len(runs) > 1:
            runs = [runs[k].merge(runs[k + 1], later) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        if later:
            found.append(in_stretches(*(np.concatenate([x[k] for x in later]) for k in (0, 1))))
    return found


def repeated(texts: DataFrame, length: int = LENGTH, size: int = SHARD, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """key, start, strings: stretches of starts of strings that occurred earlier; and the tables to drop once they are read. texts: as in_order."""
    found = settle(shards(texts, length, size))
    own = found.where("anchor is null").select("key", F.col("at").alias("start"), F.col("n").alias("strings"))
    some = found.where("anchor is not null").select("anchor", "key", "at", "shard")
    shared = settle(some.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot")))
    asked = settle(some.join(shared, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "shard", "hot")).alias("asked")).withColumnRenamed("key", "of"))
    split = not shared.where("hot").isEmpty()
    rows = texts.where("text is not null").join(asked, texts["key"] == asked["of"]).select("key", "text", "asked")

    def fetch(batches):
        import pyarrow as pa

        names = ["anchor", "key", "start", "place", "shard", "content"]
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            keys, (lists, (anchor, at, shard, common)) = batch.column("key").to_numpy(), _lists(batch.column("asked"), ("anchor", "at", "shard", "hot"))
            for lo in range(0, len(at), 100_000):  # a row may ask for very many
                part = slice(lo, min(len(at), lo + 100_000))
                which = np.searchsorted(lists, np.arange(part.start, part.stop), "right") - 1
                start, count, place, apart = at[part] >> 14, at[part] >> 7 & 127, at[part] & 127, common[part].astype(bool)
                times = np.where(apart, count, 1)
                row = np.repeat(np.arange(len(start)), times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                begin = start[row] + nth
                from_ = offsets[which[row]] + begin
                upto = from_ + np.where(apart[row], length, count[row] + length - 1)
                contents = [bytes(data[x:y]) for x, y in zip(from_.tolist(), upto.tolist(), strict=True)]
                columns = [anchor[part][row], keys[which[row]], begin, np.where(apart[row], -1, place[row]), shard[part][row]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(contents, pa.binary())], names=names)

    pieces = rows.mapInArrow(fetch, "anchor long, key long, start long, place long, shard long, content binary")
    pieces = settle(pieces) if split else pieces
    cold = pieces.where("place >= 0").repartition("anchor").sortWithinPartitions("anchor")

    def judge(batches):
        import pyarrow as pa

        def done(held):
            for columns in merged(held, length):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "strings"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "start", "place", "shard", "content")), strict=True):
                if len(held) >= AT_ONCE and held[-1][0] != row[0]:
                    yield from done(held)
                    held = []
                held.append(row)
        yield from done(held)

    across = settle(cold.mapInArrow(judge, "key long, start long, strings long"))
    if split:
        alone = pieces.where("place < 0").select("content", "key", "start")
        first = alone.groupBy("content").agg(F.min(F.struct("key", "start")).alias("first"))
        more = alone.join(first, "content").where(F.struct("key", "start") != F.col("first")).select("key", "start", F.lit(1).cast("long").alias("strings"))
        more = settle(more)
        drop(pieces, shared, asked)
        return own.unionByName(across).unionByName(more), [found, across, more]
    drop(shared, asked)
    return own.unionByName(across), [found, across]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, size: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = in_order(docs)
    stretches, used = repeated(rows, length, size, hot)
    spans = settle(stretches.groupBy("key").agg(F.collect_list(F.struct("start", "strings")).alias("cut")).withColumnRenamed("key", "of"))
    drop(*used)
    rows = rows.join(spans, rows["key"] == spans["of"], "left").select(F.col("given").alias("doc_id"), "text", "cut")

    def remove(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            lists, (begin, count) = _lists(batch.column("cut"), ("start", "strings"))
            out = []
            for i in range(batch.num_rows):
                text = bytes(data[offsets[i] : offsets[i + 1]])
                start, n = begin[lists[i] : lists[i + 1]], count[lists[i] : lists[i + 1]]
                if not len(start):
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(text), int(gone.sum()), len(_stretches(gone)[0]), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
