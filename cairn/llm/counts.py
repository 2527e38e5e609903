"""Edit-aware token counts: per document a segment tree over blocks of pre-tokens.

A block is a run of chunks with the white space after them, so that no token
reaches over its end. Leaves hold a block's bytes and tokens, inner nodes their
sums. An edit finds its blocks by descending on bytes, encodes anew only them and,
where the text no longer ends in white space there, the block after; then sums on
the way up are updated.

Places of edits are bytes of the UTF-8 text as it is when the edit is applied.
Nulls: a null text is an empty one, null edits are none. Repeated rows: each is
counted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import tokens
from .common import byte_views, ending, id_and_text

#: Bytes of a block, about.
BLOCK = 512
_CUT = re.compile(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+")


class CountTree:
    """Token count of a text under edits."""

    def __init__(self, text: bytes, table: tokens.ChunkIds):
        self.table, self.encoded = table, 0
        self.blocks: list[bytes] = []
        at = 0
        while at < len(text):
            m = _CUT.match(text, min(at + BLOCK, len(text)))
            end = m.end() if m else len(text)
            self.blocks.append(text[at:end])
            at = end
        self.leaves = 1
        while self.leaves < max(1, len(self.blocks)):
            self.leaves *= 2
        self.bytes, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, block in enumerate(self.blocks):
            self.bytes[self.leaves + i], self.tokens[self.leaves + i] = len(block), self.count(block)
        for i in range(self.leaves - 1, 0, -1):
            self.bytes[i], self.tokens[i] = self.bytes[2 * i] + self.bytes[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def count(self, block: bytes) -> int:
        self.encoded += len(block)
        return len(tokens.encode(block, self.table)) // 4

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> bytes:
        return b"".join(self.blocks)

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds byte `at`, and the place in it."""
        i = 1
        while i < self.leaves:
            i *= 2
            if at >= self.bytes[i] and self.bytes[i + 1]:
                at -= self.bytes[i]
                i += 1
        return i - self.leaves, at

    def put(self, k: int, block: bytes) -> None:
        self.blocks[k] = block
        i = self.leaves + k
        self.bytes[i], self.tokens[i] = len(block), self.count(block)
        i //= 2
        while i:
            self.bytes[i], self.tokens[i] = self.bytes[2 * i] + self.bytes[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def edit(self, start: int, end: int, new: bytes = b"") -> None:
        """Replace the bytes start..end (exclusive)."""
        if not self.blocks:
            self.blocks = [b""]
        first, a = self.find(start)
        last, b = self.find(end)
        content = self.blocks[first][:a] + new + self.blocks[last][b:]
        for k in range(first + 1, last + 1):
            if self.blocks[k]:
                self.put(k, b"")
        k = last + 1
        while content and not content[-1:].isspace() and k < len(self.blocks):
            if self.blocks[k]:
                content += self.blocks[k]
                self.put(k, b"")
            k += 1
        if not self.blocks[first][:a] and content and first:
            # what stands before ends in white space, unless it is the last block of a text without it at the end
            before = next((k for k in range(first - 1, -1, -1) if self.blocks[k]), None)
            if before is not None and not self.blocks[before][-1:].isspace():
                content, first = self.blocks[before] + content, before
        self.put(first, content)


def repeated_lines(text: bytes) -> list[tuple[int, int]]:
    """Places of the lines with a word that equal an earlier line, with their line ends, last first."""
    seen, at, out = set(), 0, []
    for line in text.split(b"\n"):
        end = at + len(line)
        if line.split():
            if line in seen:
                out.append((max(at - 1, 0), end))
            seen.add(line)
        at = end + 1
    return out[::-1]


def after_line_dedup(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_bytes_encoded: counts before and after repeated lines are cut out, the second from the first's tree."""
    path = path or tokens.default_path()

    def run(batches):
        import pyarrow as pa

        table = tokens.chunk_ids(path)
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            rows = []
            for i in range(batch.num_rows):
                text = bytes(data[offsets[i] : offsets[i + 1]])
                tree = CountTree(text, table)
                before, tree.encoded = tree.total, 0
                edits = repeated_lines(text)
                for start, end in edits:
                    tree.edit(start, end)
                rows.append((before, len(edits), tree.total, tree.encoded))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_bytes_encoded"])

    return id_and_text(docs).mapInArrow(ending(run, tokens.forget), "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_bytes_encoded long")
