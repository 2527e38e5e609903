"""Token ids of the word-end BPE file, by chunk of text between white space.

The tokenizer drops white space and never looks across it, so a text's ids are
the ids of its chunks joined. Chunks repeat, so each worker keeps a bounded table
of chunk -> ids. A chunk of ASCII and Latin-1 goes through the same merges by
tiktoken's engine (a word end is the byte FF, which UTF-8 never holds); any other
chunk, and any chunk that holds a special token's start, goes to the tokenizers
library itself.
"""

from __future__ import annotations

import json
from array import array

DEFAULT_FILE = "word_bpe_49k.json"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries that a worker keeps at most; the table starts anew beyond it.
TABLE = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkIds(dict):
    """bytes of a chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, table: int = TABLE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.table, self.whole = table, Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        to_byte = _byte_alphabet()
        ranks = {}
        for token, i in model["vocab"].items():
            if token.startswith("<|") and token.endswith("|>"):
                continue
            stem, end = (token[:-4], b"\xff") if token.endswith("</w>") and len(token) > 4 else (token, b"")
            ranks[bytes(to_byte[c] for c in stem) + end] = i
        self.free = max(model["vocab"].values()) + 1
        # a byte that has no token of its own still needs a rank; no text can end in it
        for b in range(256):
            ranks.setdefault(bytes([b]), self.free + 1 + b)
        self.engine = tiktoken.Encoding("chunk", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.merge = self.engine._core_bpe.encode_single_piece
        self.pieces = regex.compile(PIECES).findall
        # the first merge of a piece has to be the one with its word end
        ends = [ranks[bytes([b, 255])] for b in range(256) if bytes([b, 255]) in ranks]
        self.fast = bool(ends) and max(ends) < min(i for t, i in ranks.items() if len(t) > 2 or (len(t) == 2 and t[1] != 255))

    def merged(self, piece: str) -> bytes:
        """Ids of one lower-case pre-token."""
        ids = self.merge(piece.encode() + b"\xff")
        if max(ids) >= self.free:
            return self.slow(piece)
        return array("I", ids).tobytes()

    def slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def find(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if not self.fast or "<|" in text or max(text) > "\xff":
            return self.slow(text)
        text = text.lower()
        if text.isalpha():
            return self.merged(text)
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self[text[:-1].encode()] + self[text[-1].encode()]
        pieces = self.pieces(text)
        return self.merged(text) if pieces == [text] else b"".join([self[p.encode()] for p in pieces])

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.find(chunk)
        if len(self) >= self.table:
            self.clear()
        self[chunk] = found
        return found


_TABLES: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One table per worker and file."""
    if path not in _TABLES:
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]


def forget() -> None:
    """Empty the worker's tables of chunks; the vocabularies stay."""
    for table in _TABLES.values():
        table.clear()


def encode(text: bytes, table: ChunkIds) -> bytes:
    """A text of Latin-1 without special tokens is lower-cased at once, so that fewer chunks differ."""
    if b"<|" not in text:
        try:
            whole = text.decode("utf-8", "replace")
            whole.encode("latin-1")
            text = whole.lower().encode()
        except UnicodeEncodeError:
            pass
    return b"".join(map(table.__getitem__, text.split()))
