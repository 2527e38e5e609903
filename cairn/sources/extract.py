"""Extraction: a parser of one file's text as rows of a table, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A fact found in source text. record: symbol, import, call, route, http, resolver, sql, orm.
CODE = "record string, kind string, name string, fqn string, owner string, value string, line int, end_line int, col int"


#: Rows of a table that are handed over at once; those of one file are held together until it is parsed.
ROWS = 10_000


def per_file(files: DataFrame, parse: Callable[[str, str], Iterable[tuple]], fields: str) -> DataFrame:
    """file, error and the fields of every row that parse(path, text) gives. A file that can't be parsed gives one row with its error and no fields, and stops no other file. files: path, text."""
    columns = T.StructType.fromDDL(fields).fieldNames()

    def run(batches):
        import pandas as pd

        frame = lambda rows: pd.DataFrame(rows, columns=["file", "error", *columns], dtype=object)
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    own = [(path, None, *r) for r in parse(path, text or "")]
                except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError) as e:
                    own = [(path, f"{type(e).__name__}: {e}"[:200], *([None] * len(columns)))]
                if len(rows) + len(own) < ROWS:
                    rows += own
                    continue
                for part in (rows, own):
                    for k in range(0, len(part), ROWS):
                        yield frame(part[k : k + ROWS])
                rows, own = [], []
            yield frame(rows)

    return files.select("path", "text").mapInPandas(run, f"file string, error string, {fields}")
