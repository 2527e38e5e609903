"""Sections, anchors and references of markdown texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scalars

MOST_REFS = 64


def anchors(headings: DataFrame) -> DataFrame:
    """anchor of each heading: its slug, numbered from the second of a file on; `preamble` is taken. headings: path, pos, heading."""
    s = headings.withColumn("slug", scalars.slug("heading"))
    k = F.row_number().over(Window.partitionBy("path", "slug").orderBy("pos")) - F.when(F.col("slug") == "preamble", 0).otherwise(1)
    return s.withColumn("k", k).withColumn("anchor", F.when(F.col("k") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "k"))).drop("k", "slug")


_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_CODE, _LINK, _WORD = re.compile(r"`([^`\n]+)`"), re.compile(r"\[[^\]\n]*\]\(([^)\s]+)"), re.compile(r"[A-Za-z_][\w.:]*")


def parse(text: str) -> list[dict]:
    """Flat sections with their lines (from 1) and at most 64 references each: paths, inline code, tokens of fences."""
    lines = text.split("\n")
    out = [{"heading": "", "start_line": 1, "refs": []}]
    fence = None
    for n, line in enumerate(lines, 1):
        mark = _FENCE.match(line)
        if mark and (fence is None or mark[1].startswith(fence)):
            fence = None if fence else mark[1]
            continue
        refs = out[-1]["refs"]
        if fence:
            refs += [("fence", w) for w in _WORD.findall(line) if len(w) >= 3 and ("." in w or "::" in w)]
            continue
        if head := _HEADING.match(line):
            out.append({"heading": head[2], "start_line": n, "refs": []})
            continue
        refs += [("code", w) for w in _CODE.findall(line) if 3 <= len(w) <= 200]
        refs += [("path", w.split("#")[0]) for w in _LINK.findall(line) if "://" not in w and not w.startswith("#")]
    for k, s in enumerate(out):
        s["end_line"] = out[k + 1]["start_line"] - 1 if k + 1 < len(out) else len(lines)
        s["refs"] = list(dict.fromkeys(s["refs"]))[:MOST_REFS]
    return [s for k, s in enumerate(out) if k or s["end_line"] >= 1 and "".join(lines[: s["end_line"]]).strip()]


def sections(files: DataFrame) -> DataFrame:
    """path, pos, heading, start_line, end_line, refs of files: path, text."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, k, s["heading"], s["start_line"], s["end_line"], [{"form": f, "ref": r} for f, r in s["refs"]]) for p, t in zip(b["path"], b["text"], strict=True) for k, s in enumerate(parse(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "pos", "heading", "start_line", "end_line", "refs"])

    return files.select("path", "text").mapInPandas(run, "path string, pos int, heading string, start_line int, end_line int, refs array<struct<form:string,ref:string>>")
