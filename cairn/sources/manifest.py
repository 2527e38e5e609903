"""Manifests of an estate and aliases of a project: small files that the driver reads."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

_SLUG = re.compile(r"[a-z0-9-]+")


def parse(text: str) -> list[dict]:
    """Members (name, path, api) of a manifest with a `repos` list. Names and paths must be their own, names and api ids slugs."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(str(e)) from e
    found, names, paths = [], set(), set()
    for r in doc.get("repos", []):
        name, path = r.get("name"), r.get("path")
        if not name or not path:
            raise ValueError("a member needs a name and a path")
        path = re.sub(r"^(\./)+", "", path).rstrip("/") or "."
        if not _SLUG.fullmatch(name) or r.get("api") and not _SLUG.fullmatch(r["api"]):
            raise ValueError(f"{name!r} or its api is no slug")
        if name in names or path in paths:
            raise ValueError(f"{name!r} or its path comes twice")
        names.add(name)
        paths.add(path)
        found.append({"name": name, "path": path, "api": r.get("api") or name})
    return found


def members(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(k, m["name"], m["path"], m["api"]) for k, m in enumerate(parse(text))], "ord int, name string, path string, api string")


def aliases(text: str) -> list[tuple[str, str]]:
    """pattern, target of a project's path aliases, targets below its base folder; comments and commas at ends are passed over."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)
    options = json.loads(bare).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    return [(p, "/".join(x for x in (base, t.removeprefix("./")) if x)) for p, targets in options.get("paths", {}).items() for t in targets]
