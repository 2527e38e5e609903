"""Schemas and table references of SQL texts: statements, columns, keys, reads and writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .extract import per_file

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<string>'(?:''|[^'])*'|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<name>"(?:""|[^"])*"|`[^`]*`|\[[A-Za-z_][^\]]*\]|[A-Za-z_][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>.)""", re.S)
# Words that open a constraint in a list of columns; words that end a type.
CONSTRAINTS = frozenset("primary foreign unique check constraint key index exclude like fulltext".split())
ENDS = frozenset("not null default primary references unique check constraint collate generated auto_increment autoincrement comment identity on".split())


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup if m.lastgroup != "tag" else "string", m[0]) for m in _TOKEN.finditer(text) if m.lastgroup]


def statements(text: str) -> list[list[tuple[str, str]]]:
    """Statements as tokens, parted at semicolons outside of strings, dollar quotes, comments and brackets."""
    out, depth = [[]], 0
    for k, t in tokens(text):
        depth += (t == "(") - (t == ")")
        if t == ";" and depth <= 0:
            out.append([])
            depth = 0
        else:
            out[-1].append((k, t))
    return [s for s in out if s]


def _name(t: str) -> str:
    return t.strip('"`[]')


def _low(s, i) -> str:
    return s[i][1].lower() if i < len(s) else ""


def _qualified(s, i) -> tuple[str, int]:
    """A name and where it ends; of a.b.c the last part counts."""
    name, i = _name(s[i][1]), i + 1
    while _low(s, i) == "." and i + 1 < len(s):
        name, i = _name(s[i + 1][1]), i + 2
    return name, i


def _items(s, i) -> tuple[list[list[tuple[str, str]]], int]:
    """The parts of the bracket that opens at i, parted at its own commas; a bracket that doesn't close ends with the text."""
    out, depth = [[]], 0
    for k in range(i, len(s)):
        t = s[k][1]
        depth += (t == "(") - (t == ")")
        if not depth:
            return [x for x in out if x], k + 1
        if depth == 1 and t == ",":
            out.append([])
        elif k > i:
            out[-1].append(s[k])
    return [x for x in out if x], len(s)


def _column(item) -> tuple[dict, tuple[str, str, str] | None]:
    """A column, and the key it holds: column, table and column referred to (or none, for its primary key)."""
    kind, k, depth = [], 1, 0
    while k < len(item) and (depth or _low(item, k) not in ENDS):
        depth += (item[k][1] == "(") - (item[k][1] == ")")
        kind.append(item[k][1])
        k += 1
    rest = [t.lower() for _, t in item[k:]]
    text = " " + " ".join(rest) + " "
    found = {"name": _name(item[0][1]), "type": re.sub(r"\s*([(),])\s*", r"\1", " ".join(kind)) or None, "nullable": " not null " not in text and " primary key " not in text, "primary": " primary key " in text}
    key = None
    if "references" in rest:
        at = k + rest.index("references") + 1
        if at < len(item):
            table, at = _qualified(item, at)
            column = _name(item[at + 1][1]) if _low(item, at) == "(" and at + 1 < len(item) else None
            key = (found["name"], table, column)
    return found, key


def schema(text: str) -> dict[str, dict]:
    """Tables after all statements in order: a second CREATE replaces the first, an ALTER of an unknown table is passed over."""
    tables: dict[str, dict] = {}
    shaped = False
    for s in statements(text):
        words = [t.lower() for _, t in s]
        while "create" in words[1:] and words[0] not in ("create", "alter", "drop", "insert", "select", "with", "update", "delete"):
            s = s[words.index("create", 1) :]
            words = [t.lower() for _, t in s]
        if words[0] == "create" and "table" in words[:5]:
            shaped = True
            i = words.index("table") + 1
            if words[i : i + 3] == ["if", "not", "exists"]:
                i += 3
            if i >= len(s):
                continue
            name, i = _qualified(s, i)
            if _low(s, i) != "(":
                continue
            table = {"columns": {}, "keys": []}
            for item in _items(s, i)[0]:
                _add(table, item)
            if table["columns"]:
                tables[name] = table
        elif words[:2] == ["alter", "table"]:
            i = 2
            while _low(s, i) in ("if", "exists", "only"):
                i += 1
            if i >= len(s):
                continue
            name, i = _qualified(s, i)
            if name in tables:
                _alter(tables, name, s[i:])
        elif words[:2] == ["drop", "table"]:
            i = 4 if words[2:4] == ["if", "exists"] else 2
            if i < len(s):
                tables.pop(_qualified(s, i)[0], None)
    if shaped and not tables:
        raise ValueError("no table could be read")
    return tables


def _add(table, item) -> None:
    first = _low(item, 0)
    if item[0][1][0] not in '"`[' and first in CONSTRAINTS:
        words = [t.lower() for _, t in item]
        if "foreign" in words and "references" in words:
            own = [_name(x[0][1]) for x in _items(item, words.index("("))[0]]
            other, at = _qualified(item, words.index("references") + 1)
            named = [_name(x[0][1]) for x in _items(item, at)[0]] if _low(item, at) == "(" else [None] * len(own)
            table["keys"] += [(c, other, r) for c, r in zip(own, named, strict=False)]
        elif "primary" in words and "(" in words:
            for x in _items(item, words.index("("))[0]:
                if c := table["columns"].get(_name(x[0][1])):
                    c["primary"], c["nullable"] = True, False
        return
    column, key = _column(item)
    table["columns"][column["name"]] = column
    if key:
        table["keys"].append(key)


def _alter(tables, name, s) -> None:
    table = tables[name]
    for item in _items([("mark", "("), *s, ("mark", ")")], 0)[0]:
        words = [t.lower() for _, t in item]
        i = 1 + (words[1:2] == ["column"])
        if words[0] == "add":
            i += 3 if words[i : i + 3] == ["if", "not", "exists"] else 0
            if i < len(item):
                _add(table, item[i:])
        elif words[0] == "drop" and i < len(item) and words[1] not in ("constraint", "primary", "foreign", "index"):
            i += 2 if words[i : i + 2] == ["if", "exists"] else 0
            gone = _name(item[i][1])
            table["columns"].pop(gone, None)
            table["keys"] = [k for k in table["keys"] if k[0] != gone]
        elif words[0] == "rename" and words[1] == "to":
            tables[_name(item[2][1])] = tables.pop(name)
        elif words[0] == "rename" and "to" in words and i < len(item):
            old, new = _name(item[i][1]), _name(item[words.index("to") + 1][1])
            table["columns"] = {(new if c == old else c): ({**v, "name": new} if c == old else v) for c, v in table["columns"].items()}
            table["keys"] = [(new if k[0] == old else k[0], *k[1:]) for k in table["keys"]]


def references(text: str) -> list[tuple[str, str]]:
    """table, access of a statement, each once: what INSERT, UPDATE, DELETE and MERGE name is written, all that FROM, JOIN and USING name is read; names of common tables are neither."""
    found: dict[tuple[str, str], None] = {}
    for s in statements(text):
        common = {_name(s[k][1]).lower() for k in range(len(s) - 2) if s[k][0] == "name" and _low(s, k + 1) == "as" and _low(s, k + 2) == "(" and (_low(s, k - 1) in ("with", "recursive", ","))} if _low(s, 0) == "with" else set()
        depth, lists, plain = 0, {}, {}  # plain: is the bracket open at a depth one of a function that takes FROM as an argument
        for i, (_, t) in enumerate(s):
            w = t.lower()
            depth += (t == "(") - (t == ")")
            if t == "(":
                lists[depth], plain[depth] = False, _low(s, i - 1) in ("extract", "substring", "trim", "overlay", "position")
            access = None
            if w in ("into", "update") and not (w == "update" and _low(s, i - 1) in ("for", "do", "on")) or w == "from" and _low(s, i - 1) == "delete":
                access = "Write"
            elif w in ("from", "join", "using") and not (depth and plain.get(depth)):
                access = "Read"
                lists[depth] = lists.get(depth) or w == "from"
            elif w in ("where", "group", "order", "having", "limit", "set", "union", "select"):
                lists[depth] = False
            elif t == "," and lists.get(depth):
                access = "Read"
            j = i + 1 + (_low(s, i + 1) in ("only", "lateral", "table"))
            if access and j < len(s) and s[j][0] == "name" and _low(s, j) not in ("select", "values", "set"):
                name, end = _qualified(s, j)
                if name.lower() not in common and not (access == "Read" and _low(s, end) == "("):
                    found[name, access] = None
    return list(found)


COLUMNS = "table string, column string, sql_type string, nullable boolean, primary_key boolean, ref_table string, ref_column string"


def _rows(path: str, text: str) -> list[tuple]:
    rows = []
    for name, t in schema(text).items():
        keys = {k[0]: k[1:] for k in t["keys"]}
        rows += [(name, c["name"], c["type"], c["nullable"], c["primary"], *keys.get(c["name"], (None, None))) for c in t["columns"].values()]
    return rows


def columns(files: DataFrame) -> DataFrame:
    """file, error and the columns of the tables that each SQL file leaves behind, with the key a column holds."""
    return per_file(files, _rows, COLUMNS)


def table_references(files: DataFrame) -> DataFrame:
    """file, error, table, access of SQL texts."""
    return per_file(files, lambda path, text: references(text), "table string, access string")
