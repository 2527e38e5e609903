"""Facts of sources in TypeScript, C# and Rust, from tokens and nested braces.

There is no compiler here: declarations are known by their keywords, methods by
name, parameters and body directly inside of a type, calls by a name before a
bracket. Strings and comments are never taken for code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .extract import CODE, per_file
from .python_code import VERBS, looks_like_sql

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'|(?P<single>'(?:\\.|[^'\\\n])*')|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>::|=>|->|\?\.|.)""",
    re.S,
)
# Keywords before a type, before a function; words that look like calls and aren't.
TYPES = {"ts": {"class": "Class", "interface": "Interface"}, "cs": {"class": "Class", "interface": "Interface", "struct": "Class", "record": "Class", "enum": "Class"}, "rust": {"struct": "Class", "enum": "Class", "trait": "Interface"}}
FUNCTIONS = {"ts": "function", "cs": None, "rust": "fn"}
NOT_CALLS = frozenset("if for while switch catch return match loop function fn typeof sizeof nameof using lock foreach fixed when super constructor await async throw in of else do".split())
EXTENSIONS = {"ts": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "cs": ("cs",), "rust": ("rs",), "py": ("py",)}


def language_of(path: str) -> str | None:
    end = path.rsplit(".", 1)[-1]
    return next((k for k, ends in EXTENSIONS.items() if end in ends), None)


def tokens(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """kind, text, line, column of what is neither space nor comment; a quote that opens a lifetime in Rust is a mark."""
    out, line, start, at = [], 1, 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, t = m.lastgroup, m[0]
        if m["single"] and language == "rust":
            kind, t = "mark", "'"
        if kind == "single":
            kind = "string"
        if kind not in ("space", "comment"):
            out.append((kind, t, line, at - start))
        if "\n" in t:
            line += t.count("\n")
            start = at + t.rindex("\n") + 1
        at += len(t)
    return out


def _closing(ts, i) -> int:
    """Where the bracket that opens at i closes, or the end."""
    pairs, depth = {"(": ")", "<": ">", "{": "}", "[": "]"}, 0
    for k in range(i, len(ts)):
        if ts[k][0] == "mark":
            depth += (ts[k][1] == ts[i][1]) - (ts[k][1] == pairs[ts[i][1]])
            if not depth:
                return k
    return len(ts)


def _unquoted(t: str) -> str:
    return t[1:-1]


def _body(ts, i) -> int | None:
    """Where the body of a function opens whose parameters open at i; None without a body."""
    for k in range(_closing(ts, i) + 1, len(ts)):
        if ts[k][1] == "{":
            return k
        if ts[k][1] in (";", ")", "}", ",") or ts[k][1] == "=":
            return None
    return None


def outline(text: str, language: str) -> list[tuple]:
    ts = tokens(text, language)
    rows, opens, stack = [], {}, []  # opens: token that opens a body -> (name, is it a type)
    word = lambda k: ts[k][1] if 0 <= k < len(ts) else ""
    kind = lambda k: ts[k][0] if 0 <= k < len(ts) else ""

    def here():
        return ".".join(s[0] for s in stack if s[0]) or "<module>"

    def add(record, i, kind_=None, name=None, fqn=None, value=None, end=None):
        rows.append((record, kind_, name, fqn, here(), value, ts[i][2], ts[min(end, len(ts) - 1)][2] if end is not None else ts[i][2], ts[i][3]))

    def declare(i, kind_, name, body, is_type):
        fqn = ".".join([s[0] for s in stack if s[0]] + [name])
        add("symbol", i, kind_, name, fqn, end=_closing(ts, body) if body is not None else i)
        if body is not None:
            opens[body] = (name, is_type)

    declared = set()
    for i, (k, t, _, _) in enumerate(ts):
        if t == "{" and k == "mark":
            stack.append(opens.get(i, (None, False)))
        elif t == "}" and k == "mark" and stack:
            stack.pop()
        elif k == "string":
            if t[0] == "`" and "${" in t:
                continue
            if looks_like_sql(_unquoted(t)):
                add("sql", i, value=_unquoted(t))
        if k != "word":
            continue
        inside = bool(stack) and stack[-1][1]
        if t in TYPES[language] and kind(i + 1) == "word" and word(i - 1) not in (".", ":"):
            body = next((j for j in range(i + 2, len(ts)) if ts[j][1] in "{;"), None)
            declare(i, TYPES[language][t], word(i + 1), body if body is not None and word(body) == "{" else None, True)
            declared.add(i + 1)
            before = i - 1
            while word(before) in ("export", "default", "abstract", "declare"):
                before -= 1
            if language == "ts" and word(before - 4) == "@" and word(before - 3) == "Entity" and kind(before - 1) == "string" and word(before) == ")":
                a = before - 4
                add("orm", a, "table", word(i + 1), word(i + 1), _unquoted(word(before - 1)))
        elif language == "rust" and t == "impl":
            body = next((j for j in range(i, len(ts)) if ts[j][1] in "{;"), len(ts))
            head = [j for j in range(i + 1, body) if kind(j) == "word"]
            named = [j for j in head if word(j) == "for"]
            subject = next((j for j in head if j > (named[0] if named else (_closing(ts, i + 1) if word(i + 1) == "<" else i))), None)
            if subject is not None and body < len(ts):
                opens[body] = (word(subject), True)
        elif (language == "rust" and t == "mod" or language == "cs" and t == "namespace") and kind(i + 1) == "word":
            end = next((j for j in range(i + 1, len(ts)) if ts[j][1] in "{;"), len(ts))
            name = "".join(word(j) for j in range(i + 1, end))
            add("symbol", i, "Module", name, name, end=end)
            if word(end) == "{":
                opens[end] = (None if language == "cs" else name, False)
        elif t == FUNCTIONS[language] and kind(i + 1) == "word":
            bracket = next((j for j in range(i + 2, len(ts)) if word(j) == "("), None)
            if bracket is not None:
                declare(i, "Method" if inside else "Function", word(i + 1), _body(ts, bracket), False)
                declared.add(i + 1)
        elif language == "ts" and t in ("const", "let", "var") and kind(i + 1) == "word" and word(i + 2) == "=":
            j = i + 3 + (word(i + 3) == "async")
            if word(j) == "(" and word(_closing(ts, j) + 1) == "=>":
                body = _closing(ts, j) + 2
                declare(i, "Function", word(i + 1), body if word(body) == "{" else None, False)
        elif language == "ts" and t == "import" or language == "cs" and t == "using" and word(i + 1) not in ("(", "var") or language == "rust" and t == "use":
            end = next((j for j in range(i + 1, len(ts)) if ts[j][1] == ";" or language == "ts" and kind(j) == "string"), len(ts))
            if language == "ts" and kind(end) == "string":
                for j in range(i + 1, end):
                    if kind(j) == "word" and word(j) not in ("from", "as", "type"):
                        add("import", i, "name", word(j), value=_unquoted(word(end)))
                if word(i + 1) != "(" and end == i + 1:
                    add("import", i, "module", None, value=_unquoted(word(end)))
            elif language == "cs":
                add("import", i, "namespace", None, value="".join(word(j) for j in range(i + 1, end)))
            elif language == "rust":
                for used in _uses("".join(" as " if word(j) == "as" else word(j) for j in range(i + 1, end))):
                    add("import", i, "use", used.split("::")[-1], value=used)
        elif word(i + 1) == "(" and t not in NOT_CALLS and i not in declared and word(i - 1) != "@":
            body = _body(ts, i + 1) if inside else None
            if inside and language in ("ts", "cs") and (body is not None or word(_closing(ts, i + 1) + 1) in ("=>", ";", ":")) and word(i - 1) not in (".", "=", "?.", "new"):
                declare(i, "Method", t, body, False)
                continue
            left = word(i - 2) if word(i - 1) in (".", "::", "?.") else None
            add("call", i, "path" if word(i - 1) == "::" else "member" if left else "bare", t, value=left)
            first = word(i + 2) if kind(i + 2) == "string" else None
            if language == "ts" and first:
                if left in ("app", "router", "server", "api") and t in VERBS and first[0] != "`" and word(i + 3) == ",":
                    handler = word(i + 4) if kind(i + 4) == "word" and word(i + 5) in (")", ",") else None
                    add("route", i, t.upper(), handler, value=_unquoted(first))
                elif left in ("axios", "ky", "got") and t in VERBS or left is None and t in ("fetch", "axios", "ky", "got"):
                    named = next((_unquoted(word(j + 2)) for j in range(i, min(_closing(ts, i + 1), len(ts))) if word(j) == "method" and word(j + 1) == ":" and kind(j + 2) == "string"), "GET")
                    add("http", i, (t if left else named).upper(), "Template" if "${" in first else "Literal", value=re.sub(r"\$\{[^}]*\}", "{}", _unquoted(first)))
        if language == "ts" and t == "gql" and kind(i + 1) == "string" and word(i + 1)[0] == "`":
            document = _unquoted(word(i + 1))
            add("gql", i, value="" if "${" in document else document)
    return rows


def _uses(text: str) -> list[str]:
    """Paths that a Rust use names, groups taken apart and renames dropped."""
    text = text.strip()
    if "{" not in text:
        return [text.split(" as ")[0].strip()] if text else []
    head, inner, depth, parts, last = text[: text.index("{")], text[text.index("{") + 1 : text.rindex("}")], 0, [], 0
    for k, c in enumerate(inner):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(inner[last:k])
            last = k + 1
    return [u for p in [*parts, inner[last:]] for u in _uses(head + p.strip()) if p.strip()]


def parse(path: str, text: str) -> list[tuple]:
    language = language_of(path)
    return outline(text, language) if language in TYPES else []


def facts(files: DataFrame) -> DataFrame:
    """file, error and the facts of TypeScript, C# and Rust files, told apart by their extensions."""
    return per_file(files, parse, CODE)
