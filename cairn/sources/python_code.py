"""Facts of Python sources, by the standard library's parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .extract import CODE, per_file

# Verbs of route decorators and of HTTP clients, names of clients, root types.
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
CLIENTS = ("requests", "httpx", "session", "client", "aiohttp")
ROOTS = ("Query", "Mutation", "Subscription")
#: Characters of a file that are parsed at once, about: the tree of a file takes a hundred times its text.
PIECE = 1 << 17
#: A line that begins a statement of its own, whatever stands before.
_START = re.compile(r"^(?:def|class|async|@)", re.M)
_NEWLINE = re.compile(r"\r\n|\r|\n")
_SQL = re.compile(r"^\s*(select\b.*\bfrom\b|insert\s+into\b|update\b.*\bset\b|delete\s+from\b|merge\s+into\b|with\b.*\bselect\b)", re.I | re.S)


def looks_like_sql(text: str) -> bool:
    return bool(_SQL.search(text))


def _literal(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _url(node) -> tuple[str, str] | None:
    """A URL argument and its shape: literal, or template with {} for what is interpolated."""
    if (text := _literal(node)) is not None:
        return text, "Literal"
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{}" for v in node.values), "Template"
    return None


def _dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := _dotted(node.value)):
        return f"{left}.{node.attr}"
    return None


def django_path(text: str) -> str:
    """One leading slash and no trailing one; the bare root stays a slash."""
    return "/" + text.strip("^$").strip("/")


class _Walk(ast.NodeVisitor):
    def __init__(self, before: int = 0):
        self.before, self.rows, self.stack, self.classes = before, [], [], []

    @property
    def here(self) -> str:
        return ".".join(self.stack) or "<module>"

    def add(self, record, node, kind=None, name=None, fqn=None, value=None, owner=None):
        self.rows.append((record, kind, name, fqn, owner if owner is not None else self.here, value, node.lineno + self.before, getattr(node, "end_lineno", node.lineno) + self.before, node.col_offset))

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", node, "module", a.asname or a.name, value=a.name)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", node, "name", a.asname or a.name, fqn=a.name, value=module)

    def visit_ClassDef(self, node):
        fqn = ".".join([*self.stack, node.name])
        self.add("symbol", node, "Class", node.name, fqn, ast.get_docstring(node))
        for statement in node.body:
            if isinstance(statement, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in statement.targets) and (table := _literal(statement.value)):
                self.add("orm", statement, "table", node.name, fqn, table, owner=fqn)
            if isinstance(statement, ast.ClassDef) and statement.name == "Meta":
                for inner in statement.body:
                    if isinstance(inner, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "db_table" for t in inner.targets) and (table := _literal(inner.value)):
                        self.add("orm", inner, "table", node.name, fqn, table, owner=fqn)
        self._inside(node, node.name)

    def _inside(self, node, name):
        for d in node.decorator_list:
            self.visit(d)
        self.stack.append(name)
        self.classes.append(name if isinstance(node, ast.ClassDef) else None)
        for child in node.body:
            self.visit(child)
        self.stack.pop()
        self.classes.pop()

    def visit_FunctionDef(self, node):
        fqn, owner = ".".join([*self.stack, node.name]), self.classes[-1] if self.classes else None
        self.add("symbol", node, "Method" if owner else "Function", node.name, fqn, ast.get_docstring(node))
        for d in node.decorator_list:
            self._decorated(node, d, fqn)
        if owner in ROOTS and node.name.startswith("resolve_"):
            self.add("resolver", node, "graphene", node.name, fqn, f"{owner}.{_camel(node.name[8:])}")
        self._inside(node, node.name)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _decorated(self, node, d, fqn):
        called = d.func if isinstance(d, ast.Call) else d
        attribute, left = (called.attr, _dotted(called.value)) if isinstance(called, ast.Attribute) else (None, None)
        first = _literal(d.args[0]) if isinstance(d, ast.Call) and d.args else None
        if first is not None and attribute in VERBS:
            self.add("route", d, attribute.upper(), node.name, fqn, first)
        if first is not None and attribute == "route":
            listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
            methods = [m for e in listed.elts if (m := _literal(e))] if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else ["GET"]
            for m in methods:
                self.add("route", d, m.upper(), node.name, fqn, first)
        if first is not None and attribute == "field" and left:
            self.add("resolver", d, "ariadne", node.name, fqn, f"{left[:1].upper()}{left[1:]}.{first}")
        if (_dotted(called) or "") in ("strawberry.field", "strawberry.mutation", "strawberry.subscription") and self.classes and self.classes[-1] in ROOTS:
            self.add("resolver", d, "strawberry", node.name, fqn, f"{self.classes[-1]}.{_camel(node.name)}")

    def visit_Call(self, node):
        f = node.func
        name, left = (f.id, None) if isinstance(f, ast.Name) else (f.attr, _dotted(f.value) or "<expression>") if isinstance(f, ast.Attribute) else (None, None)
        if name:
            self.add("call", node, "member" if left else "bare", name, value=left)
        arguments = node.args
        if name in ("path", "re_path", "url") and left is None and len(arguments) > 1 and (text := _literal(arguments[0])) is not None:
            self.add("route", node, "<ANY>", (_dotted(arguments[1]) or "").split(".")[-1] or None, value=django_path(text))
        if left and left.split(".")[-1].lower() in CLIENTS:
            if name in VERBS and arguments and (url := _url(arguments[0])):
                self.add("http", node, name.upper(), url[1], value=url[0])
            if name == "request" and len(arguments) > 1 and (method := _literal(arguments[0])) and (url := _url(arguments[1])):
                self.add("http", node, method.upper(), url[1], value=url[0])
        self.generic_visit(node)

    def visit_Constant(self, node):
        if isinstance(node.value, str) and looks_like_sql(node.value):
            self.add("sql", node, value=node.value)

    def visit_JoinedStr(self, node):  # interpolated statements are not known
        for v in node.values:
            if isinstance(v, ast.FormattedValue):
                self.visit(v.value)


def _camel(name: str) -> str:
    first, *more = name.split("_")
    return first + "".join(m[:1].upper() + m[1:] for m in more)


def trees(text: str) -> Iterator[tuple[ast.Module, int]]:
    """The file as trees of whole statements, each with the lines before it. A start of the text that parses alone, before a line that can only begin a statement, is those statements in the whole as well; where it doesn't parse, it is tried longer."""
    at = before = 0
    while True:
        size = PIECE
        while True:
            start = _START.search(text, at + size)
            end = start.start() if start else len(text)
            try:
                tree = ast.parse(text[at:end])
                break
            except SyntaxError as e:
                if end == len(text):
                    raise ValueError(f"{e.msg} (<unknown>, line {e.lineno + before})" if e.lineno else str(e)) from e
                size = 2 * (end - at)
        yield tree, before
        before += len(_NEWLINE.findall(text, at, end))
        at = end
        if at >= len(text):
            return


def rows(path: str, text: str) -> Iterator[tuple]:
    for tree, before in trees(text):
        walk = _Walk(before)
        walk.visit(tree)
        yield from walk.rows


def parse(path: str, text: str) -> list[tuple]:
    return list(rows(path, text))


def facts(files: DataFrame) -> DataFrame:
    """file, error and the facts of Python files; a file that doesn't parse is one row with its error. A symbol's value is its docstring, a call's its receiver, an import's its module, a route's its path."""
    return per_file(files, rows, CODE)
