"""Operations of contracts: OpenAPI documents, GraphQL schemas and documents, protocol definitions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from .extract import per_file

#: format, key, method, path, norm_path, operation_id, description
OPERATIONS = "format string, key string, method string, path string, norm_path string, operation_id string, description string"
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
_PLACE = re.compile(r"^(\{[^{}]*\}|:.+|<[^<>]*>)$")


def normal_path(path: str) -> str:
    return "/".join("{}" if _PLACE.match(s) else s for s in path.split("/"))


def detects(text: str) -> str | None:
    """Which contract a text could be, by what it holds; parsing decides."""
    if re.search(r"""^\s*["']?(openapi|swagger)["']?\s*:""", text, re.M) or re.search(r'^\s*\{\s*"(openapi|swagger)"', text):
        return "openapi"
    if re.search(r"(^|;)\s*service\s+\w+\s*\{", text, re.M) and re.search(r"\brpc\b", text):
        return "grpc"
    if re.search(r"^\s*(extend\s+)?(type|schema|interface|input|enum|union|scalar)\b[^\n]*", text, re.M) and "{" in text:
        return "graphql"
    return None


def value_of(text: str):
    """A JSON or YAML text as a value; YAML needs its library."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML can't be read here") from e
    try:
        return yaml.load(text, Loader=_loader(yaml))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _loader(yaml):
    """A safe loader whose short tags, as templates use them, become one-entry maps: !Ref x is {"Ref": x}, !Sub x {"Fn::Sub": x}."""

    class Loader(yaml.SafeLoader):
        pass

    def tagged(loader, suffix, node):
        if isinstance(node, yaml.ScalarNode):
            v = loader.construct_scalar(node)
        elif isinstance(node, yaml.SequenceNode):
            v = loader.construct_sequence(node, deep=True)
        else:
            v = loader.construct_mapping(node, deep=True)
        if suffix == "GetAtt" and isinstance(v, str):
            v = v.split(".", 1)
        return {suffix if suffix in ("Ref", "Condition") else f"Fn::{suffix}": v}

    Loader.add_multi_constructor("!", tagged)
    return Loader


def openapi(path: str, text: str) -> list[tuple]:
    """Paths by methods. The key is the operationId, else the method and the normal path."""
    doc = value_of(text)
    if not isinstance(doc, dict) or not (doc.get("openapi") or doc.get("swagger")):
        raise ValueError("no OpenAPI document")
    rows = []
    for p, item in (doc.get("paths") or {}).items():
        for method in METHODS:
            op = item.get(method) if isinstance(item, dict) else None
            if isinstance(op, dict):
                norm, name = normal_path(p), op.get("operationId")
                rows.append(("OpenApi", name or f"{method.upper()} {norm}", method.upper(), p, norm, name, op.get("description") or op.get("summary")))
    return rows


_GQL = re.compile(r'\s+|,|\ufeff|#[^\n]*|(?P<block>""".*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<spread>\.\.\.)|(?P<name>[_A-Za-z]\w*)|(?P<number>-?\d[\w.+-]*)|(?P<mark>[!$&()\[\]:=@{|}])', re.S)


def _gql_tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _GQL.match(text, at)
        if not m:
            raise ValueError(f"no GraphQL at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    depth = 0
    for _, t in out:
        depth += (t in "{([") - (t in "})]") if len(t) == 1 else 0
        if depth < 0:
            break
    if depth:
        raise ValueError("brackets of the GraphQL text don't match")
    return out


def _skip(ts, i, opens="(", closes=")") -> int:
    """After the bracket at i, if one opens there."""
    if i >= len(ts) or ts[i][1] != opens:
        return i
    depth = 0
    for k in range(i, len(ts)):
        depth += (ts[k][1] == opens) - (ts[k][1] == closes)
        if not depth:
            return k + 1
    return len(ts)


def _directives(ts, i) -> int:
    while i < len(ts) and ts[i][1] == "@":
        i = _skip(ts, i + 2)
    return i


def _fields(ts, i) -> tuple[list[tuple[str, str | None]], int]:
    """Names and descriptions of the fields of the block that opens at i."""
    found, said, end = [], None, _skip(ts, i, "{", "}")
    i += 1
    while i < end - 1:
        kind, t = ts[i]
        if kind in ("block", "string"):
            said, i = t.strip('"').strip(), i + 1
        elif kind == "name":
            found.append((t, said))
            said, i = None, _skip(ts, i + 1)
            if i < end and ts[i][1] == ":":
                i += 1
                while i < end - 1 and ts[i][1] in ("[", "]", "!") or i < end - 1 and ts[i][0] == "name" and ts[i - 1][1] in (":", "["):
                    i += 1
            if i < end and ts[i][1] == "=":
                i += 2
            i = _directives(ts, i)
        else:
            i += 1
    return found, end


def graphql(path: str, text: str) -> list[tuple]:
    """Fields of the root types. A schema block renames those it names, the others keep their names. Extensions of a type are no definitions. Any error fails the file."""
    ts, named, types, i = _gql_tokens(text), {r: r for r in ("Query", "Mutation", "Subscription")}, [], 0
    while i < len(ts):
        t = ts[i][1]
        if t == "schema":
            j = _directives(ts, i + 1)
            end = _skip(ts, j, "{", "}")
            for k in range(j + 1, end - 2):
                if ts[k][0] == "name" and ts[k + 1][1] == ":":
                    named[ts[k][1].capitalize()] = ts[k + 2][1]
            i = end
        elif t == "extend" and i + 1 < len(ts):
            i += 2  # what follows is read as a body of nothing
        elif t == "type" and i + 1 < len(ts):
            j = i + 2
            while j < len(ts) and ts[j][1] != "{" and ts[j][1] not in ("type", "schema", "enum", "input", "interface", "extend", "union", "scalar"):
                j = _skip(ts, j + 2) if ts[j][1] == "@" else j + 1
            if j < len(ts) and ts[j][1] == "{":
                fields, end = _fields(ts, j)
                types.append((ts[i + 1][1], fields))
                i = end
            else:
                i = j
        else:
            i = _skip(ts, i, "{", "}") if t == "{" else i + 1
    # a type that backs several roots counts as the first of them
    roots = {name: root for root, name in reversed(named.items()) if root in ("Query", "Mutation", "Subscription")}
    return [("GraphQl", f"{roots[name]}.{f}", roots[name], None, None, None, said) for name, fields in types if name in roots for f, said in fields]


def documents(path: str, text: str) -> list[tuple]:
    """kind (field or spread), key: what the operations of a document select at their roots; names with two leading underscores are left out."""
    ts, rows, i = _gql_tokens(text), [], 0
    while i < len(ts):
        t = ts[i][1]
        if t == "fragment":
            while i < len(ts) and ts[i][1] != "{":
                i += 1
            i = _skip(ts, i, "{", "}")
            continue
        if t in ("query", "mutation", "subscription", "{"):
            root = "Query" if t == "{" else t.capitalize()
            while ts[i][1] != "{":
                i = _skip(ts, i) if ts[i][1] == "(" else i + 1
            end, i = _skip(ts, i, "{", "}"), i + 1
            while i < end - 1:
                kind, t = ts[i]
                if kind == "spread":
                    rows.append(("spread", ts[i + 1][1]))
                    i += 2
                elif kind == "name":
                    if ts[i + 1][1] == ":":
                        i += 2
                    if not ts[i][1].startswith("__"):
                        rows.append(("field", f"{root}.{ts[i][1]}"))
                    i = _skip(ts, _directives(ts, _skip(ts, i + 1)), "{", "}")
                else:
                    i = _skip(ts, i, "{", "}") if t == "{" else i + 1
            i = end
            continue
        i += 1
    return rows


_PROTO = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|[\w.]+|\S', re.S)


def grpc(path: str, text: str) -> list[tuple]:
    """package.Service.Method; the method column tells which sides stream."""
    ts = [t for t in _PROTO.findall(text) if not t.startswith(("//", "/*"))]
    package, rows, service, depth, at = "", [], None, 0, 0
    for i, t in enumerate(ts):
        if t == "package" and depth == 0:
            package = ts[i + 1] + "."
        elif t == "service" and depth == 0:
            service, at = ts[i + 1], depth
        elif t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            service = None if depth == at else service
        elif t == "rpc" and service and depth == at + 1:
            returns = ts.index("returns", i)
            a, b = "stream" in ts[i:returns], ts[returns + 2] == "stream"
            label = {(False, False): "unary", (True, False): "client_stream", (False, True): "server_stream", (True, True): "bidi_stream"}[a, b]
            rows.append(("Grpc", f"{package}{service}.{ts[i + 1]}", label, None, None, None, None))
    if depth:
        raise ValueError("braces of the definition don't match")
    return rows


ADAPTERS = {"openapi": openapi, "graphql": graphql, "grpc": grpc}


def parse(path: str, text: str) -> list[tuple]:
    kind = detects(text)
    return ADAPTERS[kind](path, text) if kind else []


def operations(files: DataFrame) -> DataFrame:
    """file, error and the operations of contract files; a file that isn't sound is one row with its error."""
    return per_file(files, parse, OPERATIONS)


def selections(files: DataFrame) -> DataFrame:
    """file, error, kind, key of GraphQL documents."""
    return per_file(files, documents, "kind string, key string")
