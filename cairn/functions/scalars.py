"""Scalar functions on columns: identities, paths, slugs, tokens, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import schema


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def uid(language, package, path, fqn, signature="") -> Column:
    """language|package|path|fqn|signature"""
    parts = [F.lit(x) if isinstance(x, str) and x == "" else col(x) for x in (language, package, path, fqn, signature)]
    return F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in parts))


def uid_part(u, k: int) -> Column:
    return F.split_part(col(u), F.lit("|"), F.lit(k))


def anchor(fqn) -> Column:
    """What follows the first #, or all."""
    x = col(fqn)
    return F.when(F.instr(x, "#") > 0, F.substring(x, F.instr(x, "#") + 1, F.length(x))).otherwise(x)


def clamp(confidence) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(confidence).cast("double"))).cast("float")


def will_break(confidence, ambiguous) -> Column:
    return (col(confidence) >= F.lit(schema.WILL_BREAK).cast("float")) & ~col(ambiguous)


def plane_of(kind) -> Column:
    out = None
    for plane, kinds in schema.PLANES.items():
        test = col(kind).isin(*kinds)
        out = F.when(test, F.lit(plane)) if out is None else out.when(test, F.lit(plane))
    return out.otherwise(F.lit("code"))


def plane_for_label(kind) -> Column:
    """The four planes of change reports: data kinds count as code."""
    return F.when(plane_of(kind) == "data", F.lit("code")).otherwise(plane_of(kind))


def plane_for_path(path) -> Column:
    """Which extractor a changed file concerns; null: none."""
    p = F.lower(col(path))
    return (
        F.when(p.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|py|cs|rs)$"), F.lit("code"))
        .when(p.rlike(r"\.(graphql|gql)$"), F.lit("contract"))
        .when(p.rlike(r"\.(ya?ml|json)$"), F.lit("contract_or_infra"))
    )


def code_language(path) -> Column:
    p = F.lower(col(path))
    return F.when(p.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$"), F.lit("ts")).when(p.endswith(".py"), F.lit("py")).when(p.endswith(".cs"), F.lit("cs")).when(p.endswith(".rs"), F.lit("rust"))


def normalize_path(path) -> Column:
    """Segments {x}, :x and <x> become {}."""
    return F.array_join(F.transform(F.split(col(path), "/"), lambda s: F.when(s.rlike(r"^(\{.*\}|:.+|<.*>)$"), F.lit("{}")).otherwise(s)), "/")


def slug(heading) -> Column:
    """Anchors of headings: ASCII letters and digits lower, space and - to -, the rest dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(heading)), r"[^a-z0-9 _-]", ""), "[ -]", "-")


def has_path_shape(x) -> Column:
    return col(x).rlike(r"/[^/]*\.[A-Za-z0-9]+$")


def segments(token) -> Column:
    return F.filter(F.split(col(token), r"::|\."), lambda s: F.length(s) > 0)


def qualifies(token) -> Column:
    return (F.length(col(token)) >= 3) & col(token).rlike(r"\p{L}")


def symbol_shaped(token) -> Column:
    x = col(token)
    return x.rlike(r"::|\.") | (x.rlike("[a-z]") & x.rlike("[A-Z]"))


def enclosing(fqn) -> Column:
    """What stands before the last dot, or null."""
    x = col(fqn)
    return F.when(F.instr(x, ".") > 0, F.regexp_extract(x, r"^(.*)\.[^.]*$", 1))


def last_segment(path) -> Column:
    return F.substring_index(col(path), "::", -1)


def base_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_dir(path) -> Column:
    return F.when(F.instr(col(path), "/") > 0, F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def normalize_dots(path) -> Column:
    """. and .. applied to a path; .. at the root is dropped."""
    return F.array_join(
        F.aggregate(
            F.filter(F.split(col(path), "/"), lambda s: (s != "") & (s != ".")),
            F.expr("cast(array() as array<string>)"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        ),
        "/",
    )


def normalize_dir(path) -> Column:
    x = F.regexp_replace(F.regexp_replace(col(path), r"^(\./)+", ""), "/+$", "")
    return F.when(x == ".", F.lit("")).otherwise(x)


def django_path(path) -> Column:
    """One leading slash, none at the end; the root stays /."""
    return F.concat(F.lit("/"), F.trim(col(path), F.lit("/")))


def lines_of(text, first, last) -> Column:
    """Lines first..last, from 1 and inclusive, clamped to the text."""
    lines = F.split(col(text), "\n", -1)
    a = F.greatest(col(first), F.lit(1))
    n = F.greatest(F.least(col(last), F.size(lines)) - a + 1, F.lit(0))
    return F.array_join(F.slice(lines, a, n), "\n")


def slug_safe(x) -> Column:
    return col(x).rlike("^[a-z0-9-]+$")


def ratio(a, b) -> Column:
    """0/0 counts as 1."""
    return F.when(col(b) == 0, F.lit(1.0)).otherwise(col(a).cast("double") / col(b))


def elide(text, most: int) -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.left(col(text), F.lit(most - 1)), F.lit("…"))).otherwise(col(text))


def tokens(text) -> Column:
    """Lower-case alphanumeric tokens of at most 40 bytes."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{Nd}]+"), lambda x: (F.length(x) > 0) & (F.octet_length(x) <= 40))


def alias_match(specifier, pattern, target) -> Column:
    """A trailing-* alias applied: what * stands for goes into the target; null if the pattern doesn't match."""
    stem = F.regexp_replace(col(pattern), r"\*$", "")
    starred = col(pattern).endswith("*")
    rest = F.substring(col(specifier), F.length(stem) + 1, F.length(col(specifier)))
    return F.when(starred & col(specifier).startswith(stem), F.replace(col(target), F.lit("*"), rest)).when(~starred & (col(specifier) == col(pattern)), col(target))


def same_file(a, b) -> Column:
    """Equal, or one ends in / and the other; an empty path matches nothing."""
    a, b = col(a), col(b)
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a)))


def moniker_name(moniker) -> Column:
    """The last identifier of a compiler index's symbol."""
    return F.regexp_extract(F.regexp_replace(col(moniker), r"[`]", ""), r"([A-Za-z_$][\w$]*)(?:\(\+?\d*\))?[.#/:]*$", 1)
