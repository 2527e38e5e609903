"""Secret scans: patterns for known shapes, and a battery of randomness tests for the rest.

All of it is Spark's own functions. The places of a pattern's matches are the
running lengths of what lies between the matches and of the matches.

Other long tokens are tested by the alphabet their characters infer. The null
hypothesis is a token like ordinary text of its length; its p-value joins how
even the alphabet is used (chi-squared against that of text) and how often kinds
of characters change (runs). A token is a finding if the Benjamini-Hochberg rule
over its document's tokens, weighted by length, rejects that, and if it does look
random: its chi-squared against uniform use, and its serial correlation, are
within what chance gives. Short tokens of few kinds of characters differ too
little from text to be told: of 24 random lower-case letters none is found.

The rate of false discoveries is held within each document, as a document is what a
reader of findings sees; over a corpus of many documents each with few tokens, the
expected share of false findings is that rate as well, their number grows with the corpus.

Time grows with a text's length and its matches, not with their square.

Nulls: a null text is an empty one. Empty table: no rows. Ties: findings of equal p share a rank's fate. Without findings: counts of 0, the SHA-256 of
nothing, no spans. Repeated rows: each is scanned. Places count code points, ends
are exclusive. Spans of different kinds may overlap, as their patterns do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, row

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: kind, pattern, group whose length counts, least length. The shapes of the contract.
KINDS = (("assign", ASSIGN, 1, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding, shape, its alphabet, and the symbols over which text has an index of coincidence. The first shape that fits counts. Uniformity
#: is tested over the alphabet itself: over a larger one a random token looks the less even the longer it is.
ENCODINGS = (
    ("digits", r"^[0-9]+$", _DIGITS, 10, 0.16),
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 16, 0.12),
    ("lower", r"^[a-z]+=*$", _LOWER, 26, 0.075),
    ("upper", r"^[A-Z]+=*$", _UPPER, 32, 0.075),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567", 32, 0.075),
    ("lower_base32", r"^[a-z2-7]+=*$", _LOWER + "234567", 64, 0.068),
    ("lower_digits", r"^[a-z0-9]+=*$", _LOWER + _DIGITS, 64, 0.068),
    ("upper_digits", r"^[A-Z0-9]+=*$", _UPPER + _DIGITS, 64, 0.068),
    ("letters", r"^[A-Za-z]+=*$", _UPPER + _LOWER, 64, 0.068),
    ("letters_digits", r"^[A-Za-z0-9]+=*$", _UPPER + _LOWER + _DIGITS, 64, 0.068),
    ("base64", r"", _UPPER + _LOWER + _DIGITS + "+/", 64, 0.068),
)
#: Encodings of one kind of character, which has no changes of kind to count.
ONE_KIND = ("digits", "lower", "upper")
#: Share of neighbours in ordinary tokens that differ in kind (lower, upper, digit, other).
TEXT_CHANGES = 0.12
FALSE_DISCOVERIES = 0.001


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Elements that a running value is carried over at a time. An array grown by one element is copied, so what grows is kept short.
AT_ONCE = 256


def bound(value: str, name: str, body: str) -> str:
    """body with `name` standing for the value, which is found once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(array: str, element: str, kind: str, start: str, join: str) -> str:
    """Of each element of the array what `join` makes of all elements before it, from `start` on: by parts of AT_ONCE elements, then over the parts, so that time doesn't grow with the square of the array.

    element: of x, its value; kind: its type; join: of p and q.
    """
    join_of = lambda p, q: join.replace("{p}", p).replace("{q}", q)
    carry = lambda over, name, value: (
        f"aggregate({over}, struct(cast({start} as {kind}) AS t, cast(array() as array<{kind}>) AS o), (c, {name}) -> struct({join_of('c.t', value)} AS t, concat(c.o, array(c.t)) AS o))"
    )
    parts = f"transform(sequence(0, greatest(0, (size(v_) - 1) div {AT_ONCE})), k -> {carry(f'slice(v_, k * {AT_ONCE} + 1, {AT_ONCE})', 'x', element)})"
    whole = bound(carry("i_", "y", "y.t") + ".o", "b_", f"flatten(transform(i_, (y, k) -> transform(y.o, z -> {join_of('b_[k]', 'z')})))")
    return bound(array, "v_", bound(parts, "i_", whole))


def matches(text: str, pattern: str, group: int, least: int) -> str:
    """array<struct<start, end, s>> of the pattern's matches whose group is long enough."""
    p = _quoted(pattern)
    none = "cast(array() AS array<struct<start:int,end:int,s:string>>)"
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    parts = f"transform(filter({zipped}, x -> x.`1` IS NOT NULL), x -> struct(char_length(x.`0`) AS gap, char_length(x.`1`) AS n, char_length(x.`2`) AS g, x.`1` AS s))"
    places = running("m", "x.gap + x.n", "int", "0", "{p} + {q}")
    kept = f"transform(filter(zip_with(m, {places}, (x, at) -> struct(x.g AS g, at + x.gap AS start, at + x.gap + x.n AS end, x.s AS s)), x -> x.g >= {least}), x -> struct(x.start AS start, x.end AS end, x.s AS s))"
    return f"CASE WHEN {text} RLIKE {p} THEN {bound(parts, 'm', kept)} ELSE {none} END"


def _tail(z: str) -> str:
    """P(Z < z) of a standard normal, by a logistic curve of a cubic."""
    return f"(1 / (1 + exp(greatest(-700D, least(700D, -(1.5976D * {z} + 0.070566D * {z} * {z} * {z}))))))"


def _battery(tokens: str) -> Column:
    """array<struct<start, end, p, w, random>> of the tokens, given array<struct<s, start, end>>."""
    encoding = "CASE " + " ".join(f"WHEN x.s RLIKE {_quoted(shape)} THEN {k}" for k, (_, shape, *_) in enumerate(ENCODINGS) if shape) + f" ELSE {len(ENCODINGS) - 1} END"
    alphabet = "CASE x.e " + " ".join(f"WHEN {k} THEN '{a}'" for k, (_, _, a, *_) in enumerate(ENCODINGS)) + " END"
    at = [name for name, *_ in ENCODINGS].index
    symbols = "CASE x.e " + " ".join(f"WHEN {k} THEN {t}D" for k, (_, _, _, t, _) in enumerate(ENCODINGS)) + " END"
    ic = "CASE x.e " + " ".join(f"WHEN {k} THEN {c}D" for k, (*_, c) in enumerate(ENCODINGS)) + " END"
    steps = [
        (tokens, f"struct(x.s AS s, x.start AS start, x.end AS end, {encoding} AS e)"),
        (None, f"struct(CASE WHEN x.e = {at('hex')} THEN lower(x.s) WHEN x.e = {at('base64')} THEN translate(x.s, '-_=', '+/') ELSE rtrim('=', x.s) END AS s, x.start AS start, x.end AS end, x.e AS e, {alphabet} AS al, {symbols} AS t, {ic} AS ic)"),
        (None, """struct(x.start AS start, x.end AS end, x.e AS e, x.t AS t, x.ic AS ic, cast(char_length(x.s) AS double) AS n, cast(char_length(x.al) AS double) AS k,
          aggregate(split(x.al, ''), 0D, (a, c) -> a + power(char_length(x.s) - char_length(replace(x.s, c, '')), 2)) AS squares,
          transform(split(x.s, ''), c -> cast(instr(x.al, c) AS double)) AS codes,
          transform(split(x.s, ''), c -> CASE WHEN c BETWEEN 'a' AND 'z' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2 WHEN c BETWEEN '0' AND '9' THEN 3 ELSE 4 END) AS kinds)"""),
        (None, """struct(x.start AS start, x.end AS end, x.e AS e, x.n AS n, x.k AS k, x.t AS t, x.k / x.n * x.squares - x.n AS chi, x.t / x.n * x.squares - x.n AS chi_text, (x.n - 1) * (x.t * x.ic - 1) AS over,
          aggregate(zip_with(slice(x.kinds, 1, size(x.kinds) - 1), slice(x.kinds, 2, size(x.kinds) - 1), (a, b) -> CASE WHEN a <> b THEN 1D ELSE 0D END), 0D, (a, b) -> a + b) AS changes,
          aggregate(x.codes, 0D, (a, b) -> a + b) / x.n AS mean, x.codes AS codes)"""),
        (None, f"""struct(x.start AS start, x.end AS end, x.n AS n, x.e AS e,
          (x.chi - (x.k - 1)) / sqrt(2 * (x.k - 1)) AS uniform,
          (x.chi_text - (x.t - 1) - x.over) / sqrt(2 * (x.t - 1) + 4 * x.over) AS even,
          ((x.n - 1) * {TEXT_CHANGES} - x.changes) / sqrt((x.n - 1) * {TEXT_CHANGES * (1 - TEXT_CHANGES)}) AS runs,
          try_divide(aggregate(zip_with(slice(x.codes, 1, size(x.codes) - 1), slice(x.codes, 2, size(x.codes) - 1), (a, b) -> (a - x.mean) * (b - x.mean)), 0D, (a, b) -> a + b),
            aggregate(x.codes, 0D, (a, b) -> a + (b - x.mean) * (b - x.mean))) * sqrt(x.n) AS serial)"""),
        (None, f"""struct({_tail(f"(CASE WHEN x.e IN ({', '.join(str(at(k)) for k in ONE_KIND)}) THEN x.even ELSE (x.even + x.runs) / sqrt(2D) END)")} AS p, x.start AS start, x.end AS end, x.n AS n,
          x.uniform < 4 AND abs(coalesce(x.serial, 99D)) < 3.3 AS random)"""),
    ]
    out = ""
    for array, to in steps:
        out = f"transform({array or out}, x -> {to})"
    return F.expr(out)


def findings(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns, assign, access, hex and random: arrays of places. The column text must not be null."""
    out = docs.select(*carried, text, *(F.expr(matches(text, p, g, n)).alias(kind) for kind, p, g, n in KINDS), F.expr(matches(text, TOKEN, 0, 20)).alias("_tokens"))
    out = out.withColumn("_tested", F.when(F.size("_tokens") > 0, _battery("_tokens")))
    # p over weight, in order; the largest rank whose p is below its share of the allowed rate
    weighted = F.expr("""CASE WHEN _tested IS NOT NULL THEN sort_array(transform(array(aggregate(_tested, 0D, (a, x) -> a + x.n) / size(_tested)), m ->
        transform(_tested, x -> struct(x.p * m / x.n AS p, x.start AS start, x.end AS end, x.random AS random)))[0]) END""")
    out = out.withColumn("_ranked", weighted)
    out = out.withColumn("_rank", F.expr(f"coalesce(array_max(transform(_ranked, (x, k) -> CASE WHEN x.p <= {FALSE_DISCOVERIES}D * (k + 1) / size(_ranked) THEN k + 1 ELSE 0 END)), 0)"))
    # a token within a base span is no finding of its own. Within a hex or access span it is all of it, as these hold characters of tokens only; within
    # an assignment it is a token of the assignment's text. So sets of places tell, each place as one number
    new = F.expr("""transform(filter(slice(coalesce(_ranked, cast(array() AS array<struct<p:double,start:int,end:int,random:boolean>>)), 1, _rank), x -> x.random), x -> shiftleft(cast(x.start AS bigint), 31) + x.end)""")
    out = out.withColumn("_new", new)
    own = F.expr(f"flatten(transform(assign, a -> transform({matches('a.s', TOKEN, 0, 20)}, x -> shiftleft(cast(x.start + a.start AS bigint), 31) + x.end + a.start)))")
    base = [own, *(F.transform(k, lambda x: F.shiftleft(x["start"].cast("bigint"), 31) + x["end"]) for k in ("access", "hex"))]
    left = F.when(F.size("_new") > 0, F.array_except("_new", F.concat(*base))).otherwise(F.col("_new"))
    place = lambda x: F.struct(F.shiftright(x, 31).cast("int").alias("start"), x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("end"))
    return out.select(*carried, text, *(F.transform(k, lambda x: F.struct(x["start"], x["end"])).alias(k) for k, *_ in KINDS), F.transform(left, place).alias("random"))


def _listed(kinds: tuple[str, ...]) -> Column:
    parts = [F.expr(f"transform({k}, x -> struct(x.start AS start, {i} AS i, x.end AS end, '{k}' AS kind))") for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = tuple(k for k, *_ in KINDS)
    found = findings(id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed((*base, "random")).alias("spans"))


#: Characters of a block of text that places are looked up in.
BLOCK = 1024


def _without(spans: str, text: str, mark: str) -> str:
    """The text with the spans (sorted; they may overlap) replaced by the mark. A place is found in its block, so that time doesn't grow with the number of spans times the text."""
    ends = running("s_", "x.end", "int", "0", "greatest({p}, {q})")
    # of each span that doesn't begin within those before: what stands between them and it
    gaps = f"filter(zip_with(s_, {ends}, (x, e) -> struct(e AS a, x.start AS b)), x -> x.b >= x.a)"
    piece = lambda a, b: (
        f"CASE WHEN {a} div {BLOCK} = {b} div {BLOCK} THEN substring(k_[{a} div {BLOCK}], {a} % {BLOCK} + 1, {b} - {a}) "
        f"ELSE concat(substring(k_[{a} div {BLOCK}], {a} % {BLOCK} + 1), array_join(slice(k_, {a} div {BLOCK} + 2, {b} div {BLOCK} - {a} div {BLOCK} - 1), ''), substring(k_[{b} div {BLOCK}], 1, {b} % {BLOCK})) END"
    )
    last = bound("array_max(transform(s_, x -> x.end))", "w_", piece("w_", "n_"))
    cut = f"concat(array_join(transform({gaps}, x -> concat({piece('x.a', 'x.b')}, '{mark}')), ''), {last})"
    # one block more than the text fills, for a place at its end
    blocks = f"concat(regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0), array(''))"
    return bound(spans, "s_", bound(blocks, "k_", bound(f"char_length({text})", "n_", cut)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced by the mark; n_chars, if there, follows the text. Other columns stay; a null text stays null."""
    own = docs.columns
    whole = docs.select(row(docs).alias("_document"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))
    found = findings(whole, ("_document",), "_text")
    spans = F.sort_array(F.concat("assign", "access", "hex", "random"))
    found = found.select("_document", "_text", spans.alias("_spans"))
    found = found.withColumn("_text", F.expr(f"CASE WHEN size(_spans) = 0 THEN _document.text ELSE {_without('_spans', '_text', mark)} END"))
    columns = {c: F.col("_document").getField(c) for c in own} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("_spans") > 0, F.char_length("_text").cast("long")).otherwise(columns["n_chars"])
    return found.select(*(x.alias(c) for c, x in columns.items()))
