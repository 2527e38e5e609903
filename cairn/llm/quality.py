"""Quality rules: a table of thresholds, compiled into one projection of Spark's own functions.

Words are runs of characters other than ASCII white space. A document fails at
base with fewer than 50 words, or when over half of its words stand in 3-word
windows that occur twice or more; otherwise each rule of the table bounds a
measure of it, and the names of the rules it breaks are returned.

Nulls: a null text has no words, symbols or lines, and fails at base. Empty
table: no rows. Repeated rows: each is judged. Other columns of the input are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_and_text, row

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was that for on are be by from with or an it as at this not have he his "
    "le la les de des un une et est en du que sur par pour au dans qui ce il ne se pas plus "
    "der die das und den von zu mit ist ein eine auf für dem nicht im sich des als auch es an "
    "el los las del y una con para es al lo como más pero sus su"
)

#: name, measure, least, most. A rule is broken outside of least..most; measures are of whole texts.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, 1_000_000),
    ("word_length", "mean_word_chars", 2.0, 12.0),
    ("symbols", "symbols_per_word", None, 0.2),
    ("shouting", "shouts_per_word", None, 0.5),
    ("stop_words", "stop_word_ratio", 0.03, None),
    ("repeated_lines", "repeated_line_ratio", None, 0.6),
    ("listed_lines", "bulleted_line_ratio", None, 0.9),
)


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words stand in a window of `size` words that occurs twice or more. Windows are told apart by 64-bit hashes; only a text where one occurs twice has them sorted with their places, so the cost is n log n at any length."""
    hashed = "xxhash64(" + ", ".join(f"{{w}}[i + {k}]" for k in range(size)) + ")"
    return F.expr(f"""
      CASE WHEN size({{w}}) <= {size} THEN 0L ELSE transform(array(transform(sequence(0, size({{w}}) - {size}), i -> {hashed})), h ->
        CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
        aggregate(transform(array(array_sort(transform(filter(transform(array(sort_array(transform(h, (s, i) -> struct(s AS s, i AS i)))),
            x -> transform(x, (e, k) -> struct(e.i AS i, (k > 0 AND get(x, k - 1).s = e.s) OR coalesce(get(x, k + 1).s = e.s, false) AS again)))[0], e -> e.again), e -> e.i))),
          p -> aggregate(transform(p, (e, k) -> least({size}, coalesce(get(p, k + 1) - e, {size}))), 0L, (a, e) -> a + e)),
        0L, (a, e) -> a + e) END)[0] END""".replace("{w}", words))


def measures(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What base and the rules look at, as one projection over the column text; `carried` columns stay."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    stop = sorted(set(STOP_WORDS.split()))
    cut = docs.select(*carried, text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), lines.alias("lines"))
    return cut.select(
        *carried,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("w").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.size(F.filter("w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(*stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*+•·]"))).cast("long").alias("n_bulleted"),
    )


#: A measure of the table that is not a count: what is divided by what.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "shouts_per_word": ("n_shouts", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "repeated_line_ratio": ("n_dup_lines", "n_lines"),
    "bulleted_line_ratio": ("n_bulleted", "n_lines"),
}


def broken(rules=RULES) -> Column:
    """The table as one expression: names of the rules that a row of measures breaks."""
    cases = []
    for name, measure, least, most in rules:
        value = F.col(measure) if measure not in RATIOS else F.try_divide(F.col(RATIOS[measure][0]).cast("double"), F.col(RATIOS[measure][1]))
        outside = F.lit(False)
        if least is not None:
            outside = outside | (value < least)
        if most is not None:
            outside = outside | (value > most)
        cases.append(F.when(outside, F.lit(name)))
    return F.array_compact(F.array(*cases))


def judged(docs: DataFrame, rules=RULES, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, the measures, base_failed, kept, and the rules broken."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measures(docs, carried).withColumn("base_failed", base).withColumn("broken", broken(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the rules broken, for every document."""
    return judged(id_and_text(docs), rules)


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with all columns they came with."""
    whole = docs.select(row(docs).alias("_document"), docs["text"].cast("string").alias("text"))
    # the verdict passes a generator, below which the filter isn't pushed: there it would stand over the text and find the words anew for each use
    verdict = judged(whole, rules, ("_document",)).select("_document", F.explode(F.array("kept")).alias("kept"))
    return verdict.where("kept").select("_document.*")
