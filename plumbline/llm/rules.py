"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and the control characters from tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Frequent words of the languages of the corpus, fixed values.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "are", "at", "this", "from", "a", "an", "or"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "ist", "mit", "für", "im", "dem", "nicht", "ein", "eine", "auf", "als", "auch", "es"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "est", "pour", "dans", "qui", "par", "sur", "au", "du", "pas", "plus"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "un", "una", "que", "es", "por", "con", "para", "del", "se", "no", "al", "lo", "su"],
}


class Rule(NamedTuple):
    """A text fails if ``measure`` is below ``low`` or above ``high``; a bound that is None does not count."""

    name: str
    measure: str
    low: float | None
    high: float | None


BASE_RULES = [
    Rule("few_words", "n_words", 50, None),
    Rule("repeats", "repeat_word_percent", None, 50),
]
RULES = [
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("line_repeats", "dup_line_ratio", None, 0.5),
    Rule("capitals", "capital_word_ratio", None, 0.7),
]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``doc_id`` and the measures of every row, counts first, then ratios.

    Words are runs of characters other than blanks. A word counts as repeated if it stands in a window of
    three words that is found twice or more in the text. A line counts as a duplicate if it has a word and
    equals an earlier line. A null text has no words and all its counts are 0; a ratio over no words, or no
    lines, is 0. Rows are neither merged nor dropped, and whole texts count.
    """
    stops = sorted({w for words in stop_words.values() for w in words})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # What a later step reads more than once is made in a step of its own, so that nothing is computed twice.
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
        (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
    )
    tail = F.greatest(F.size("words") - 2, F.lit(0))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    windows = F.zip_with(F.zip_with(F.slice("words", 1, tail), F.slice("words", 2, tail), joined), F.slice("words", 3, tail), joined)
    rows = rows.select(
        "doc_id", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stops))).alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).alias("n_capital_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("window"), i.alias("place")))).alias("ordered"),
    )
    # Equal windows are neighbours now; the places of those that have an equal neighbour cover the repeated words.
    near = lambda s, k: F.get("ordered", k)["window"].eqNullSafe(s["window"])
    again = F.filter("ordered", lambda s, k: near(s, k - 1) | near(s, k + 1))
    places = F.sort_array(F.transform(again, lambda s: s["place"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda done, place: F.struct(place.alias("last"), (done["n"] + F.least(F.lit(3), place - done["last"])).alias("n"))
    rows = rows.withColumn("n_repeat_words", F.aggregate(places, start, step)["n"]).drop("ordered")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"), ratio("n_capital_words", "n_words").alias("capital_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), (100 * ratio("n_repeat_words", "n_words")).alias("repeat_word_percent"),
    )


def failing(rule: Rule) -> Column:
    """True where a measure is out of the rule's bounds."""
    bounds = [F.col(rule.measure) < rule.low] if rule.low is not None else []
    bounds += [F.col(rule.measure) > rule.high] if rule.high is not None else []
    return any_of(bounds)


def any_of(tests: list[Column]) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def judged(docs: DataFrame, base_rules: list[Rule] = BASE_RULES, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures with ``base_failed``, ``kept`` and the names of the ``failed_rules``, decided in one projection."""
    tests = {r.name: failing(r) for r in [*base_rules, *rules]}
    base = any_of([tests[r.name] for r in base_rules])
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return measured(docs, id_col, text_col).select("*", base.alias("base_failed"), (~any_of(list(tests.values()))).alias("kept"), names.alias("failed_rules"))
