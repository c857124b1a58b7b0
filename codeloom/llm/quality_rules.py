"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, let

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "a and are as at be by for from had has have he her his in is it not of on or that the this to was were which with you".split(),
    "de": "auf das dem den der des die ein eine er es für ich im in ist mit nicht sie sich und von war zu".split(),
    "es": "a con de del el en es la las lo los no para por que se su un una y".split(),
    "fr": "au ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= (numerator + plus) / denominator <= high``."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    plus: int = 0


#: The thresholds of the verdict; ratios whose denominator is 0 count as 0.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "word_chars", 0.0, 0.08),
    Rule("stop_words", "n_stop", "n_words", 0.04, 2.0, plus=1),  # a short text may lack them by chance
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.4),
)

SYMBOLS = "#*$%&|<>"


def stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words})


def _repeated(words: Column) -> Column:
    """How many words lie in a five-word window that the text holds twice or more.

    Hashes of all windows are compared first. Equal windows have equal hashes, so a text whose
    hashes all differ has none, exactly; only other texts compare the windows themselves. They sort
    (window, place) pairs, so the work is n log n for any repetition.
    """
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 5)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))

    def exact() -> Column:
        windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(5)]).alias("w"), i.alias("i")))
        ordered = F.array_sort(windows)

        def flagged(s: Column) -> Column:
            twin = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]))
            return F.array_sort(F.filter(twin, lambda p: p.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            let(ordered, flagged),
            start,
            lambda acc, p: F.struct((acc["n"] + p + 5 - F.greatest(p, acc["end"])).alias("n"), (p + 5).alias("end")),
            lambda acc: acc["n"],
        )

    return F.when(n < 5, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact())))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    One pass without any exchange. A null text counts as empty: no words, so it fails the base.
    Equal rows give equal rows, an empty table an empty one; only ``doc_id`` and ``text`` are read,
    so other columns can't clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("_text"), F.array_remove(F.split(text, SEPARATORS), "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    counted = split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stop_words()))).cast("long").alias("n_stop"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = reduce(lambda a, b: a & b, (_passes(r) for r in rules), F.lit(True))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict).alias("kept"), "n_lines", "n_stop")


def _passes(rule: Rule) -> Column:
    ratio = F.when(F.col(rule.denominator) > 0, (F.col(rule.numerator) + rule.plus) / F.col(rule.denominator)).otherwise(F.lit(0.0))
    return ratio.between(rule.low, rule.high)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same counts and verdict as DuckDB SQL over ``documents``."""
    words = ", ".join(f"'{w}'" for w in stop_words())
    verdict = " AND ".join(f"(CASE WHEN {r.denominator} > 0 THEN ({r.numerator} + {r.plus})::DOUBLE / {r.denominator} ELSE 0.0 END) BETWEEN {r.low} AND {r.high}" for r in rules)
    return f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({words})))::BIGINT AS n_stop
  FROM split LEFT JOIN covered USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept, n_lines, n_stop FROM base"""
