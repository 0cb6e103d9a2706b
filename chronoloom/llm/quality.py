"""Quality rules: a table of thresholds compiled into one projection.

Every measure and every threshold is a Spark expression over the row itself, so judging a corpus is
one scan without a shuffle and without user functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import SPACE, let

# Characters counted as symbols, and frequent words of four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to a in is for that it with was on by this as be are at from "
    "de la le et les des en un du que une est pour qui dans par sur au pas avec "
    "der die und den von zu das mit sich auf für nicht ist im dem ein eine "
    "el y los se las del con por no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose measure is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def broken(self, measures: Column) -> Column:
        value = measures[self.measure]
        tests = []
        if self.low is not None:
            tests.append(value < F.lit(self.low))
        if self.high is not None:
            tests.append(value > F.lit(self.high))
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


# The production table. Ratios are per word or per line that holds a word.
RULES = (
    Rule("word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_word_ratio", high=0.4),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("cut_lines", "ellipsis_line_ratio", high=0.5),
)
MIN_WORDS = 50
OF_WORDS = ("n_words", "word_chars", "n_repeat_words", "n_stop_words")
OF_LINES = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")
MEASURES = (*OF_WORDS, *OF_LINES, "n_symbols")


def _equal_neighbours(sorted_pairs: Column) -> Column:
    """The ``i`` of those (w, i) in a sorted array whose w equals a neighbour's."""

    def kept(x: Column, at: Column) -> Column:
        same_before = x["w"].eqNullSafe(F.get(sorted_pairs, at - 1)["w"])
        return same_before | x["w"].eqNullSafe(F.get(sorted_pairs, at + 1)["w"])

    return F.transform(F.filter(sorted_pairs, kept), lambda x: x["i"])


def _sorted_pairs(values: Column, index: Callable[[Column, Column], Column]) -> Column:
    return F.array_sort(
        F.transform(values, lambda x, i: F.struct(x.alias("w"), index(x, i).alias("i")))
    )


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur more than once in the array.

    Hashes of the windows tell the texts without a repeat, which are most; in the others equal
    hashes are sorted next to each other, then the windows themselves, and the starts of those
    with an equal neighbour cover three words each, overlaps counted once: n log n, whatever the
    text repeats, and exact.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def starts(found: Column) -> Column:
        likely = let(_sorted_pairs(found, lambda x, i: i), _equal_neighbours)
        by_text = let(
            likely,
            lambda at: F.array_sort(
                F.transform(at, lambda i: F.struct(window(i).alias("w"), i.alias("i")))
            ),
        )
        return F.sort_array(let(by_text, _equal_neighbours))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(
                at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))
            ),
            F.lit(0),
            lambda total, x: total + x,
        )

    counted = let(
        hashes(words),
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            let(starts(found), covered)
        ),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).alias("n_words"),
        F.length(F.array_join(words, "")).alias("word_chars"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).alias("n_stop_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).alias(
            "n_bullet_lines"
        ),
        F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).alias(
            "n_ellipsis_lines"
        ),
    )


def measures(text: Column) -> Column:
    """A struct of the MEASURES of a text, all LONG; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    parts = let(F.filter(F.split(text, SPACE), lambda w: w != ""), _of_words)
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t\x0b\f\r]")), _of_lines
    )
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))
    return let(
        F.struct(parts.alias("p"), lines.alias("l"), symbols.alias("n_symbols")),
        lambda s: F.struct(
            *(s["p"][name].cast("long").alias(name) for name in OF_WORDS),
            *(s["l"][name].cast("long").alias(name) for name in OF_LINES),
            s["n_symbols"].cast("long").alias("n_symbols"),
        ),
    )


def _ratio(m: Column, part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(m[part].cast("double"), m[whole]), F.lit(0.0))


RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def verdict(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The whole judgement of a text as one struct; see :func:`judged` for its fields."""

    def ruled(m: Column) -> Column:
        names = F.array_compact(
            F.array(F.lit(None).cast("string"), *(F.when(r.broken(m), F.lit(r.name)) for r in rules))
        )
        base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(
            *(m[name].alias(name) for name in (*MEASURES, *RATIOS)),
            base.alias("base_failed"),
            names.alias("broken"),
            (~base & (F.size(names) == 0)).alias("kept"),
        )

    def with_ratios(m: Column) -> Column:
        return F.struct(
            *(m[name].alias(name) for name in MEASURES),
            *(_ratio(m, *parts).alias(name) for name, parts in RATIOS.items()),
        )

    return let(let(measures(text), with_ratios), ruled)


def judged(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """One row per document: id, MEASURES, RATIOS, ``base_failed``, ``broken`` and ``kept``.

    ``base_failed``: fewer than MIN_WORDS words, or over half the words inside repeated windows.
    ``broken`` names the rules of the table that reject a document (empty if none), ``kept`` is
    true where neither rejects. Defined cases: a null or blank text has zero words and fails;
    repeated rows and equal ids are judged one by one; other columns are ignored; an empty table
    gives an empty table.
    """
    seen = docs.select(
        F.col(doc_id).alias("doc_id"), verdict(F.col(text), rules).alias("verdict")
    )
    return seen.select("doc_id", "verdict.*")


def kept_documents(
    docs: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their own columns and no others."""
    return docs.filter(verdict(F.col(text), rules)["kept"])
