"""Quality rules, line first: each line is judged, failing lines go, then documents that lost too much text go.

DataFrame functions only; one narrow pass over the table, no shuffle. Every
value of a row depends on that row alone, so a hot source, copies and skew
cost nothing extra.

Defined results: a null text is a text without words (all counts 0,
``base_failed``, not kept, cleaned text null); equal rows get equal results,
each its own row; an empty table gives an empty table; columns of the input
that clash with those added are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import ascii_words, bind, char_count, clean_columns

#: Symbols that prose hardly uses (fixed values).
SYMBOLS = "#*$%&|<>"
#: Separators of menus and bread crumbs (fixed values).
NAV_SEPARATORS = "|»›•·→"
#: Phrases of notices that sites put on every page, matched without case (own list).
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|(we|site) uses? cookies|accept (all )?cookies"
    r"|enable javascript|javascript is (disabled|required)|subscribe to our|sign up for our|click here to|skip to (main )?content"
    r"|licen[sc]ed under|copyright ©|copyright \(c\)"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds; shares are of the words of a line, ``max_lost`` is of the characters of a document's words."""

    symbol_share: float = 1.0
    shout_share: float = 0.5
    nav_share: float = 0.25
    min_marks: int = 3
    boilerplate_words: int = 30
    max_lost: float = 0.6
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def _n_words(line: Column) -> Column:
    return F.size(ascii_words(line))


def _solid_chars(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", ""))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True where one of the line rules rejects the line.

    Punctuation: no letter or digit at all, a symbol for each word, or
    doubled exclamation marks on half of the words. Navigation: menu
    separators between the words. Boilerplate: a short line with a notice's phrase.
    """

    def judged(n: Column) -> Column:
        symbols = char_count(line, SYMBOLS)
        shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
        separators = char_count(line, NAV_SEPARATORS)
        punctuation = (
            ~line.rlike(r"[\p{L}\p{N}]")
            | ((symbols >= rules.min_marks) & (symbols >= n * rules.symbol_share))
            | ((shouts >= rules.min_marks) & (shouts >= n * rules.shout_share))
        )
        navigation = (separators >= rules.min_marks) & (separators >= n * rules.nav_share)
        boilerplate = (n <= rules.boilerplate_words) & line.rlike("(?i)" + BOILERPLATE)
        return punctuation | navigation | boilerplate

    return bind(_n_words(line), judged)


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, all occurrences counted.

    Window hashes are compared after sorting, so a text costs n log n however
    often it repeats itself. Only texts with a repeated window sort positions too.
    """

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(ranked: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(ranked, i)["h"] == F.get(ranked, j)["h"], F.lit(False))
            flagged = F.filter(ranked, lambda x, i: same(i, i - 1) | same(i, i + 1))
            starts = F.sort_array(F.transform(flagged, lambda x: x["i"]))
            return bind(
                starts,
                lambda s: F.aggregate(
                    F.transform(s, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(s, i + 1) - x, F.lit(width)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(ranked, of_sorted))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(width)]))
        return F.when(n <= width, F.lit(0)).otherwise(bind(hashes, of_hashes))

    return bind(words, of_words)


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with the base measures, the share of text the line rules took, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_failed_lines, lost_share, clean_text, kept.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_share", "clean_text", "kept")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: _solid_chars(x) > 0)
    good = F.filter(F.split(F.col(text), "\n", -1), lambda x: (_solid_chars(x) == 0) | ~line_fails(x, rules))
    words = ascii_words(t)
    out = clean_columns(docs, *(c for c in added if c != text)).withColumns(
        {"__n": F.size(words).cast("long"), "__rep": _repeat_words(words, rules.window).cast("long"), "__chars": _solid_chars(t).cast("long"), "__good": good, "__lines": lines}
    )
    out = out.withColumns(
        {
            "n_words": F.col("__n"),
            "word_chars": F.col("__chars"),
            "n_symbols": char_count(t, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.col("__rep"),
            "base_failed": (F.col("__n") < rules.min_words) | (100 * F.col("__rep") > rules.max_repeat_percent * F.col("__n")),
            "n_lines": F.size("__lines").cast("long"),
            "clean_text": F.array_join("__good", "\n"),
        }
    )
    left = _solid_chars(F.coalesce(F.col("clean_text"), F.lit("")))
    out = out.withColumns(
        {
            "n_failed_lines": F.col("n_lines") - F.coalesce(F.size(F.filter("__good", lambda x: _solid_chars(x) > 0)), F.lit(0)),
            "lost_share": F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(F.lit(0.0)),
        }
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost)).drop("__n", "__rep", "__chars", "__good", "__lines")


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents the rules keep, with their failing lines taken out; the columns of ``docs``."""
    judged = quality_rules(docs.withColumn("__i", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("__i", F.col("text")), rules)
    kept = judged.where("kept")
    pick = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[pick.get(c, F.col("__i")[c]).alias(c) for c in docs.columns])
