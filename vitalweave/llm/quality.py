"""Quality rules, line by line first, in SQL functions only.

Each line is judged by itself: a line that is mostly punctuation or symbols, that is a
row of navigation entries, or that is a boilerplate notice fails and goes. A document
that loses too large a share of its words that way is rejected. Lines that say the same
as an earlier line are counted, not removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.once import evaluate_once

SPACES = " \t\n\u000b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Notices that belong to a page and not to its text. Fixed values.
BOILERPLATE = (
    "accept all cookies",
    "we use cookies",
    "this site uses cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "skip to content",
    "skip to main content",
    "back to top",
    "share this article",
    "lorem ipsum",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict.

    ``symbols_per_word``: a line with more symbols or repeated marks for each word fails.
    ``separators`` and ``separators_per_word``: as many separators, at least, and more of
    them for each word make a line navigation. ``notice_words``: a boilerplate phrase fails
    a line of no more words. ``lost``: a larger share of words in failed lines rejects.
    """

    symbols_per_word: float = 0.5
    separators: int = 3
    separators_per_word: float = 0.3
    notice_words: int = 30
    lost: float = 0.3


def _count(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACE_RUN))


MARKS, HALF_MARKS, SEPARATORS = "#*$%&<>~^=_", "!?", "|»›•·"


def _has_notice(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line fails a rule; a line without a word never does."""
    words = F.greatest(F.size(_words(line)), F.lit(1))
    marks = _count(line, MARKS) + F.lit(0.5) * _count(line, HALF_MARKS)
    separators = _count(line, SEPARATORS)
    return (
        (marks > F.lit(rules.symbols_per_word) * words)
        | ((separators >= rules.separators) & (separators > F.lit(rules.separators_per_word) * words))
        | (_has_notice(F.lower(line)) & (words <= rules.notice_words))
    )


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def assess(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``df`` with the quality figures, the verdict and the cleaned text of each row.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long),
    base_failed, n_lost_words (words in failed lines), kept, clean_text. Columns of these
    names are replaced. A null text has no words, fails, and its clean_text is null; a
    text without failing lines is its own clean_text. Rows are judged one by one: repeated
    rows stay, an empty table gives an empty table.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept", "clean_text"]
    own = [c for c in df.columns if c not in added or c == text]
    plain = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), F.col(f"`{text}`").isNull().alias("_null"))
    one = evaluate_once(plain, {"_words": _words(F.col("_text")), "_lines": F.split("_text", "\n"), "_low": F.lower("_text")})
    starts = F.sequence(F.lit(0), F.size("_words") - 5)
    enough = F.size("_words") >= 5
    hashes = F.when(enough, F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]))).otherwise(F.expr("cast(array() as array<long>)"))
    # Only a text with one of these characters or phrases can have a line that fails.
    suspect = F.col("_text").rlike(f"[{MARKS}{HALF_MARKS}{SEPARATORS}]") | _has_notice(F.col("_low"))
    fails = F.when(suspect, F.transform("_lines", lambda x: line_fails(x, rules))).otherwise(F.expr("cast(array() as array<boolean>)"))
    two = evaluate_once(one, {"_hashes": hashes, "_fails": fails, "_spoken": F.filter("_lines", _has_word)})
    # Equal hashes only say where to look; the windows themselves are compared.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_words", i + 1, 5), " ").alias("w"), i.alias("i")))
    three = evaluate_once(two, {"_sorted": F.when(enough & repeats, F.array_sort(windows)).otherwise(F.expr("cast(array() as array<struct<w:string,i:int>>)"))})
    places = F.expr(
        """filter(transform(_sorted, (x, k) -> if(
               (k > 0 and _sorted[greatest(k - 1, 0)].w = x.w) or (k + 1 < size(_sorted) and _sorted[least(k + 1, size(_sorted) - 1)].w = x.w),
               x.i, -1)), i -> i >= 0)"""
    )
    four = evaluate_once(three.drop("_hashes", "_low"), {"_places": F.array_sort(places)})
    covered = F.expr("aggregate(transform(_places, (p, k) -> if(k + 1 < size(_places), least(5, _places[least(k + 1, size(_places) - 1)] - p), 5)), 0L, (n, x) -> n + x)")
    nothing = F.lit(0).cast("long")
    some = F.exists("_fails", lambda bad: bad)
    failed_words = F.zip_with("_lines", "_fails", lambda x, bad: F.when(bad, F.size(_words(x))).otherwise(0))
    lost = F.when(some, F.aggregate(failed_words, nothing, lambda n, x: n + x)).otherwise(nothing)
    five = evaluate_once(
        four,
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.char_length("_text") - F.regexp_count("_text", F.lit("[\\x20\\x09-\\x0D]"))).cast("long"),
            "n_symbols": _count(F.col("_text"), "#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long"),
            "n_repeat_words": covered,
            "n_lost_words": lost,
            "clean_text": F.when(F.col("_null"), F.lit(None).cast("string"))
            .when(~some, F.col("_text"))
            .otherwise(F.array_join(F.filter("_lines", lambda x, i: ~F.element_at("_fails", i + 1)), "\n")),
        },
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("n_lost_words") <= F.lit(rules.lost) * F.col("n_words"))
    return five.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *added[:5], failed.alias("base_failed"), "n_lost_words", kept.alias("kept"), "clean_text")


def clean(df: DataFrame, text: str = "text", length: str | None = None, rules: LineRules = LineRules()) -> DataFrame:
    """The kept rows with their failed lines removed and the columns of ``df``; ``length`` names a column of text lengths to renew."""
    plain = df.toDF(*[f"_d{i}" for i in range(len(df.columns))])
    names = dict(zip(df.columns, plain.columns))
    good = assess(plain, names[text], rules).filter("kept")
    renewed = {text: F.col("clean_text")}
    if length is not None and length in names:
        # A length is renewed only where the text has changed.
        renewed[length] = F.when(F.col("n_lost_words") > 0, F.char_length("clean_text")).otherwise(F.col(names[length])).cast(df.schema[length].dataType)
    return good.select(*[renewed.get(c, F.col(names[c])).alias(c) for c in df.columns])
