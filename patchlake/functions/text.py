"""Message predicates and scores as column expressions (no UDF)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from patchlake import rules

# The whitespace class also names the four ASCII separators that the
# Unicode property leaves out.
SPACE = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"


def normalise(text: Column) -> Column:
    """Lower case, every run of whitespace one space, no outer whitespace."""
    return F.trim(F.regexp_replace(F.lower(text), UNICODE + SPACE + "+", " "))


def message(subject: Column, body: Column) -> Column:
    """Subject and body as one normalised text; null parts count as empty."""
    return normalise(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def alternation(parts: list[str], whole_word: bool = False) -> str:
    # Longest first, so that a part that extends another one is tried before it.
    ordered = sorted((re.escape(p) for p in parts), key=len, reverse=True)
    joined = "(?:" + "|".join(ordered) + ")"
    return rf"{UNICODE}\b{joined}\b" if whole_word else joined


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def has_word(text: Column, words: list[str]) -> Column:
    """Any of ``words`` as a whole word; null text gives false."""
    return F.coalesce(F.lower(text).rlike(alternation(words, whole_word=True)), F.lit(False))


def is_fix_message(text: Column) -> Column:
    """Labelling test: one of the label keywords as a whole word."""
    return has_word(text, rules.LABEL_KEYWORDS)


def is_fix_like(text: Column) -> Column:
    """History test: one of the history keywords anywhere, even inside a word."""
    return F.coalesce(contains_any(F.lower(text), rules.HISTORY_SUBSTRINGS), F.lit(False))


def words_found(text: Column, keywords: list[str]) -> Column:
    """Distinct keywords that occur as whole words in normalised ``text``.

    Single words need one pass of one regular expression; only phrases, which
    may overlap single words, are tried one by one, where their letters occur at all.
    """
    single = [k for k in keywords if " " not in k]
    phrases = [k for k in keywords if " " in k]
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(alternation(single, whole_word=True)), F.lit(0)))
    if not phrases:
        return found
    return F.concat(found, named_hits({p: text.contains(p) & text.rlike(rf"{UNICODE}\b{re.escape(p)}\b") for p in phrases}))


def named_hits(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold. No lambda, so it stays in generated code."""
    named = [F.when(test, F.lit(name)).otherwise(F.lit("")) for name, test in tests.items()]
    return F.array_remove(F.array(*named), "")


def has_reference(text: Column) -> Column:
    return contains_any(text, ["#", "issue", "pr"]) & text.rlike(UNICODE + rules.REFERENCE_PATTERN)


def mentions_test_word(text: Column) -> Column:
    return text.contains("test") & text.rlike(UNICODE + rules.TEST_WORD_PATTERN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    A column that is used many times would be copied into each use when a
    filter moves below it; a lambda argument cannot be taken apart.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_signal(df: DataFrame, text: Column, out: str, negatives: bool) -> DataFrame:
    # The text is exploded from an array of one: no filter moves below that, so it is made
    # once, and the tests of it run in generated code.
    t = F.col("__text")
    test_mention = t.contains("test") if negatives else mentions_test_word(t)
    evidence = {
        "issue_or_pr_reference": has_reference(t),
        "bug_related_test": test_mention & contains_any(t, rules.TEST_EVIDENCE_SUBSTRINGS),
    }
    none = F.array().cast("array<string>")
    against = named_hits({f"negative:{k}": t.contains(k) for k in rules.NEGATIVE_SUBSTRINGS}) if negatives else none
    plus, minus = F.col("__plus"), F.col("__minus")
    score = (F.size(plus) * 2 - F.size(minus) * 3).cast("int")
    return (
        df.select("*", F.explode(F.array(text)).alias("__text"))
        .select("*", F.concat(words_found(t, rules.STRONG_KEYWORDS), named_hits(evidence)).alias("__plus"), against.alias("__minus"))
        .withColumn(out, F.struct(score.alias("score"), F.sort_array(F.concat(plus, minus)).alias("signals")))
        .drop("__text", "__plus", "__minus")
    )


def with_fix_signal(df: DataFrame, subject: str = "subject", body: str = "body", out: str = "bug_signal") -> DataFrame:
    """Adds the score and the sorted signal names used to pick positive candidates.

    Here "test" counts anywhere in the text, and routine phrases subtract.
    """
    return _with_signal(df, message(F.col(subject), F.col(body)), out, True)


def with_plain_signal(df: DataFrame, subject: str = "subject", body: str = "body", out: str = "bug_signal") -> DataFrame:
    """Adds the same score as a feature of negatives.

    Nothing subtracts, and "test" must be a word of its own.
    """
    return _with_signal(df, message(F.col(subject), F.col(body)), out, False)


def has_explicit_intent(subject: Column, body: Column) -> Column:
    """The message says outright that it fixes a defect."""
    return any_match(message(subject, body), rules.EXPLICIT_INTENT_PATTERNS)


def routine_score(subject: Column, body: Column) -> Column:
    """Number of distinct routine-work keywords in the message."""
    return let(message(subject, body), lambda t: F.size(words_found(t, rules.ROUTINE_KEYWORDS)))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first of ``patterns``, in list order, found in ``text``; else null."""
    return F.coalesce(*[F.when(text.rlike(f"{UNICODE}(?i){p}"), F.lit(p)) for p in patterns])


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether any of ``patterns`` is found, in one search.

    Patterns that begin alike say their beginning once, so that a place where it
    does not hold is passed without a try of each.
    """
    begin = {b: [p.removeprefix(b) for p in patterns if p.startswith(b)] for b in (r"\b", r"^\s*")}
    rest = [p for p in patterns if not p.startswith(tuple(begin))]
    return text.rlike(f"{UNICODE}(?i)(?:" + "|".join([f"{b}(?:{'|'.join(tails)})" for b, tails in begin.items() if tails] + rest) + ")")


def count_patterns(text: Column, patterns: list[str]) -> Column:
    """How many of ``patterns`` occur at least once."""
    plain = [re.fullmatch(r"\\b([a-z]+(?: [a-z]+)*)\\b", p) for p in patterns]
    words = [m.group(1) for m in plain if m]
    total = F.lit(0)
    if words:
        total = let(F.lower(text), lambda t: F.size(words_found(t, words)))
    for pattern, match in zip(patterns, plain):
        if not match:
            total = total + text.rlike(f"{UNICODE}(?i){pattern}").cast("int")
    return total
