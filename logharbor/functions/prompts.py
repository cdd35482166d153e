"""Natural-language prompts: time window, keywords, specific or generic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from logharbor import constants as K
from logharbor.functions import quoted, quoted_array

_PHRASE = quoted("(?iU)" + K.TIME_PHRASE)


def time_window_seconds(prompt: str) -> str:
    """Length in seconds of the first time phrase; null without a positive one."""
    amount = f"try_cast(regexp_extract({prompt}, {_PHRASE}, 1) AS BIGINT)"
    unit = (
        f"CASE lower(left(regexp_extract({prompt}, {_PHRASE}, 2), 1))"
        " WHEN 's' THEN 1L WHEN 'm' THEN 60L WHEN 'h' THEN 3600L WHEN 'd' THEN 86400L END"
    )
    return f"IF({amount} > 0, try_multiply({amount}, {unit}), NULL)"


def duration_text(seconds: str) -> str:
    """``0:10:00`` or ``2 days, 3:00:00``."""
    days = f"{seconds} div 86400"
    clock = (
        f"format_string('%d:%02d:%02d', {seconds} % 86400 div 3600, {seconds} % 3600 div 60, {seconds} % 60)"
    )
    return (
        f"IF({seconds} IS NULL, NULL, concat(CASE {days} WHEN 0 THEN '' WHEN 1 THEN '1 day, '"
        f" ELSE format_string('%d days, ', {days}) END, {clock}))"
    )


def strip_time_phrase(prompt: str) -> str:
    """Delete time phrases, a dangling "for the" at the end, and "ago"."""
    dangling = quoted(r"(?iU)\b(for|from|in|within|of)\s+the\s*$")
    ago = quoted(r"(?iU)\bago\b")
    edges = quoted(r"(?U)^\s+|\s+$")
    text = f"regexp_replace({prompt}, {_PHRASE}, '')"
    return f"regexp_replace(regexp_replace(regexp_replace({text}, {dangling}, ''), {ago}, ''), {edges}, '')"


def search_text(prompt: str) -> str:
    """The prompt that keywords are taken from."""
    return f"IF({time_window_seconds(prompt)} IS NOT NULL, {strip_time_phrase(prompt)}, {prompt})"


def prompt_terms(prompt: str) -> str:
    """Keyword terms in order, duplicates kept."""
    tokens = f"regexp_extract_all(lower({prompt}), {quoted(f'({K.PROMPT_TOKEN})')}, 1)"
    stop = quoted_array(K.PROMPT_STOPWORDS)
    return f"filter({tokens}, t -> NOT array_contains({stop}, t))"


def term_pattern(terms: str) -> str:
    """Terms as a regular expression; the fallback pattern without terms."""
    escaped = f"transform({terms}, t -> replace(replace(t, '-', {quoted(chr(92) + '-')}), '.', {quoted(chr(92) + '.')}))"
    return f"IF(size({terms}) > 0, array_join({escaped}, '|'), {quoted(K.FALLBACK_PATTERN)})"


def is_specific_prompt(prompt: str) -> str:
    """False for short prompts and for generic "show me the errors" requests."""
    clean = strip_time_phrase(prompt)
    # flag d: the dot stops at a line feed only
    generic = f"{clean} RLIKE {quoted('(?iUd)' + K.GENERIC_PROMPT)}"
    return f"(char_length({clean}) >= {K.MIN_SPECIFIC_PROMPT} AND NOT {generic})"


@dataclass(frozen=True)
class Prompt:
    """One prompt, resolved to literals before a plan is built."""

    text: str
    window_seconds: int | None
    window_text: str | None
    search_text: str
    topic: str
    terms: tuple[str, ...]
    pattern: str
    specific: bool


def resolve_prompt(spark: SparkSession, text: str) -> Prompt:
    """Evaluate the prompt functions on one literal (constants to the optimizer, no job)."""
    row = (
        spark.sql("SELECT :text AS p", args={"text": text})
        .selectExpr(
            f"{time_window_seconds('p')} AS w", f"{search_text('p')} AS s",
            f"{strip_time_phrase('p')} AS topic", f"{is_specific_prompt('p')} AS specific",
        )
        .selectExpr("*", f"{duration_text('w')} AS wt", f"{prompt_terms('s')} AS terms")
        .selectExpr("*", f"{term_pattern('terms')} AS pattern")
        .first()
    )
    return Prompt(text, row.w, row.wt, row.s, row.topic, tuple(row.terms), row.pattern, row.specific)
