"""Keyword matching, signatures, label tokens and truncation of line text."""

from __future__ import annotations

from collections.abc import Sequence

from logharbor import constants as K
from logharbor.functions import quoted, quoted_array
from logharbor.functions.events import folded
from logharbor.functions.numbers import round_exact

# Characters counted as blank beyond Unicode white space.
_BLANK = r"\s\x1c-\x1f"


def keyword_match(line: str, terms: Sequence[str], pattern: str) -> str:
    """True when the keyword pattern occurs in the line.

    Terms are literal ASCII, so substring tests on the folded line decide; only
    the fallback pattern needs a regular expression.
    """
    if not terms:
        return f"({line} RLIKE {quoted('(?iU)' + pattern)})"
    distinct = list(dict.fromkeys(terms))
    if len(distinct) <= 32:
        return "(" + " OR ".join(f"contains({folded(line)}, {quoted(t)})" for t in distinct) + ")"
    return f"exists({quoted_array(distinct)}, t -> contains({folded(line)}, t))"


def keyword_score(line: str, pattern: str) -> str:
    """Keyword hits per word of the whole line, 4 places; ``pattern`` is SQL text."""
    hits = f"regexp_count({line}, concat('(?iU)', {pattern}))"
    words = f"regexp_count({line}, {quoted(f'(?U)[^{_BLANK}]+')})"
    return round_exact(f"CAST({hits} AS DOUBLE) / greatest({words}, 1)", 4)


def cut_line(line: str) -> str:
    return f"substring({line}, 1, {K.LINE_LENGTH})"


def cut_context(text: str) -> str:
    return f"substring({text}, 1, {K.CONTEXT_LENGTH})"


def error_signature(line: str, length: int | None = None) -> str:
    """The line without leading timestamp, level and up to two ``[tags]``; cut only if a length is given."""
    levels = "|".join(K.SIGNATURE_LEVELS)
    lead = (
        rf"(?U)^(?:{K.SIGNATURE_TIMESTAMP}\s*)?(?:(?i:{levels})\s*)?"
        rf"(?:\[[\w\-]+\]\s*)?(?:\[[\w\-]+\]\s*)?[{_BLANK}]*"
    )
    body = f"regexp_replace({line}, {quoted(lead)}, '')"
    whole = f"regexp_replace({body}, {quoted(rf'(?U)[{_BLANK}]+$')}, '')"
    return whole if length is None else f"substring({whole}, 1, {int(length)})"


def label_tokens(line: str) -> str:
    """Distinct meaningful tokens of a line, in order of first occurrence."""
    tokens = f"regexp_extract_all(lower({line}), {quoted(f'({K.LABEL_TOKEN})')}, 1)"
    return f"array_except({tokens}, {quoted_array(K.LABEL_STOPWORDS)})"


def cluster_label(keywords: str) -> str:
    """First three keywords in capitals, or UNKNOWN."""
    return f"IF(size({keywords}) > 0, upper(array_join(slice({keywords}, 1, 3), ' ')), 'UNKNOWN')"
