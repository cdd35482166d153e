"""Exact rounding and safe ratios."""

from __future__ import annotations


def round_exact(x: str, digits: int, ties: str = "even") -> str:
    """Round a double by its exact binary value, as Python's ``round`` does.

    ``bround`` works on the shortest decimal text of the number, so it sees a
    tie in 1/800 = 0.00125 where the stored value lies just above it. Here the
    distance from the tie is computed without rounding error: the number is
    split in two halves whose products with 10**digits are exact. ``ties`` is
    ``"even"`` or ``"up"``. Good for up to 8 digits.

    The value is held in a one-element array so that it is computed once.
    """
    scale = f"1e{int(digits)}D"
    low = f"CAST(floor(x * {scale}) AS DOUBLE)"
    wide = "x * 134217729D"
    head = f"({wide} - ({wide} - x))"
    beyond = f"(({head} * {scale} - ({low} + 0.5D)) + (x - {head}) * {scale})"
    at_tie = f"pmod({low}, 2D)" if ties == "even" else "1D"
    step = f"CASE WHEN {beyond} > 0 THEN 1D WHEN {beyond} < 0 THEN 0D ELSE {at_tie} END"
    return f"transform(array(CAST({x} AS DOUBLE)), x -> ({low} + {step}) / {scale})[0]"


def ratio(part: str, whole: str) -> str:
    """``part / whole`` as a double; 0.0 when the whole is 0 or absent."""
    return f"CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) ELSE 0D END"


def percent_text(part: str, whole: str, digits: int = 2) -> str:
    """``part`` in percent of ``whole`` as text, ``unknown`` for an empty whole."""
    value = round_exact(f"({ratio(part, whole)}) * 100D", digits)
    return f"CASE WHEN ({whole}) > 0 THEN format_string('%.{digits}f%%', {value}) ELSE 'unknown' END"
