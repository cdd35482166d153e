"""Scalar functions as SQL expression text.

Each function takes SQL text (a column name or any expression) and returns SQL
text, for ``F.expr`` / ``selectExpr`` and for nesting. One parsed expression
is far cheaper to build than dozens of Column calls, and stays native.
"""

from __future__ import annotations


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_array(items) -> str:
    return "array(" + ", ".join(quoted(i) for i in items) + ")"
