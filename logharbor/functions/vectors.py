"""Arithmetic on ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns, in double."""

from __future__ import annotations


def dot(a: str, b: str) -> str:
    """Sum of products over the length of the shorter vector."""
    products = f"zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE))"
    return f"aggregate({products}, 0D, (total, p) -> total + coalesce(p, 0D))"


def norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (total, x) -> total + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def cosine(a: str, b: str, norm_a: str | None = None, norm_b: str | None = None) -> str:
    """Cosine similarity; 0.0 when either vector has no length."""
    na, nb = norm_a or norm(a), norm_b or norm(b)
    return f"coalesce(try_divide({dot(a, b)}, {na} * {nb}), 0D)"
