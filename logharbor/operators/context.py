"""Surrounding lines of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.functions.text import cut_context
from logharbor.operators.positions import at_positions, file_of, line_of, position_masks, with_position
from logharbor.runtime import cut_lineage


def add_context(matches: DataFrame, lines: DataFrame, context_lines: int, bound: int | None = None) -> DataFrame:
    """Add ``context``: lines i-c .. i+c of the unfiltered file, joined and cut.

    The positions asked for filter the scan of the lines, so that only lines
    near a match, cut to what can appear in the result, meet the asked positions;
    the matches themselves join once their context is there. Matches are written
    first, since both steps read them. ``bound`` is their greatest number, if known.
    """
    c = max(int(context_lines), 0)
    matches = cut_lineage(matches)
    asked = (
        matches.selectExpr("pos AS _match", f"explode(sequence({-c}, {c})) AS _offset", "pos")
        .withColumn("_target", F.expr("pos + _offset"))
        .where(f"{line_of('pos')} + _offset >= 0 AND {file_of('_target')} = {file_of('pos')}")
        .selectExpr("_match", "_offset", "_target AS pos")
    )
    around = at_positions(with_position(lines).selectExpr("pos", f"{cut_context('line')} AS _text"), position_masks(asked, None if bound is None else bound * (2 * c + 1)))
    ordered = "array_join(transform(array_sort(_parts), p -> p._text), '\\n')"
    contexts = (
        around.join(asked, "pos").groupBy("_match")
        .agg(F.collect_list(F.struct("_offset", "_text")).alias("_parts"))
        .selectExpr("_match AS pos", f"{cut_context(ordered)} AS context")
    )
    return matches.join(contexts, "pos")
