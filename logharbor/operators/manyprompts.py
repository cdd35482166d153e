"""Many prompts against all lines at once.

A line matches a prompt by any of the prompt's terms or by a problem tag. Terms are
found through their trigrams: a line that holds a term holds the term's rarest
trigram, so lines meet terms by that trigram alone and are then checked. Lines are
counted by the set of terms they hold, and sets meet prompts; no line is ever
paired with a prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import quoted
from logharbor.functions.events import error_rows, folded
from logharbor.functions.prompts import prompt_terms, search_text
from logharbor.operators.positions import with_position
from logharbor.runtime import cut_lineage, small_side

_GRAM = 3


def grams(text: str) -> str:
    """Distinct trigrams of a text, none for a shorter one."""
    return (f"IF(char_length({text}) < {_GRAM}, CAST(array() AS ARRAY<STRING>), "
            f"array_distinct(transform(sequence(1, char_length({text}) - {_GRAM - 1}), i -> substring({text}, i, {_GRAM}))))")


def lines_with_terms(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """``pos, term`` of each line and each of the distinct ``terms(term)`` that it holds, case folded.

    Trigrams of terms are counted over all lines, those of the lines filtered by
    them first. The join key is each term's rarest trigram; a term whose trigrams
    do not all occur is in no line.
    """
    low = lines.select("pos", F.explode(F.array(F.expr(folded("line")))).alias("_low"))
    of_term = cut_lineage(terms.select("term", F.expr(f"explode({grams('term')})").alias("gram")))
    wanted, _ = small_side(of_term.select("gram").distinct())
    of_line = low.select("pos", "_low", F.expr(f"explode({grams('_low')})").alias("gram")).select("pos", "gram").join(wanted, "gram")
    counts = of_line.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        of_term.join(counts, "gram", "left").groupBy("term")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
        .where("least > 0").select("term", "gram")
    )
    keys, _ = small_side(rarest)
    met = low.select("pos", "_low", F.expr(f"explode({grams('_low')})").alias("gram")).join(keys, "gram")
    return met.where("contains(_low, term)").select("pos", "term")


def count_matches(lines: DataFrame, prompts: DataFrame) -> DataFrame:
    """``prompt_id, terms, matches``: lines that match each prompt of ``prompts(prompt_id, prompt)``.

    ``terms`` are the distinct ones. A prompt without terms looks for the fallback
    pattern. Prompts with the same terms are answered once; a null prompt has no
    terms; every prompt has a row, whatever it matches.
    """
    lines = with_position(lines)
    asked = prompts.select("prompt_id", F.explode(F.array(F.expr(search_text("coalesce(prompt, '')")))).alias("_text"))
    asked = cut_lineage(asked.select("prompt_id", F.expr(f"array_sort(array_distinct({prompt_terms('_text')}))").alias("terms")))
    sets = cut_lineage(asked.select("terms").distinct())
    of_set = sets.select("terms", F.explode("terms").alias("term"))
    plain = lines.where(f"NOT ({error_rows(lines)})").select("pos", "line")
    held = lines_with_terms(plain, of_set.select("term").distinct())
    # Lines by the set of terms they hold: few different sets, however many lines.
    kinds = held.groupBy("pos").agg(F.array_sort(F.collect_set("term")).alias("held")).groupBy("held").agg(F.count("*").alias("n"))
    kinds = cut_lineage(kinds.select("held", "n"))
    met = kinds.select("held", "n", F.explode("held").alias("term")).join(of_set, "term").select("terms", "held", "n").distinct()
    by_terms = met.groupBy("terms").agg(F.sum("n").alias("_by_terms"))
    fallback = f"(line RLIKE {quoted('(?iU)' + K.FALLBACK_PATTERN)})"
    errors = lines.agg(F.count_if(F.expr(error_rows(lines)))).scalar()
    others = lines.agg(F.count_if(F.expr(f"NOT ({error_rows(lines)}) AND {fallback}"))).scalar()
    found = asked.join(by_terms, "terms", "left").withColumns({"_errors": errors, "_fallback": others})
    return found.select("prompt_id", "terms", F.expr(
        "coalesce(_errors, 0L) + IF(size(terms) = 0, coalesce(_fallback, 0L), coalesce(_by_terms, 0L))").alias("matches"))
