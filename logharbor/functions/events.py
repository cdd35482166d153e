"""Event time, problem tags and time buckets of a log line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import quoted

TAG_NAMES = tuple(K.TAG_PATTERNS)


def is_wide(text: str) -> str:
    """True when the text holds characters outside ASCII."""
    return f"octet_length({text}) > char_length({text})"


def folded(text: str) -> str:
    """Lower case in which every letter equal to an ASCII letter without case is that letter.

    Beyond ASCII these are the dotted and dotless i, the long s and the kelvin
    sign, so only text outside ASCII is translated.
    """
    return f"lower(IF({is_wide(text)}, translate({text}, '\u0130\u0131\u017f\u212a', 'iisk'), {text}))"


def event_time(line: str) -> str:
    """First timestamp of the line as ``TIMESTAMP_NTZ``, null if there is none.

    The dash form wins over the slash form; an impossible date in the first
    form falls through to the second. Year 0 is not a date.
    """

    def parsed(pattern: str) -> str:
        text = f"regexp_extract({line}, {quoted(f'(?!0000)({pattern})|({pattern})')}, 1)"
        return f"try_cast(replace({text}, '/', '-') AS TIMESTAMP_NTZ)"

    return f"coalesce({parsed(K.DASH_TIMESTAMP)}, {parsed(K.SLASH_TIMESTAMP)})"


def has_tag(line: str, tag: str) -> str:
    """True when the line matches the tag's pattern.

    Java regular expressions cost far more than substring tests, so a line must
    hold one of the tag's hints before the pattern is tried. Unicode word and
    digit classes are slower again and only used for text outside ASCII.
    """
    hints = " OR ".join(f"contains({folded(line)}, {quoted(h)})" for h in K.TAG_HINTS[tag])
    case = "" if tag in K.CASE_SENSITIVE_TAGS else "i"
    wide = f"{line} RLIKE {quoted(f'(?{case}U)' + K.TAG_PATTERNS[tag])}"
    plain = f"{line} RLIKE {quoted(f'(?{case})' * bool(case) + K.TAG_PATTERNS[tag])}"
    if tag in K.TAG_PRECHECKS:
        plain = f"{line} RLIKE {quoted(K.TAG_PRECHECKS[tag])} AND {plain}"
    return f"(({hints}) AND IF({is_wide(line)}, {wide}, {plain}))"


def tag_mask(line: str) -> str:
    """All tags of a line in one integer, bit i for the i-th tag name."""
    bits = [f"IF({has_tag(line, tag)}, {1 << i}, 0)" for i, tag in enumerate(TAG_NAMES)]
    return f"coalesce({' + '.join(bits)}, 0)"


def mask_has(mask: str, tag: str) -> str:
    return f"(({mask} & {1 << TAG_NAMES.index(tag)}) <> 0)"


def mask_names(mask: str) -> str:
    """Tag names of a mask, in pattern order."""
    names = ", ".join(f"IF({mask_has(mask, t)}, {quoted(t)}, '')" for t in TAG_NAMES)
    return f"array_remove(array({names}), '')"


def tags(line: str) -> str:
    """Names of all matching tags, in pattern order."""
    return mask_names(f"({tag_mask(line)})")


def is_error(line: str) -> str:
    """True when any tag matches."""
    return "(" + " OR ".join(has_tag(line, t) for t in TAG_NAMES) + ")"


def bucket_start(ts: str, minutes: int) -> str:
    """Start of the bucket; buckets restart at every full hour.

    Seven-minute buckets therefore end an hour with a four-minute one, and
    widths of an hour or more all give hourly buckets.
    """
    return f"{ts} - make_dt_interval(0, 0, minute({ts}) % {int(minutes)}, second({ts}))"


def clock_text(ts: str) -> str:
    """``YYYY-MM-DD HH:MM:SS``."""
    return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"


def with_events(lines: DataFrame) -> DataFrame:
    """Add ``ts`` and ``tag_mask``; a landed table already carries them."""
    new = {"ts": event_time("line"), "tag_mask": tag_mask("line")}
    new = {name: F.expr(sql) for name, sql in new.items() if name not in lines.columns}
    return lines.withColumns(new) if new else lines


def with_time(lines: DataFrame) -> DataFrame:
    """Add ``ts`` only."""
    return lines if "ts" in lines.columns else lines.withColumn("ts", F.expr(event_time("line")))


def error_rows(lines: DataFrame) -> str:
    """Condition for lines carrying any tag, from the landed mask if there is one."""
    return "tag_mask <> 0" if "tag_mask" in lines.columns else is_error("line")
