"""Text functions as column expressions; each takes and returns columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it.
SPACE = r"(?U)[\s\x1C-\x1F\x85]"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once a row, however often f names it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Unicode-aware trim of both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """Line ends as LF, no more than one blank line in a row, trimmed."""
    lines = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def occurrences(c: Column, what: str) -> Column:
    """How often ``what`` stands in the text, without overlaps."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("long")


def after_think(c: Column) -> Column:
    """What follows the last end of a thinking block; the whole text if there is none."""
    return F.substring_index(c, "</think>", -1)


def reasoning_word_count(c: Column) -> Column:
    """Words inside the first thinking block, up to a final-answers marker."""
    inside = F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)
    return word_count(F.substring_index(inside, "FINAL_ANSWERS", 1))


def marked_final(c: Column) -> Column:
    """The answer after a ``####`` marker at the end of a worked solution; "" if there is none."""
    return F.regexp_extract(c, r"(?s)####\s*(.+?)\s*$", 1)


def short_text(c: Column, limit: int = 500) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def tail_chars(c: Column, tokens: int) -> Column:
    """The tail of a text that some tokens are reckoned to need: four characters each."""
    return F.right(c, F.lit(4 * tokens))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_name(c: Column) -> Column:
    """A file name made of an id."""
    return F.regexp_replace(F.trim(c.cast("string")), r"[^A-Za-z0-9_.\-]+", "_")


def request_id(position: Column, task_id: Column) -> Column:
    """An id for a request of a batch: its position and the start of the task id's SHA-1."""
    return F.concat(F.lit("worker-"), F.lpad(position.cast("string"), 6, "0"), F.lit("-"), F.left(F.sha1(task_id.cast("string").cast("binary")), F.lit(10)))


#: Words that count as true and as false.
TRUE_WORDS = ("true", "yes", "t", "y", "1", "correct", "right")
FALSE_WORDS = ("false", "no", "f", "n", "0", "incorrect", "wrong")


def as_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), "True").when(word.isin(*FALSE_WORDS), "False")


def as_weekday(c: Column) -> Column:
    word, out = F.lower(F.trim(c)), None
    for day, more in (("Monday", ("mon",)), ("Tuesday", ("tue", "tues")), ("Wednesday", ("wed",)), ("Thursday", ("thu", "thur", "thurs")), ("Friday", ("fri",)), ("Saturday", ("sat",)), ("Sunday", ("sun",))):
        test = word.isin(day.lower(), *more)
        out = F.when(test, day) if out is None else out.when(test, day)
    return out


def option_lines(options: Column) -> Column:
    """Options as lines "A. first", "B. second" ..."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), F.trim(x))), "\n")


def plain_number(c: Column) -> Column:
    """An answer without thousands separators and signs of money and share."""
    return F.regexp_replace(F.replace(F.trim(c), F.lit(","), F.lit("")), r"^[$%]+|[$%]+$", "")


def decimals(c: Column) -> Column:
    """Digits after the point of a plain number; null if the text isn't one."""
    n = plain_number(c)
    return F.when(n.rlike(r"^(?i)[-+]?(\d+\.\d*|\.\d+)(e[-+]?\d+)?$"), F.length(F.regexp_extract(n, r"\.(\d*)", 1))).when(n.rlike(r"^(?i)[-+]?\d+(e[-+]?\d+)?$"), F.lit(0)).cast("long")


def violates_rounding(answer: Column, places: Column) -> Column:
    """Whether a plain number has digits other than 0 beyond the places asked for."""
    beyond = F.substring(F.regexp_extract(plain_number(answer), r"\.(\d*)", 1), places.cast("int") + 1, F.lit(1000))
    return F.coalesce((decimals(answer) > places) & beyond.rlike("[1-9]"), F.lit(False))
