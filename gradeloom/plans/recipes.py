"""Responses put together from columns, and SQL that takes them apart again.

The driver's texts hold no answer markup. A recipe is a SQL expression that both engines read, so both work on the same text of each row; what an
operator finds in it is then found once more by the other engine's own regular expressions.
"""

from __future__ import annotations

#: The beginning of a row's own text, on one line, before what a recipe adds.
OWN = "replace(left(text, 60), chr(10), ' ') || ' '"
_INNER = r"[^{}]"
for _ in range(7):
    _INNER = rf"(?:[^{{}}]|\{{{_INNER}*\}})"
#: A closed box with braces to seven levels: as a pattern with its content, and without a group.
BOX, BARE_BOX = rf"\\boxed\{{({_INNER}*)\}}", rf"\\boxed\{{(?:{_INNER}*)\}}"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def box(content: str) -> str:
    return f"chr(92) || 'boxed{{' || ({content}) || '}}'"


def case(key: str, *values: str) -> str:
    """The value for each remainder of ``key``; the last is for all others."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def last(items: str) -> str:
    return f"coalesce(list_extract({items}, -1), '')"


def boxes(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{BOX}', 1), lambda x: trim(x)), lambda x: x <> '')"


def last_box(text: str) -> str:
    return last(boxes(text))


def after_think(text: str) -> str:
    return last(f"string_split({text}, '</think>')")


def last_group(text: str) -> str:
    run = rf"({BARE_BOX}(?:[\s,$.;:\-&\\]*{BARE_BOX})*)"
    return f"regexp_extract_all({last(f"regexp_extract_all({text}, '{run}', 1)")}, '{BOX}', 1)"


def split(text: str) -> str:
    """Items between commas outside brackets, which hold no brackets themselves."""
    hidden = f"{text}"
    for _ in range(4):  # a bracket of up to five items
        hidden = rf"regexp_replace({hidden}, '([(\[][^()\[\]]*),([^()\[\]]*[)\]])', '\1' || chr(1) || '\2', 'g')"
    return f"list_transform(string_split({hidden}, ','), lambda x: trim(trim(trim(replace(x, chr(1), ',')), '$')))"


def count(text: str, what: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{what}', ''))) // {len(what)} AS BIGINT)"


def text(value: str) -> str:
    """A literal."""
    return "'" + value.replace("'", "''") + "'"
