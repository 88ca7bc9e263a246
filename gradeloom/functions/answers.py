"""Finding final answers in generated text: boxes, letters, markers, option routing. Column expressions, in the JVM.

Boxes may hold braces of any depth: those that a pattern of four levels can't close are found by a scan over the text's braces (``closed``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_think, occurrences, once, strip

_NEST = r"[^{}]"
for _ in range(4):
    _NEST = rf"(?:[^{{}}]|\{{{_NEST}*\}})"
BOX = rf"\\boxed\{{({_NEST}*)\}}"
#: What may stand between boxes of one group.
GAP = r"^[\s,\$\.\;\:\-\&\\]*$"


#: Stand-ins for braces inside deep boxes, from the private use area.
_LEFT, _RIGHT = "\ue000", "\ue001"


def _masked(c: Column) -> Column:
    """A text in which braces inside boxes that are closed are stand-ins, whatever their depth; one scan over the pieces that end in a brace."""
    frame = "array<struct<text:string,box:boolean>>"
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(False).alias("box"))).cast(frame)

    def step(stack: Column, piece: Column) -> Column:
        top, rest = F.element_at(stack, -1), F.slice(stack, F.lit(1), F.size(stack) - 1)
        with_ = lambda below, frame_, text: F.concat(below, F.array(F.struct(F.concat(frame_["text"], text).alias("text"), frame_["box"].alias("box"))))
        body = F.left(piece, F.length(piece) - 1)
        opened = F.concat(with_(rest, top, body), F.array(F.struct(F.lit("").alias("text"), piece.endswith("\\boxed{").alias("box"))))
        content = F.concat(top["text"], body)
        inside = F.when(top["box"], F.translate(content, "{}", _LEFT + _RIGHT)).otherwise(content)
        shut = with_(F.slice(stack, F.lit(1), F.size(stack) - 2), F.element_at(stack, -2), F.concat(F.lit("{"), inside, F.lit("}")))
        return F.when(piece.endswith("{"), opened).when(piece.endswith("}") & (F.size(stack) > 1), shut).otherwise(with_(rest, top, piece))

    return F.aggregate(F.split(c, r"(?<=[{}])", -1), start, step, lambda stack: F.array_join(F.transform(stack, lambda f: f["text"]), "{"))


def closed(c: Column) -> Column:
    """A text of which ``BOX`` finds every closed box: the text itself, or one with stand-ins in boxes too deep for the pattern."""
    return F.when(occurrences(c, "\\boxed{") > F.regexp_count(c, F.lit(BOX)), _masked(c)).otherwise(c)


def opened(c: Column) -> Column:
    """Stand-ins as braces again."""
    return F.translate(c, _LEFT + _RIGHT, "{}")


def unboxed(c: Column) -> Column:
    """Boxes replaced by their contents, boxes in boxes too."""
    deep = once(closed(c), lambda t: opened(F.regexp_replace(t, BOX, "$1")))
    return once(once(deep, lambda t: F.when(t.contains("\\boxed{"), opened(F.regexp_replace(closed(t), BOX, "$1"))).otherwise(t)), lambda t: F.when(t.contains("\\boxed{"), opened(F.regexp_replace(closed(t), BOX, "$1"))).otherwise(t))


def boxes(c: Column) -> Column:
    """Contents of all boxes that aren't empty, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(closed(c), F.lit(BOX), F.lit(1)), lambda x: F.trim(opened(x))), lambda x: x != "")


def last_box(c: Column) -> Column:
    """The content of the last box; "" if there is none."""
    found = boxes(c)
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))


def last_box_group(c: Column) -> Column:
    """Contents of the last run of boxes with nothing but separators between them."""
    return once(closed(c), _last_group)


def _last_group(c: Column) -> Column:
    contents, gaps = F.regexp_extract_all(c, F.lit(BOX), F.lit(1)), F.split(c, BOX, -1)
    n = F.size(contents)
    breaks = F.filter(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(gaps, i).rlike(GAP))
    first = F.coalesce(F.array_max(breaks), F.lit(0))
    return F.transform(F.when(n > 0, F.slice(contents, first + 1, n - first)).otherwise(F.array().cast("array<string>")), opened)


def open_box(c: Column) -> Column:
    """What stands behind the last box that is never closed, to the end of the text; "" if every box is closed."""
    rest = F.substring_index(once(closed(c), lambda t: F.regexp_replace(t, BOX, "")), "\\boxed{", -1)
    return F.when(occurrences(once(closed(c), lambda t: F.regexp_replace(t, BOX, "")), "\\boxed{") > 0, F.trim(opened(rest))).otherwise("")


#: A framed box as well as a plain one.
FRAMED = r"\\(?:boxed|fbox)\s*\{"


def last_framed(c: Column) -> Column:
    """The content of the last closed box, of a plain or a framed one; without any, what stands behind the last one that is never closed, to the end; "" if there is none."""
    plain = once(c, lambda t: F.regexp_replace(t, FRAMED, r"\\boxed{"))
    return once(plain, lambda t: F.coalesce(F.nullif(last_box(t), F.lit("")), open_box(t)))


def answer_box(c: Column) -> Column:
    """The last closed box behind the last FINAL_ANSWERS; null if that isn't there or no box behind it is closed."""
    behind = F.substring_index(c, "FINAL_ANSWERS", -1)
    return F.when(c.contains("FINAL_ANSWERS"), F.nullif(once(behind, last_box), F.lit("")))


def top_level_split(c: Column) -> Column:
    """Items between commas that stand in no bracket; brackets are ( [ <, and \\{ \\} count as ( )."""
    text = c
    for a, b in (("\\{", "("), ("\\}", ")"), ("\\rangle", ")"), ("\\langle", "(")):
        text = F.replace(text, F.lit(a), F.lit(b))
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("items"))

    def step(acc: Column, ch: Column) -> Column:
        last, rest = F.element_at(acc["items"], -1), F.slice(acc["items"], F.lit(1), F.size(acc["items"]) - 1)
        cut = (ch == ",") & (acc["depth"] == 0)
        depth = acc["depth"] + F.when(ch.isin("(", "[", "<"), 1).when(ch.isin(")", "]", ">"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(cut, F.concat(acc["items"], F.array(F.lit("")))).otherwise(F.concat(rest, F.array(F.concat(last, ch)))).alias("items"))

    scanned = F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), start, step, lambda acc: acc["items"])
    # Without brackets in brackets, a comma stands in one exactly if the next bracket closes.
    flat = text.rlike(r"^(?:[^()\[\]<>]|[(\[<][^()\[\]<>]*[)\]>])*$")
    items = F.when(flat, F.split(text, r",(?![^(\[<]*[)\]>])", -1)).otherwise(scanned)
    return F.transform(items, lambda x: strip(F.regexp_replace(strip(x), r"^\$+|\$+$", "")))


#: What announces an answer that follows, and one that stands before.
AHEAD, BEHIND = ("answer is", "answer:", "answer :"), ("is the ans", "is our ans")


def explicit_answer(c: Column, behind: tuple[str, ...] = BEHIND, first: bool = False) -> Column:
    """The answer that a text announces: after "herefore", after a marker, then a box, what stands before a phrase of ``behind``, or after another phrase; null if none.

    Where a phrase of ``behind`` stands several times, the answer is before the last one, or, with ``first``, before the first.
    """
    text = F.substring_index(F.regexp_replace(c, r"[\s,.:;!?=\\]+$", ""), "herefore", -1)
    text = F.substring_index(F.substring_index(text, "#### ", -1), "# Answer\n\n", -1)
    return once(F.trim(text), lambda t: _explicit_answer(t, behind, first))


def _explicit_answer(text: Column, behind: tuple[str, ...], first: bool) -> Column:
    group = last_box_group(after_think(text))
    boxed = F.when(F.size(group) > 0, F.array_join(group, ", ")).otherwise(F.coalesce(F.nullif(last_box(text), F.lit("")), text))
    out = F.when(text.contains("oxed{"), boxed)
    for phrase in behind:
        before = F.trim(F.substring_index(text, phrase, 1) if first else F.element_at(F.split(text, phrase, -1), -2))
        out = out.when(text.contains(phrase), F.trim(F.regexp_extract(before, r"([^,.]*)$", 1)))
    for phrase in AHEAD:
        out = out.when(text.contains(phrase), F.regexp_replace(F.trim(F.substring_index(text, phrase, -1)), r"^\$(.*)\$$", "$1"))
    return out


def last_formula(c: Column) -> Column:
    """What the last pair of formula marks encloses; "" if there is none."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)(?:\$|\\\(|\\\[)([^$]+?)(?:\$|\\\)|\\\])"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))


def last_number(c: Column) -> Column:
    """The last number of a text, thousands separators removed; "" if there is none."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"-?\d*\.?\d+"), F.lit(0))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))


def extracted_answer(c: Column, behind: tuple[str, ...] = BEHIND, first: bool = False) -> Column:
    """The announced answer, else the last formula, else the last number."""
    return F.coalesce(explicit_answer(c, behind, first), F.nullif(last_formula(c), F.lit("")), last_number(c))


#: What announces a letter, broadly and narrowly.
BROAD = r"(?i)(?:correct\s+option\s+is|correct\s+answer\s+is|answer\s+is|therefore|thus|hence|i\s+choose|choose|selected|option|choice)\s*[:\s]*\(?([A-Z])\)?\b"
NARROW = r"(?i)(?:option|choice|answer\s+is)\s*[:\s]*\(?([A-Z])\)?\b"


def letter(c: Column, options: Column | None = None, phrases: str = BROAD) -> Column:
    """The chosen letter: a boxed letter, a boxed option's text, the last phrase, the last single capital (among the options); "" if none."""
    tail, none = after_think(c), F.lit("")
    one = r"\\boxed\{\s*([A-Za-z])\s*\}"
    boxed = F.upper(F.coalesce(F.nullif(F.regexp_extract(tail, one, 1), none), F.nullif(F.regexp_extract(c, one, 1), none)))
    said = F.regexp_extract_all(tail, F.lit(phrases), F.lit(1))
    said = F.upper(F.get(said, F.size(said) - 1))
    capitals = F.regexp_extract_all(F.upper(tail), F.lit(r"\b([A-Z])\b"), F.lit(1))
    if options is None:
        return F.coalesce(boxed, said, F.get(capitals, F.size(capitals) - 1), none)
    group = last_box_group(tail)
    content = F.trim(F.get(group, F.size(group) - 1))
    at = F.array_position(F.transform(options, lambda x: F.trim(x)), content)
    by_value = F.when(at > 0, F.char(at + 64))
    n = F.coalesce(F.size(options), F.lit(0))
    capitals = F.filter(capitals, lambda x: (n <= 0) | (F.ascii(x) - 65 < n))
    return F.coalesce(boxed, by_value, said, F.get(capitals, F.size(capitals) - 1), none)


def letters(c: Column, options: Column) -> Column:
    """The chosen letters, one or several, all among the options (any, if there are none): a box of letters, a boxed option's text, the last phrase; "" if none."""
    n = F.coalesce(F.size(options), F.lit(0))
    within = lambda x: (x != "") & F.forall(F.filter(F.split(x, ""), lambda ch: ch != ""), lambda ch: (ch >= "A") & (ch <= "Z") & ((n <= 0) | (F.ascii(ch) - 65 < n)))

    def chosen(tail: Column) -> Column:
        inner = F.coalesce(F.nullif(last_box(tail), F.lit("")), last_box(c))
        compact = F.upper(F.regexp_replace(inner, r"\s+", ""))
        at = F.coalesce(F.array_position(F.transform(options, lambda x: F.trim(x)), F.trim(inner)), F.lit(0))
        said = F.regexp_extract_all(tail, F.lit(BROAD.replace("([A-Z])", "([A-Z]+)")), F.lit(1))
        said = F.upper(F.coalesce(F.get(said, F.size(said) - 1), F.lit("")))
        return F.when(compact.rlike("^[A-Z]+$") & within(compact), compact).when((inner != "") & (at > 0), F.char(at + 64)).when(within(said), said).otherwise("")

    return once(after_think(c), chosen)


def expected_answers(question: Column, gold: Column | None = None) -> Column:
    """Answers that a question asks for: its blanks; without any, as many as the gold answers that aren't empty, if they are given; 1 at least."""
    blanks = occurrences(question, "[ANS]")
    if gold is None:
        return F.greatest(F.lit(1).cast("long"), blanks)
    there = F.coalesce(F.size(F.filter(gold, lambda g: F.trim(g) != "")), F.lit(0)).cast("long")
    return F.when(blanks > 0, blanks).otherwise(F.greatest(F.lit(1).cast("long"), there))


def _inline(question: Column, letters: str) -> Column:
    return F.transform(F.regexp_extract_all(question, F.lit(rf"(?<![A-Za-z0-9])([{letters}])[\.\)]\s+"), F.lit(1)), lambda x: x)


def mcq_variant(name: str, question: Column, options: Column, gold: Column) -> Column:
    """Named tests of whether a question is multiple choice; they differ on purpose and aren't to be merged.

    substring: options, or A and B markers anywhere. gold_az: options, or gold of capitals and inline markers A and B.
    gold_aj: the same with letters to J, gold in any case. gold_any: letters to Z, gold in any case. layout: an options list or an A. ... B. layout.
    words: markers A and B as words with space after them. single: options, or a gold of one capital. bare: markers without "(A)".
    """
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    if name == "substring":
        both = [question.contains(f"{x}.") | question.contains(f"{x})") | question.contains(f"({x})") for x in "AB"]
        return has | (both[0] & both[1])
    if name in ("gold_az", "gold_aj", "gold_any"):
        last, upper = "J" if name == "gold_aj" else "Z", (lambda x: x) if name == "gold_az" else F.upper
        marks = _inline(question, f"A-{last}")
        capitals = (F.size(gold) > 0) & F.forall(gold, lambda x: upper(x).rlike(rf"^[A-{last}]+$"))
        return has | (capitals & F.array_contains(marks, "A") & F.array_contains(marks, "B"))
    if name == "layout":
        return question.rlike(r"(?is)options:|(?<![A-Za-z0-9])A[.)]\s.*(?<![A-Za-z0-9])B[.)]\s|\( \)\s*A:")
    if name == "words":
        return question.rlike(r"\bA[.)]\s+") & question.rlike(r"\bB[.)]\s+")
    if name == "single":
        return has | ((F.size(gold) == 1) & F.get(gold, F.lit(0)).rlike(r"^[A-Z]$"))
    if name == "bare":
        return (question.contains("A.") | question.contains("A)")) & (question.contains("B.") | question.contains("B)"))
    raise ValueError(f"no such test: {name}")


def row_format(question: Column, options: Column, gold: Column) -> Column:
    """mcq_options, mcq_inline or free: what a question looks like."""
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    return F.when(has, "mcq_options").when(mcq_variant("gold_aj", question, options, gold), "mcq_inline").otherwise("free")


MCQ_VARIANTS = ("substring", "gold_az", "gold_aj", "gold_any", "layout", "words", "single", "bare")
#: Words that show an answer is still reasoning.
REASONING_WORDS = ("let's", "wait", "case", "suppose", "strategy", "turn", "therefore", "because", "we need", "the problem")


def looks_like_reasoning(c: Column) -> Column:
    found = (F.length(c) > 250) | c.contains("\n")
    for word in REASONING_WORDS:
        found = found | F.lower(c).contains(word)
    return found


def match_count(answers: Column, expected: Column) -> Column:
    """Answers cut to the number expected: the last one, all, a single one split, the last so many, or none."""
    n = F.size(answers)
    alone = top_level_split(F.get(answers, F.lit(0)))
    last = F.slice(answers, F.greatest(F.lit(1), n - expected.cast("int") + 1), F.greatest(F.lit(0), expected.cast("int")))
    return F.when(n == 0, answers).when(expected <= 1, F.slice(answers, n, F.lit(1))).when(n == expected, answers).when((n == 1) & (F.size(alone) == expected), alone).when(n > expected, last).otherwise(F.array().cast("array<string>"))
