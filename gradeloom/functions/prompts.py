"""Prompts and chat rows as column expressions.

A question is routed to a system prompt by whether it has options, how many blanks it has and what it asks for; its user prompt is the question and its
options. Four kinds of fallback ask again after a response that couldn't be used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import occurrences, option_lines, strip

#: The wordings of system prompts.
BASE = r"""You are solving a math benchmark problem. Solve efficiently and keep visible
work short. Do not box anything before the final answer block."""

MCQ = r"""Choose the correct option. Keep reasoning short.

Final answer rules:
- Output exactly one final \boxed{}.
- The box must contain only the option letter.
- For select-all/check-all, use combined letters with no commas, e.g. BCE.
- Never box the option value or explanation.
- If unsure, still choose the best option and finish.

Output format:
FINAL_ANSWERS:
\boxed{A}"""

FREE = r"""Solve the problem. Keep reasoning short. Use only the steps needed.
Once the answer is known, stop reasoning and write FINAL_ANSWERS.
Do not re-check repeatedly.

Final answer rules:
- Output exactly one final \boxed{}.
- If there are multiple [ANS] blanks, put answers in the same box separated by commas.
- Answer every [ANS] blank in order; do not add extra answers.
- If one answer is a point, interval, set, list, solution list, or confidence interval, wrap it in parentheses/brackets.
- No units, labels, [ANS], explanations, or words inside the box.
- Only round if the problem explicitly says to round.
- Never apply standard rounding. For money, percent, units, statistics, and trig values, keep 10-15 significant digits unless rounding is stated.
- For formula/expression/equation blanks, use explicit multiplication and clear powers.
- Follow the notation requested by the problem.
- If asked for a formula, model, equation, quotient, or composite function, output that expression, not just a simplified number.
- Preserve the requested form; do not expand or substitute unless asked.

Output format:
FINAL_ANSWERS:
\boxed{answer1, answer2, answer3}"""

MCQ_AGAIN = r"""/no_think
Choose the best option.

Output only:
FINAL_ANSWERS:
\boxed{A}"""

FREE_AGAIN = r"""/no_think
Rewrite only the final answers. Do not recompute.

Output exactly one \boxed{}.
If multiple answers are needed, separate them by commas inside the box.
No labels, units, or explanation.

FINAL_ANSWERS:
\boxed{answer1, answer2}"""

CONTINUE = r"""Continue from the previous reasoning. Do not restart the solution. Use the
previous work to finish the answer.

Output only:
FINAL_ANSWERS:
\boxed{answer}

No explanation. For MCQ, box only uppercase option letter(s). For free-response
with multiple answers, put all answers in one box separated by commas."""

BOUNDED = r"""Solve concisely. Do not verify repeatedly. Use at most 8 short reasoning steps,
then finish the answer.

Output only:
FINAL_ANSWERS:
\boxed{answer}

No explanation after the final box. For MCQ, box only uppercase option letter(s).
For free-response with multiple answers, put all answers in one box separated by
commas."""

SHORT = r"""/no_think
Answer directly.

Output exactly one final \boxed{}.
For multiple answers, separate them by commas inside the box.
For MCQ, box only the uppercase option letter(s).

FINAL_ANSWERS:
\boxed{answer}"""

#: Suffixes of prompts by the kind of question.
SUFFIXES = {
    "formula": "Expression task: keep the requested symbolic form. Do not replace it with only a number.",
    "percentile": "Percentile task: use the introductory-statistics rank method unless another method is stated.",
    "stats": "Software/statistics task: give the requested numerical outputs with the shown precision style; do not invent extra outputs.",
    "selection": "This is a letter-answer or matching problem. Do not write option text. For several blanks, put the letters inside the one final box separated by commas. For select all that apply in one blank, output concatenated letters in option order, e.g. BCEG.",
    "algorithm": "For sequence/algorithm questions, compare the proposed output lists and choose the matching option letter.",
}
#: Wordings that choose a suffix, in order of precedence, as words or as other marks; the first kind that fits counts.
WORDINGS = {
    "formula": (("formula", "model", "equation", "quotient", "composite", "expression", r"function\s+rule"), (r"N\(T\(t\)\)", r"P\(c\)")),
    "percentile": (("percentile", r"P_?\d+"), ()),
    "stats": (("software", r"chi-?squared?", "regression", "correlation", "p-?value"), ()),
    "selection": ((r"embedded\s+[A-Z]/[A-Z]", "matching", "match", "select", r"best\s+response", r"conclusion\s+is", r"which\s+statement", r"which\s+of", "choices?", "options?"), (r"(?<![A-Za-z0-9])A[.)]\s+.*(?<![A-Za-z0-9])B[.)]\s+",)),
}
ALGORITHM = ("sequence", "algorithm", r"output\s+list", "oeis", "recurrence", "iteration", "program")


def _asks(question: Column, words: tuple[str, ...], marks: tuple[str, ...] = ()) -> Column:
    return question.rlike("(?is)" + "|".join([rf"\b(?:{'|'.join(words)})\b", *marks]))


def suffix(question: Column, options: Column) -> Column:
    """The kind of suffix of a question's prompt: of those with options, algorithm or none; of others the first of the wordings that fits, or none."""
    chosen = None
    for kind, (words, marks) in WORDINGS.items():
        test = _asks(question, words, marks)
        chosen = F.when(test, kind) if chosen is None else chosen.when(test, kind)
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    return F.when(has, F.when(_asks(question, ALGORITHM), "algorithm").otherwise("none")).otherwise(chosen.otherwise("none"))


def count_line(question: Column) -> Column:
    """What a prompt says of the number of answers."""
    n = occurrences(question, "[ANS]")
    blanks = F.concat(F.lit("This problem has "), n.cast("string"), F.lit(" [ANS] blank"))
    one, more = F.concat(blanks, F.lit(". Return exactly 1 answer.")), F.concat(blanks, F.lit("s. Return exactly "), n.cast("string"), F.lit(" answers."))
    return F.when(n == 1, one).when(n > 1, more).otherwise("No [ANS] marker appears. Return exactly one final answer.")


def system(question: Column, options: Column) -> Column:
    """A question's system prompt."""
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    ends = F.element_at(F.create_map(*(F.lit(x) for pair in [*SUFFIXES.items(), ("none", "")] for x in pair)), suffix(question, options))
    return F.when(has, prompt(F.lit(BASE), F.lit(MCQ), ends)).otherwise(prompt(F.lit(BASE), count_line(question), F.lit(FREE), ends))


def user(question: Column, options: Column) -> Column:
    """A question's user prompt: the question, and its options if it has any."""
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    return F.when(has, F.concat(strip(question), F.lit("\n\nOptions:\n"), option_lines(options))).otherwise(strip(question))


#: Kinds of fallback with their system prompts for questions with options and without; those without also say how many answers (but "short").
FALLBACKS = {"format": (MCQ_AGAIN, FREE_AGAIN), "continuation": (CONTINUE, CONTINUE), "bounded": (BOUNDED, BOUNDED), "short": (SHORT, SHORT)}


def fallback(kind: str, question: Column, options: Column, response: Column, tail: Column, required: Column | None = None) -> Column:
    """system and user prompt of a kind of fallback. response: the previous one; tail: its end, for a continuation. ``required``: answers asked for, else blanks."""
    mcq, free = FALLBACKS[kind]
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    system_ = F.when(has, F.lit(mcq)).otherwise(F.lit(free) if kind == "short" else prompt(F.lit(free), count_line(question)))
    asked = F.greatest(F.lit(1).cast("long"), occurrences(question, "[ANS]"))
    count = asked if required is None else F.coalesce(required.cast("long"), asked)
    head = F.concat(F.lit("Problem:\n"), strip(question))
    middle = F.when(has, F.concat(F.lit("Options:\n"), option_lines(options))).otherwise(F.concat(F.lit("Required number of answers: "), count.cast("string")))
    before = strip(F.coalesce(response, F.lit("")))
    rest = {
        "format": F.when(before != "", F.concat(F.lit("Previous response:\n"), before)),
        "continuation": F.concat(F.lit("Previous response tail:\n"), F.coalesce(F.nullif(strip(F.coalesce(tail, F.lit(""))), F.lit("")), before)),
    }.get(kind, F.lit(None).cast("string"))
    return F.struct(system_.alias("system"), prompt(head, middle, rest).alias("user"))


def prompt(question: Column, *parts: Column) -> Column:
    """A question and what follows it, blank lines between, empty parts left out."""
    return F.array_join(F.filter(F.array(question, *parts), lambda x: x.isNotNull() & (x != "")), "\n\n")


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """The messages of a training row."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))))


def last_assistant(messages: Column) -> Column:
    """The content of the last assistant message; null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]


def roles_are(messages: Column, *roles: str) -> Column:
    return F.transform(messages, lambda m: m["role"]) == F.array(*map(F.lit, roles))


def chosen_finish(reasons: Column, chosen: Column, single: Column) -> Column:
    """The finish reason of the chosen sample, else the first one, else the single one, else ""."""
    return F.coalesce(F.when(chosen >= 0, F.get(reasons, chosen)), F.get(reasons, F.lit(0)), single, F.lit(""))


def label_mask(tokens: Column, start: Column) -> Column:
    """Token ids from a character offset on; -100 before it. tokens: array of structs with id and start."""
    return F.transform(tokens, lambda t: F.when(t["start"] >= start, t["id"]).otherwise(-100))
