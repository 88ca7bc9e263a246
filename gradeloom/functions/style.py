"""One plain spelling for answers that are expressions: LaTeX to operators and calls, explicit products and powers.

An answer is cut into tokens once and its brackets become a tree. Fractions, roots and powers are printed from the tree, products are put in where two
factors touch, and calls get their brackets, so nesting may have any depth. The work is a scan of one short text, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of functions, commands that lose their backslash, words of a question that ask for an expression, answers that are words.
NAMES = ("sin", "cos", "tan", "sec", "csc", "cot", "asin", "acos", "atan", "ln", "log", "exp", "sqrt")
PLAIN_COMMANDS = ("pi", "ln", "log", "sin", "cos", "tan", "sec", "csc", "cot")
ASKS = ("formula", "expression", "equation", "model", "quotient", "composite", "function", "simplify", "factor", "polynomial", "derivative", "integral", "write", "solve for")
WORD_ANSWERS = ("NONE", "TRUE", "FALSE", "YES", "NO", "T", "F", "Y", "N", "A", "B", "C", "D", "E", "F", "G", "H", "I", "J")

_TOKEN = re.compile(r"(?P<space>\s+)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<command>\\[A-Za-z]+)|(?P<word>[A-Za-z]+)|(?P<power>\*\*|\^)|(?P<open>[({])|(?P<close>[)}])|(?P<other>.)", re.S)
_CLOSES = {"(": ")", "{": "}"}
_SIGNS = {"−": "-", "×": "*", "·": "*"}
_TIGHT = frozenset("=+-/,*")


class Node:
    """A token, or a bracketed list of nodes. kind: number, word, call (a function's name), command, power, sign, group, space."""

    __slots__ = ("inner", "kind", "text")

    def __init__(self, kind: str, text: str, inner: list[Node] | None = None) -> None:
        self.kind, self.text, self.inner = kind, text, inner

    @property
    def flat(self) -> str:
        return self.text if self.inner is None else self.text + "".join(n.flat for n in self.inner) + _CLOSES[self.text]


def tree(text: str) -> list[Node]:
    """Nodes of a text; a bracket without a partner is a plain sign."""
    found = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text)]
    partner, open_ = {}, []
    for i, (kind, token) in enumerate(found):
        if kind == "open":
            open_.append(i)
        elif kind == "close" and open_ and _CLOSES[found[open_[-1]][1]] == token:
            partner[open_.pop()] = i
    ends = set(partner.values())
    stack: list[list[Node]] = [[]]
    for i, (kind, token) in enumerate(found):
        if i in partner:
            group = Node("group", token, [])
            stack[-1].append(group)
            stack.append(group.inner)
        elif i in ends:
            stack.pop()
        elif kind == "command":
            bare = token[1:]
            if bare in ("left", "right"):
                continue
            sign = {"cdot": "*", "times": "*"}.get(bare)
            named = bare in PLAIN_COMMANDS
            stack[-1].append(Node("sign", sign) if sign else Node("call" if named and bare != "pi" else "word" if named else "command", bare if named else token))
        elif kind == "word":
            stack[-1].append(Node("call" if token.lower() in NAMES else "word", token))
        else:
            stack[-1].append(Node({"open": "sign", "close": "sign", "other": "sign"}.get(kind, kind), _SIGNS.get(token, token)))
    return stack[0]


def plain(nodes: list[Node]) -> list[Node]:
    """Fractions as quotients of brackets (a lone root on top needs none) and roots as calls."""
    out, i = [], 0
    while i < len(nodes):
        node = nodes[i]
        after = nodes[i + 1 : i + 3]
        braced = [n.kind == "group" and n.text == "{" and bool(n.inner) for n in after]
        if node.kind == "command" and node.text in ("\\frac", "\\dfrac", "\\tfrac") and braced == [True, True]:
            top, bottom = (plain(n.inner) for n in after)
            root = len(after[0].inner) == 2 and after[0].inner[0].text == "\\sqrt" and len(top) == 2
            out += [*(top if root else [Node("group", "(", top)]), Node("sign", "/"), *(bottom if root else [Node("group", "(", bottom)])]
            i += 3
        elif node.kind == "command" and node.text == "\\sqrt" and braced[:1] == [True]:
            out += [Node("call", "sqrt"), Node("group", "(", plain(after[0].inner))]
            i += 2
        else:
            out.append(node if node.inner is None else Node("group", node.text, plain(node.inner)))
            i += 1
    return out


def every(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        yield n
        yield from every(n.inner or [])


def reads_as_expression(nodes: list[Node], question: str) -> bool:
    """Whether an answer is no mere word and its question asks for an expression, or it has letters beside operators, a call, or a power."""
    text = "".join(n.flat for n in nodes).strip()
    if text.upper() in WORD_ANSWERS or re.fullmatch(r"[A-Za-z][A-Za-z ]{1,25}", text):
        return False
    asked = question.lower()
    if any(word in asked for word in ASKS):
        return True
    flat = list(every(nodes))
    called = any(a.kind == "call" and b.kind == "group" for a, b in zip(flat, flat[1:], strict=False))
    lettered = any(n.kind in ("word", "call", "command") for n in flat)
    return called or any(n.kind == "power" for n in flat) or (lettered and any(n.kind == "sign" and n.text in "+-*/=" for n in flat))


def renamed(nodes: list[Node]) -> list[Node]:
    """theta as t, and as the argument of a function that stands right before it."""
    out: list[Node] = []
    for node in nodes:
        word = node.text.lower().lstrip("\\") if node.kind in ("word", "command") else ""
        if word == "theta" or (word.endswith("theta") and word[:-5] in NAMES):
            while out and out[-1].kind == "space" and len(out) > 1 and out[-2].kind == "call":
                out.pop()
            if word != "theta":
                out.append(Node("call", node.text[:-5]))
            t = Node("word", "t")
            out.append(Node("group", "(", [t]) if out and out[-1].kind == "call" else t)
        else:
            out.append(node if node.inner is None else Node("group", node.text, renamed(node.inner)))
    return out


def factors(word: str) -> str:
    """Two or three letters of an exponent are symbols, unless they name a function."""
    return "*".join(word) if len(word) in (2, 3) and word.lower() not in NAMES else word


def expanded(nodes: list[Node]) -> str:
    """An expression's nodes with calls, powers and products written out."""
    parts: list[tuple[str, str]] = []  # what it is, and its text
    i = 0

    def skip(at: int) -> int:
        while at < len(nodes) and nodes[at].kind == "space":
            at += 1
        return at

    def exponent(at: int) -> tuple[str, int]:
        """What follows a power sign, in brackets; the sign's own text if nothing fits."""
        node = nodes[at] if at < len(nodes) else None
        caret = nodes[at - 1].text == "^"
        if node is not None and node.kind == "group" and node.inner and (node.text == "{" or caret):
            inside = node.inner
            return "**(" + (factors(inside[0].text) if node.text == "{" and len(inside) == 1 and inside[0].kind in ("word", "call") else expanded(inside)) + ")", at + 1
        if caret and node is not None:
            minus = node.kind == "sign" and node.text == "-" and at + 1 < len(nodes) and nodes[at + 1].kind == "number"
            if node.kind == "number" or minus:
                return f"**({'-' if minus else ''}{nodes[at + minus].text})", at + 1 + minus
            if node.kind in ("word", "call"):
                return f"**({factors(node.text)})", at + 1
        return nodes[at - 1].text, at

    while i < len(nodes):
        node = nodes[i]
        if node.kind == "call":
            at = skip(i + 1)
            if at < len(nodes) and nodes[at].kind == "power":  # a power of the function: sin^2(x), sin^2 x
                p = skip(at + 1)
                digits = nodes[p].text if p < len(nodes) and nodes[p].kind == "number" else nodes[p].inner[0].text if p < len(nodes) and nodes[p].kind == "group" and nodes[p].text == "(" and len(nodes[p].inner) == 1 and nodes[p].inner[0].kind == "number" else ""
                q = skip(p + 1)
                if digits.isdigit() and q < len(nodes):
                    if nodes[q].kind == "sign" and nodes[q].text == "*":
                        q = skip(q + 1)
                        arg = nodes[q] if q < len(nodes) and nodes[q].kind == "word" and len(nodes[q].text) == 1 else None
                    else:
                        arg = nodes[q] if (nodes[q].kind == "group" and nodes[q].text == "(") or (nodes[q].kind == "word" and len(nodes[q].text) == 1) else None
                    if arg is not None:
                        parts.append(("closed", f"{node.text}({expanded(arg.inner) if arg.inner is not None else arg.text})**{digits}"))
                        i = q + 1
                        continue
            elif at > i + 1 and at < len(nodes) and nodes[at].kind in ("word", "number", "call"):  # ln p, sin 2x
                end = at
                while end < len(nodes) and nodes[end].kind in ("word", "number", "call"):
                    end += 1
                parts.append(("closed", f"{node.text}({expanded(nodes[at:end])})"))
                i = end
                continue
            parts.append(("call", node.text))
        elif node.kind == "power":
            text, i = exponent(i + 1)
            parts.append(("closed" if text.endswith(")") else "sign", text))
            continue
        elif node.kind == "group":
            parts.append(("group", node.text + expanded(node.inner) + _CLOSES[node.text]))
        else:
            parts.append((node.kind, node.text))
        i += 1

    out, before, gap = [], "", False
    for n, (kind, text) in enumerate(parts):
        if kind == "space":
            gap = True
            continue
        if before and times(before, kind, text, gap, parts[n + 1 : n + 3]):
            out.append("*")
        elif gap and before:
            out.append(" ")
        out.append(text)
        before, gap = ("closed" if kind == "group" and text[0] == "(" else kind), False
    return "".join(out) + (" " if gap else "")


def times(before: str, kind: str, text: str, gap: bool, following: list[tuple[str, str]]) -> bool:
    """Whether a product sign belongs between what ends in ``before`` and a part of a kind and a text."""
    opens, named = kind == "group" and text[0] == "(", kind == "call" or text.lower() == "pi" or (kind == "closed" and text[0].isalpha())
    if before == "closed":
        return opens or kind in ("word", "call") or named
    if before == "number":
        if opens or named:
            return True
        if kind == "word" and text == "e":
            return not (following and (following[0][0] == "number" or (following[0][1] in ("+", "-") and len(following) > 1 and following[1][0] == "number")))
        return kind == "word" and text[0] not in "eE"
    return before == "word" and gap and named


def tight(text: str) -> str:
    """Single spaces, and none around operators and commas."""
    out = []
    for piece in re.split(r"(\s+)", text):
        if piece.isspace():
            out.append(" ")
        elif piece:
            out.append(piece)
    text = "".join(out).strip()
    kept = [ch for i, ch in enumerate(text) if not (ch == " " and ((i and text[i - 1] in _TIGHT) or text[i + 1 : i + 2] in _TIGHT))]
    return "".join(kept)


def styled(answer: str, question: str) -> str:
    """The plain spelling of an answer."""
    asked = question.lower()
    nodes = plain(tree(answer.strip().replace("sqrt{(}", "sqrt(")))
    if "enter t for the variable" in asked and "theta" in asked:
        nodes = renamed(nodes)
    if "yes or no" in asked:
        items = "".join(n.flat for n in nodes).split(",")
        nodes = plain(tree(",".join(x.strip().capitalize() if x.strip().lower() in ("yes", "no") else x for x in items)))
    return tight(expanded(nodes) if reads_as_expression(nodes, question) else "".join(n.flat for n in nodes))


def cleaned(answer: str, question: str) -> str:
    """An answer without a box around it, a label before it or a full stop after it, in plain spelling."""
    text = answer.strip()
    if text.startswith("\\boxed{") and text.endswith("}"):
        text = text[len("\\boxed{") : -1].strip()
    label, mark, rest = re.split(r"([:=])", text, maxsplit=1) if re.search("[:=]", text) else (text, "", "")
    if mark and label.strip().lower() in ("answer", "ans", "final answer"):
        text = rest
    return styled(text, question).strip().strip(".")


def rooted(text: str) -> str:
    """Calls of sqrt with a closed bracket as LaTeX, at any depth."""
    open_: list[int] = []
    new: dict[int, str] = {}
    for i, ch in enumerate(text):
        if ch == "(":
            open_.append(i)
        elif ch == ")" and open_:
            start = open_.pop() - 4
            if text[max(0, start) : start + 4] == "sqrt" and not text[max(0, start - 1) : start].strip("\\").isalpha() and text[max(0, start - 1) : start] != "\\":
                new |= {start: "\\sqrt", start + 1: "", start + 2: "", start + 3: "", start + 4: "{", i: "}"}
    return "".join(new.get(i, ch) for i, ch in enumerate(text))


@F.pandas_udf(T.StringType())
def _styled(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for answer, question in parts:
        yield pd.Series([None if a is None else styled(a, q or "") for a, q in zip(answer, question, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _cleaned(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for answer, question in parts:
        yield pd.Series([None if a is None else cleaned(a, q or "") for a, q in zip(answer, question, strict=True)], dtype=object)


def answer_block(answers: Iterable[str | None], question: str) -> str:
    """A final answer block with one box around all answers, roots as LaTeX."""
    return "FINAL_ANSWERS:\n\\boxed{" + rooted(", ".join(cleaned(x or "", question) for x in answers)) + "}"


@F.pandas_udf(T.StringType())
def _response(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for answers, question in parts:
        yield pd.Series([None if a is None else answer_block(a, q or "") for a, q in zip(answers, question, strict=True)], dtype=object)


def expression_style(c: Column, question: Column) -> Column:
    """The plain spelling of an answer; null for null."""
    return _styled(c, question)


def clean_answer(c: Column, question: Column) -> Column:
    """``cleaned`` as a column; null for null."""
    return _cleaned(c, question)


def final_response(answers: Column, question: Column) -> Column:
    """A final answer block with one box around all answers (an array), roots as LaTeX."""
    return _response(answers, question)
