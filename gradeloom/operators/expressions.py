"""Equality of mathematical text (LaTeX or plain).

A text is parsed by precedence climbing into an expression graph whose equal parts are one node. Three questions are asked of two graphs, cheapest first:

* ``identical``: are they the same expression? Both are evaluated in whole numbers modulo large primes, at points that are residues. Rational functions of the
  symbols agree there at every point only if they are equal (up to a chance of about their degree over 2**61 a point, and there are three); numbers are exact fractions, so
  0.000000001 counts. What isn't rational (sines, roots, pi) is a residue of its own, named by its function and its argument's residues: equal arguments give
  equal ones, so agreement still proves equality, but a difference then proves nothing.
* Rational functions that differ: is the difference too small to matter? Numbers are compared to a relative 1e-8, functions by the size of the
  difference, 1e-8, at rational points from small to 10,000; all in exact fractions.
* Graphs with other parts: values in floating point at sample points, to a relative 1e-8, wherever both sides are defined.

Nothing is simplified symbolically; expressions with roots or functions that agree everywhere but on an interval that no sample meets would count as equal.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import random
import re
from fractions import Fraction
from functools import lru_cache

TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)|\\?(abs|arcsin|arccos|arctan|arccot|arcsec|arccsc|sinh|cosh|tanh|coth|sech|csch|sin|cos|tan|cot|sec|csc|log|ln|exp|sqrt|frac|cdot|times|div|pi|infty|left|right|alpha|beta|gamma|delta|theta|lambda|mu|sigma|phi|omega)(?![a-z])|\\([,;!: ])|(\*\*|[-+*/^(){}\[\]|_!])|([A-Za-z]))")
_UNARY = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "coth": lambda x: 1 / cmath.tanh(x), "sech": lambda x: 1 / cmath.cosh(x), "csch": lambda x: 1 / cmath.sinh(x),
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "arccot": lambda x: cmath.atan(1 / x), "arcsec": lambda x: cmath.acos(1 / x), "arccsc": lambda x: cmath.asin(1 / x),
    "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "abs": lambda x: complex(abs(x)), "sqrt": cmath.sqrt,
    "factorial": lambda x: complex(math.factorial(round(x.real))) if x.imag == 0 and x.real == round(x.real) and 0 <= x.real < 171 else cmath.exp(math.lgamma(x.real + 1)),
}
_CONSTANTS = {"pi": complex(math.pi), "e": complex(math.e), "i": 1j}
#: An exact number is given up when its numerator or denominator is longer than so many bits; a power when its exponent is larger than so much.
MOST_BITS, MOST_POWER = 4_096, 4_096


class NotMath(ValueError):
    """The text isn't an expression that is understood here."""


#: ("number", Fraction), ("symbol", name), ("constant", name), ("+" | "*" | "/" | "^", a, b), ("call", name, a).
Node = tuple


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        self.symbols: set[str] = set()
        self.nodes: dict[Node, Node] = {}
        at = 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise NotMath(text)
            at = m.end()
            token = next((g for i, g in enumerate(m.groups()) if g and i != 2), None)
            if token and token not in ("left", "right"):
                self.tokens.append("^" if token == "**" else token)
        self.at = 0

    def node(self, *parts) -> Node:
        """The one node of these parts."""
        return self.nodes.setdefault(parts, parts)

    def negative(self, a: Node) -> Node:
        return self.node("*", self.node("number", Fraction(-1)), a)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if not token or (want and token != want):
            raise NotMath(f"{want or 'more'} wanted")
        self.at += 1
        return token

    def whole(self) -> Node:
        f = self.sum()
        if self.peek():
            raise NotMath(self.peek())
        return f

    def sum(self) -> Node:
        f = self.product()
        while self.peek() in ("+", "-"):
            minus = self.take() == "-"
            g = self.product()
            f = self.node("+", f, self.negative(g) if minus else g)
        return f

    def product(self) -> Node:
        f = self.signed()
        while True:
            token = self.peek()
            if token in ("*", "cdot", "times"):
                self.take()
                f = self.node("*", f, self.signed())
            elif token in ("/", "div"):
                self.take()
                f = self.node("/", f, self.signed())
            elif token and token not in ("+", "-", ")", "}", "]", "|", "^", "!", "_"):
                f = self.node("*", f, self.power())
            else:
                return f

    def signed(self) -> Node:
        if self.peek() in ("+", "-"):
            minus = self.take() == "-"
            f = self.signed()
            return self.negative(f) if minus else f
        return self.power()

    def power(self) -> Node:
        f = self.atom()
        while self.peek() == "!":
            self.take()
            f = self.node("call", "factorial", f)
        if self.peek() == "^":
            self.take()
            return self.node("^", f, self.group() if self.peek() in ("{", "(", "[") else self.signed_atom())
        return f

    def signed_atom(self) -> Node:
        if self.peek() in ("+", "-"):
            minus = self.take() == "-"
            f = self.signed_atom()
            return self.negative(f) if minus else f
        return self.power()

    def group(self) -> Node:
        close = {"(": ")", "{": "}", "[": "]", "|": "|"}[self.take()]
        f = self.sum()
        self.take(close)
        return self.node("call", "abs", f) if close == "|" else f

    def argument(self) -> Node:
        """A group, or one digit or symbol, as in \\frac12."""
        if self.peek() in ("{", "(", "["):
            return self.group()
        token = self.peek()
        if re.fullmatch(r"\d{2,}", token):
            self.tokens[self.at : self.at + 1] = [token[0], token[1:]]
        return self.atom()

    def atom(self) -> Node:
        token = self.peek()
        if token in ("(", "{", "[", "|"):
            return self.group()
        self.take()
        if re.fullmatch(r"[\d.]+", token):
            return self.node("number", Fraction(token.rstrip(".") if token[-1:] == "." else token))
        if token in _CONSTANTS:
            return self.node("constant", token)
        if token == "frac":
            a = self.argument()
            return self.node("/", a, self.argument())
        if token == "sqrt":
            degree = self.group() if self.peek() == "[" else None
            a = self.argument()
            return self.node("^", a, self.node("/", self.node("number", Fraction(1)), degree)) if degree else self.node("call", "sqrt", a)
        if token in _UNARY:
            base = power = None
            if token == "log" and self.peek() == "_":
                self.take()
                base = self.argument()
            if self.peek() == "^":
                self.take()
                power = self.group() if self.peek() in ("{", "(", "[") else self.atom()
            a = self.group() if self.peek() in ("(", "{", "[") else self.product_of_atoms()
            value = self.node("/", self.node("call", token, a), self.node("call", "ln", base)) if base else self.node("call", token, a)
            return self.node("^", value, power) if power else value
        if token in ("infty", "left", "right") or not token.isalpha():
            raise NotMath(token)
        if self.peek() == "_":
            self.take()
            token += "_" + (self.take() if self.peek() not in ("{",) else (self.take("{"), self.take(), self.take("}"))[1])
        self.symbols.add(token)
        return self.node("symbol", token)

    def product_of_atoms(self) -> Node:
        """What a function without brackets takes: 2x in sin 2x."""
        f = self.power()
        while re.fullmatch(r"[A-Za-z]|pi|[\d.]+", self.peek() or "-") and self.peek() not in _UNARY:
            f = self.node("*", f, self.power())
        return f


@lru_cache(maxsize=4_096)
def parsed(text: str) -> tuple[Node, frozenset[str]]:
    """A text's expression graph and its symbols; the last few thousand are remembered."""
    p = Parser(text)
    return p.whole(), frozenset(p.symbols)


# Exact arithmetic


class NotRational(ArithmeticError):
    """A part isn't a rational function, or its numbers are too long."""


def exact(node: Node, point: dict[str, Fraction], seen: dict[int, Fraction] | None = None) -> Fraction:
    """The exact value of a rational function at a rational point."""
    seen = {} if seen is None else seen
    if id(node) in seen:
        return seen[id(node)]
    kind, *parts = node
    if kind == "number":
        value = parts[0]
    elif kind == "symbol":
        value = point[parts[0]]
    elif kind in ("constant", "call"):
        if kind == "constant" or parts[0] not in ("abs", "factorial"):
            raise NotRational(parts[0])
        a = exact(parts[1], point, seen)
        if parts[0] == "factorial" and not (a.denominator == 1 and 0 <= a < 500):
            raise NotRational("factorial")
        value = abs(a) if parts[0] == "abs" else Fraction(math.factorial(a.numerator))
    else:
        a, b = exact(parts[0], point, seen), exact(parts[1], point, seen)
        if kind == "^":
            if b.denominator != 1 or abs(b) > MOST_POWER or max(a.numerator.bit_length(), a.denominator.bit_length()) * abs(b) > MOST_BITS:
                raise NotRational("power")
            value = a ** int(b)
        else:
            value = a + b if kind == "+" else a * b if kind == "*" else a / b
    if max(value.numerator.bit_length(), value.denominator.bit_length()) > MOST_BITS:
        raise NotRational("long")
    seen[id(node)] = value
    return value


def rational(node: Node) -> bool:
    """Whether a graph is a rational function of its symbols: whole powers, no functions, no other constants."""
    kind, *parts = node
    if kind in ("number", "symbol"):
        return True
    if kind == "call":
        return parts[0] == "factorial" and constant(parts[1]) is not None
    if kind == "constant":
        return False
    if kind == "^":
        power = constant(parts[1])
        return power is not None and power.denominator == 1 and abs(power) <= MOST_POWER and rational(parts[0])
    return rational(parts[0]) and rational(parts[1])


def constant(node: Node) -> Fraction | None:
    """The exact value of a graph without symbols; None if it has any, isn't rational or isn't defined."""
    try:
        return exact(node, {})
    except (KeyError, ArithmeticError):
        return None


#: Primes, of which the first is 2**61 - 1.
PRIMES = ((1 << 61) - 1, (1 << 61) - 31, (1 << 61) - 45)


@lru_cache(maxsize=4_096)
def residue(name: str, prime: int) -> int:
    """A fixed residue for a name, anything but 0."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "little") % (prime - 1) + 1


def fingerprint(node: Node, seen: dict[int, tuple[int, ...]] | None = None) -> tuple[int, ...]:
    """Residues of a graph, one a prime, each at a point of its own."""
    seen = {} if seen is None else seen
    if id(node) in seen:
        return seen[id(node)]
    kind, *parts = node
    if kind == "number":
        out = tuple(parts[0].numerator % p * pow(parts[0].denominator, -1, p) % p for p in PRIMES)
    elif kind in ("symbol", "constant"):
        out = tuple(residue(f"{kind} {parts[0]} {i}", p) for i, p in enumerate(PRIMES))
    elif kind == "call":
        value = constant(node)
        if value is not None:
            out = fingerprint(("number", value))
        else:
            inner = fingerprint(parts[1], seen)
            name = "ln" if parts[0] == "log" else parts[0]
            if name == "exp":
                return fingerprint(("^", ("constant", "e"), parts[1]))
            if name == "sqrt":
                return fingerprint(("^", parts[1], ("number", Fraction(1, 2))))
            out = tuple(residue(f"{name} {inner} {i}", p) for i, p in enumerate(PRIMES))
    elif kind == "^":
        power = constant(parts[1])
        base = fingerprint(parts[0], seen)
        if power is None:
            raised = fingerprint(parts[1], seen)
            out = tuple(residue(f"power {base} {raised} {i}", p) for i, p in enumerate(PRIMES))
        else:
            if power.denominator != 1:  # a whole power of a root that is known by its base
                base = tuple(residue(f"root {base} {power.denominator} {i}", p) for i, p in enumerate(PRIMES))
            out = tuple(pow(b, power.numerator, p) for b, p in zip(base, PRIMES))
    else:
        a, b = fingerprint(parts[0], seen), fingerprint(parts[1], seen)
        if kind == "+":
            out = tuple((x + y) % p for x, y, p in zip(a, b, PRIMES))
        elif kind == "*":
            out = tuple(x * y % p for x, y, p in zip(a, b, PRIMES))
        else:
            out = tuple(x * pow(y, -1, p) % p for x, y, p in zip(a, b, PRIMES))
    seen[id(node)] = out
    return out


@lru_cache(maxsize=4_096)
def residues(text: str) -> tuple[int, ...]:
    """The ``fingerprint`` of a text's graph."""
    return fingerprint(parsed(text)[0])


def identical(a: str, b: str) -> bool | None:
    """Whether two texts are the same expression, however close others are; None if that isn't decided, as parts aren't rational, or a side divides by nothing."""
    (f, _), (g, _) = parsed(a), parsed(b)
    try:
        if residues(a) == residues(b):
            return True
    except ValueError:
        return None  # no inverse: a division by what is 0 everywhere
    return False if rational(f) and rational(g) else None


#: Where differences of rational functions are measured.
RANGE = (Fraction(1, 3), Fraction(-7, 5), Fraction(29, 11), Fraction(-1_013, 17), Fraction(4_999, 7), Fraction(-9_973), Fraction(10_000))


def near(f: Node, g: Node, symbols: frozenset[str], relative: float = 1e-8) -> bool:
    """Whether two rational functions that differ do so by less than matters; numbers by a relative ``relative``, others by as much in size at each point."""
    limit = Fraction(relative) * Fraction(101, 100)
    if not symbols:
        a, b = exact(f, {}), exact(g, {})
        return abs(a - b) <= limit * max(abs(b), Fraction(1, 10**12))
    rng = random.Random(20_240_601)
    measured = 0
    for x in RANGE if len(symbols) < 2 else RANGE * 2:
        point = {s: x if i == 0 else x * Fraction(rng.randint(-99, 99) or 1, 100) for i, s in enumerate(sorted(symbols))}
        try:
            if abs(exact(f, point) - exact(g, point)) > limit:
                return False
            measured += 1
        except ZeroDivisionError:
            continue
    return measured > 0


# Floating point


def value_of(node: Node, point: dict[str, complex], seen: dict[int, complex] | None = None) -> complex:
    seen = {} if seen is None else seen
    if id(node) not in seen:
        kind, *parts = node
        if kind == "number":
            out = complex(float(parts[0]))
        elif kind == "symbol":
            out = point[parts[0]]
        elif kind == "constant":
            out = _CONSTANTS[parts[0]]
        elif kind == "call":
            out = _UNARY[parts[0]](value_of(parts[1], point, seen))
        else:
            a, b = value_of(parts[0], point, seen), value_of(parts[1], point, seen)
            out = a + b if kind == "+" else a * b if kind == "*" else a / b if kind == "/" else complex(a) ** b
        seen[id(node)] = out
    return seen[id(node)]


def _value(node: Node, point: dict[str, complex]) -> complex | None:
    """A graph's value at a point; None where it isn't defined."""
    try:
        return complex(value_of(node, point))
    except (ZeroDivisionError, OverflowError, ValueError):
        return None


def values(text: str, points: list[dict[str, complex]]) -> list[complex | None]:
    f, _ = parsed(text)
    return [_value(f, v) for v in points]


@lru_cache(maxsize=4_096)
def number(text: str) -> complex | None:
    """The value of an expression without symbols; None if it has any or isn't one."""
    try:
        f, symbols = parsed(text)
        return None if symbols else complex(value_of(f, {}))
    except (NotMath, ZeroDivisionError, OverflowError, ValueError, RecursionError):
        return None


@lru_cache(maxsize=1_024)
def _points(symbols: tuple[str, ...], count: int) -> list[dict[str, complex]]:
    rng = random.Random(20_240_601)
    return [{s: complex(rng.uniform(0.3, 2.7) * (1 if k % 3 else -1)) for s in symbols} for k in range(count if symbols else 1)]


def points_for(*texts: str, count: int = 12) -> list[dict[str, complex]]:
    """Sample points for the symbols of all texts, the same for the same texts: mixed signs and sizes."""
    return _points(tuple(sorted(set().union(*(parsed(t)[1] for t in texts)))), count)


def close(a: complex, b: complex, relative: float = 1e-8) -> bool:
    return abs(a - b) <= relative * 1.01 * max(abs(b), 1e-12) or (abs(b) < 1e-12 and abs(a) < 1e-9)


def _real(x: complex, y: complex) -> bool:
    return abs(x.imag) <= 1e-12 * max(1.0, abs(x)) and abs(y.imag) <= 1e-12 * max(1.0, abs(y))


def together(a: str, b: str) -> list[tuple[complex, complex]]:
    """Values of two expressions at sample points where both are defined; if both are real at some, those points alone, which are in both domains."""
    points = points_for(a, b, count=24)
    pairs = [(x, y) for x, y in zip(values(a, points), values(b, points), strict=True) if x is not None and y is not None]
    return [p for p in pairs if _real(*p)] or pairs


def agree(a: str, b: str, relative: float) -> bool:
    """Whether the pairs of ``together`` are all close, and there are any; points are taken one at a time, up to the first real pair that isn't close."""
    f, g = parsed(a)[0], parsed(b)[0]
    real = met = far = False
    for point in points_for(a, b, count=24):
        if (x := _value(f, point)) is None or (y := _value(g, point)) is None:
            continue
        met, like = True, close(x, y, relative)
        if _real(x, y):
            if not like:
                return False
            real = True
        far = far or not like
    return real or met and not far


@lru_cache(maxsize=4_096)
def same(a: str, b: str, relative: float = 1e-8) -> bool:
    """Whether two expressions are identical, or differ by less than matters, or, with parts that aren't rational, agree wherever both are defined."""
    known = identical(a, b)
    if known:
        return True
    if known is False:
        (f, left), (g, right) = parsed(a), parsed(b)
        try:
            return near(f, g, left | right, relative)
        except NotRational:
            pass  # numbers too long for fractions
    return agree(a, b, relative)


def same_equation(a: str, b: str) -> bool:
    """Whether two equations are the same up to a whole factor."""
    (la, ra), (lb, rb) = a.split("="), b.split("=")
    one, two = f"({la})-({ra})", f"({lb})-({rb})"
    f, g = parsed(one)[0], parsed(two)[0]
    if rational(f) and rational(g):
        return whole_multiple(f, g, parsed(one)[1] | parsed(two)[1])
    pairs = together(one, two)
    if not pairs:
        return False
    if all(close(x, y) for x, y in pairs):
        return True
    for some in (pairs, [(y, x) for x, y in pairs]):
        if all(abs(y) > 1e-12 for _, y in some):
            ratios = [x / y for x, y in some]
            whole = round(ratios[0].real)
            if whole and all(abs(r - whole) < 1e-6 for r in ratios):
                return True
    return False


def whole_multiple(f: Node, g: Node, symbols: frozenset[str]) -> bool:
    """Whether one rational function is the other, or a whole number times it other than 0: the ratio is measured exactly at one point and proved by residues."""
    try:
        left, right = fingerprint(f), fingerprint(g)
    except ValueError:
        return False
    if left == right:
        return True
    for x in RANGE:
        point = {s: x + i for i, s in enumerate(sorted(symbols))}
        try:
            a, b = exact(f, point), exact(g, point)
        except ArithmeticError:
            continue
        if not a or not b:
            continue
        for ratio, top, bottom in ((a / b, left, right), (b / a, right, left)):
            if ratio.denominator == 1 and all(t == ratio.numerator * u % p for t, u, p in zip(top, bottom, PRIMES)):
                return True
        return False
    return False
