"""Exact equality of expressions: polynomials against their coefficients, numbers against fractions, the judge's tolerances."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.operators import expressions as E
from gradeloom.operators import judging


def test_primes_are_prime():
    for p in E.PRIMES:  # by the first 12 bases, which decide numbers of 64 bits
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
            x = pow(a, d, p)
            assert x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(s - 1))


def written(coefficients):
    return "+".join(f"({c})x^{{{i}}}" for i, c in enumerate(coefficients)) or "0"


def product(a, b):
    out = [0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


POLYNOMIAL = st.lists(st.integers(-50, 50), min_size=1, max_size=5)


@settings(max_examples=60, deadline=None)
@given(POLYNOMIAL, POLYNOMIAL, st.integers(0, 8), st.integers(-2, 2))
def test_products_equal_their_coefficients(a, b, place, by):
    c = product(a, b)
    c[place % len(c)] += by
    same = by == 0
    assert E.identical(f"({written(a)})({written(b)})", written(c)) is same
    assert E.same(f"({written(a)})({written(b)})", written(c)) is same


@settings(max_examples=60, deadline=None)
@given(st.fractions(max_denominator=99), st.fractions(max_denominator=99), st.integers(1, 12))
def test_numbers_are_fractions(a, b, digits):
    text = lambda x: f"\\frac{{{x.numerator}}}{{{x.denominator}}}"
    assert E.identical(f"{text(a)}+({text(b)})", text(a + b))
    assert E.identical(f"{text(a)}\\cdot ({text(b)})", text(a * b))
    assert E.identical(text(a), f"{text(a)}+{Fraction(1, 10**digits).numerator}/{10**digits}") is False


@pytest.mark.parametrize("a, b, word", [
    ("x", "x+0.000000001", "near"), ("x", "x+0.0000001", "different"), ("x", "x+0", "identical"), ("10^{12}x", "10^{12}x+100", "different"), ("x", "1.0000000001x", "different"),
    ("\\frac{x^2-9}{x-3}", "x+3", "identical"), ("\\frac{1}{x}+\\frac{1}{y}", "\\frac{x+y}{xy}", "identical"), ("\\frac{1}{x}+\\frac{1}{y}", "\\frac{x+y+1}{xy}", "different"),
    ("\\sin(x+y)", "\\sin(y+x)", "identical"), ("\\sin^2 x+\\cos^2 x", "1", "near"), ("\\sqrt{8}", "2\\sqrt{2}", "near"), ("\\sqrt{x+1}", "(1+x)^{1/2}", "identical"), ("e^{2x}", "\\exp(x+x)", "identical"), ("e^x", "e^{2x}", "different"),
    ("2\\pi r", "r\\pi+\\pi r", "identical"), ("x^{-2}", "\\frac1{x^2}", "identical"), ("5!", "120", "identical"), ("|-3|", "3", "identical"), ("x^{100}", "(x^{50})^2", "identical"), ("\\frac{1}{x-x}", "1", "different"), ("x+", "x", "unknown"),
    ("0.333333333", "\\frac13", "near"), ("0.33333", "\\frac13", "different"), ("(1+x)^{5000}", "(x+1)^{5000}", "identical"),
])
def test_sameness(a, b, word):
    assert judging.sameness(a, b) == word


@pytest.mark.parametrize("a, b, ok", [("y=2x+1", "4x+2=2y", True), ("y=2x+1", "-3y=-6x-3", True), ("y=2x+1", "y=2x+1.000000001", False), ("2y=3x", "3y=4.5x", False), ("2y=3x", "y=1.5x", True), ("x=x", "y=y", True), ("x^2+y^2=4", "4=y^2+x^2", True)])
def test_equations(a, b, ok):
    assert E.same_equation(a, b) is ok


def test_equal_parts_are_one_node():
    f, _ = E.parsed("(x+1)^2+(x+1)^3")
    assert f[1][1] is f[2][1]


def test_differences_end_at_the_first_point(monkeypatch):
    """Words against numbers were evaluated at all 24 points, for each option and reading."""
    met = []
    monkeypatch.setattr(E, "_value", lambda node, point, value=E._value: met.append(point) or value(node, point))
    assert not E.same("sin x + 7113", "7114")
    assert len(met) == 2


@pytest.mark.parametrize("a, b", [("sqrt(-x)", "x"), ("ln(x)", "ln(x)+i"), ("sqrt(x)^2", "x"), ("i", "e"), ("1/(x-x)", "sin x"), ("sqrt(-x)sqrt(-x)", "-x"), ("abs(x)", "x")])
def test_points_one_at_a_time_agree_with_all(a, b):
    pairs = E.together(a, b)
    assert E.agree(a, b, 1e-8) == (bool(pairs) and all(E.close(x, y) for x, y in pairs))


@pytest.mark.parametrize("a, b", [("3", "4"), ("0.000001", "0.0000014"), ("0", "0.0000001"), ("-0", "0"), ("5", "5.00000001"), ("100", "100.0002"), ("1e3", "1000")])
def test_plain_numbers_that_are_far(a, b):
    kinds = [judging.numeric, E.same]
    assert not judging.far(a, b) or not any(k(a, b) for k in kinds)
    assert judging.far("3", "4") and not judging.far("0.000001", "0.0000014")
