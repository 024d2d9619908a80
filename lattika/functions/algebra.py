"""Equality of mathematical answers: two normal forms of texts, then the values of expressions.

Expressions are compared at some fixed points instead of by a computer-algebra
package: rational functions that agree there agree everywhere but for chance.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

#: What the first form drops or rewrites, in order (fixed values).
REWRITES = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
#: Units that the second form drops, with their plurals and powers (fixed values).
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]
#: Words for numbers and joints between items (fixed values).
WORDS = [(" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
#: Signs and commands with their plain names (fixed values).
NAMES = [("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*"), ("√", "sqrt"), ("π", "pi"), ("∞", "inf"), ("∪", "U"), ("·", "*"), ("×", "*")]
#: Where expressions with letters are compared.
POINTS = [Fraction(3, 7), Fraction(-11, 5), Fraction(17, 13), Fraction(29, 3)]


def _braced(text: str, command: str) -> str:
    """A command whose argument is a single sign gets braces around it."""
    return re.sub(re.escape(command) + r"(?=[^{])(.)", lambda m: command + "{" + m[1] + "}", text)


def _fractions(text: str) -> str:
    """Both arguments of \\frac in braces, where the first is a sign or in braces and the second is a sign."""
    out = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", text)
    out = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", out)
    return re.sub(r"\\frac\{([^{}]*)\}([^{])", r"\\frac{\1}{\2}", out)


def text_form(text: str) -> str:
    """The first form: layout, degrees, currency, a unit at the right end, percent signs and a short left side go; fractions and roots get braces."""
    out = re.sub(r"^\\text\{(.+?)\}$", r"\1", text.strip())
    for old, new in REWRITES:
        out = out.replace(old, new)
    if out.count("\\text{ ") == 1:
        out = out[: out.index("\\text{ ")]
    out = out.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    out = "0" + out if out.startswith(".") else out
    sides = out.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        out = sides[1]
    out = _fractions(_braced(out, "\\sqrt").replace(" ", ""))
    if out == "0.5":
        return "\\frac{1}{2}"
    whole = re.fullmatch(r"(-?\d+)/(-?\d+)", out)
    return "\\frac{%d}{%d}" % (int(whole[1]), int(whole[2])) if whole and out == f"{int(whole[1])}/{int(whole[2])}" else out


def _plain_numbers(text: str) -> str:
    """Without the commas of thousands."""
    while (out := re.sub(r"(\d),(\d\d\d)(?=$|\D)", r"\1\2", text)) != text:
        text = out
    return out


def _integer(text: str) -> int | None:
    try:
        value = float(_plain_numbers(text))
    except ValueError:
        return None
    return round(value) if math.isfinite(value) and abs(value - round(value)) <= 1e-7 else None


def value_form(text: str) -> str:
    """The second form: no signs of money and percent, no units, number words as powers, commands by their plain names, lower case."""
    out = re.sub(r"^\\text\{(.+?)\}$", r"\1", text).replace("\\%", "%").replace("\\$", "$").replace("$", "").replace("%", "")
    for old, new in WORDS:
        out = out.replace(old, new)
    for unit in UNITS:
        out = re.sub(unit + r"(es)?(s)? *(\^[0-9]+)?", "", out)
    out = re.sub(r"\^ *\\circ", "", out)
    if out[:1] == "{" and out[-1:] == "}":
        out = out[1:-1]
    out = re.sub(r",\\! *", "", out)
    if re.fullmatch(r"\s*[-+]?[\d.]+(e[-+]?\d+)?\s*", out) and (n := _integer(out)) is not None:
        out = str(n)
    if "\\" in out:
        out = _fractions(re.sub(r"\\[td]frac", r"\\frac", out))
        while (step := re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", lambda m: " " + "/".join(x if re.fullmatch(r"\w+", x) else f"({x})" for x in m.groups()), out)) != out:
            out = step
        out = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", out)
        for old, new in NAMES:
            out = out.replace(old, new)
        out = out.strip()
    out = re.sub(r"- *", "-", out)
    out = re.sub(r"([0-9]) +([0-9])", r"\1+\2", out).replace(" ", "").replace("{", "").replace("}", "").lower()
    n = _integer(out)
    return str(n) if n is not None else out


class _Parser:
    """Values of expressions with + - * / ^, roots, brackets and letters; products may go unwritten."""

    def __init__(self, text: str, letters: dict[str, Fraction]):
        self.parts = re.findall(r"\d+\.?\d*|\.\d+|sqrt|pi|[a-z]|\*\*|[-+*/^()]", text)
        if "".join(self.parts) != text:
            raise ValueError("no expression")
        self.at, self.letters = 0, letters

    def _next(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def _take(self) -> str:
        self.at += 1
        return self.parts[self.at - 1]

    def whole(self):
        out = self.total()
        if self._next():
            raise ValueError("no expression")
        return out

    def total(self):
        out = self.product()
        while self._next() in ("+", "-"):
            out = out + self.product() if self._take() == "+" else out - self.product()
        return out

    def product(self):
        out = self.signed()
        while (sign := self._next()) and sign not in "+-)":
            if sign in ("*", "/"):
                self.at += 1
            right = self.signed() if sign in ("*", "/") else self.power()
            out = out / right if sign == "/" else out * right
        return out

    def signed(self):
        if self._next() in ("-", "+"):
            return -self.signed() if self._take() == "-" else self.signed()
        return self.power()

    def power(self):
        base = self.atom()
        if self._next() in ("^", "**"):
            self.at += 1
            exponent = self.signed()
            if abs(exponent) > 64:
                raise ValueError("too large")
            return base**exponent if isinstance(exponent, Fraction) and exponent.denominator == 1 else float(base) ** float(exponent)
        return base

    def atom(self):
        if not self._next():
            raise ValueError("no expression")
        part = self._take()
        if part == "(":
            out = self.total()
            if not self._next() or self._take() != ")":
                raise ValueError("no expression")
            return out
        if part == "sqrt":
            value = self.atom()
            root = Fraction(math.isqrt(value.numerator), math.isqrt(value.denominator)) if isinstance(value, Fraction) and value >= 0 else None
            return root if root is not None and root**2 == value else math.sqrt(value)
        if part == "pi":
            return math.pi
        if part in self.letters:
            return self.letters[part]
        if not part[0].isdigit() and part[0] != ".":
            raise ValueError("no expression")
        return Fraction(part)


def same_value(a: str, b: str) -> bool:
    """Whether two expressions in at most two letters have equal values; false where either is none, or has powers of powers or large ones."""
    letters = sorted({c for x in (a, b) for c in re.sub("sqrt|pi|frac", "", x) if c.isalpha()})
    if len(letters) > 2 or any("^{" in x or "^(" in x or re.search(r"\^[0-9]+\^|\^[0-9][0-9]+", x) for x in (a, b)):
        return False
    try:
        for k in range(len(POINTS) if letters else 1):
            place = {c: POINTS[(k + j) % len(POINTS)] * (j + 1) for j, c in enumerate(letters)}
            x, y = _Parser(a, place).whole(), _Parser(b, place).whole()
            if isinstance(x, Fraction) and isinstance(y, Fraction):
                if x != y:
                    return False
            elif isinstance(x, complex) or isinstance(y, complex) or not math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12):
                return False
    except (ValueError, ArithmeticError, IndexError, TypeError):
        return False
    return True


def items(text: str) -> list[str]:
    """The items of a tuple or interval; anything else is one item."""
    text = _plain_numbers(text)
    if len(text) > 2 and text[0] in "([" and text[-1] in ")]" and not re.search(r"[()\[\]]", text[1:-1]):
        return [x.strip() for x in text[1:-1].split(",")]
    return [text] if text else []


def _same_item(said: str, gold: str) -> bool:
    fraction = r"-?[0-9]+.?/0*[1-9][0-9]*.?"
    if re.fullmatch(fraction, said) and re.fullmatch(fraction, gold):
        return said == gold
    if (_integer(said) is None) != (_integer(gold) is None):
        return False
    return said == gold or same_value(said, gold)


def same_answer(said: str, gold: str) -> bool:
    """Whether two answers are equal in the first form, or item by item in the second. Fractions have to be reduced alike, integers written as such."""
    if text_form(said) == text_form(gold):
        return True
    a, b = value_form(said), value_form(gold)
    if a == b:
        return True
    left, right = items(a), items(b)
    if not a or len(left) != len(right) or (len(right) > 1 and (a[0], a[-1]) != (b[0], b[-1])):
        return False
    return all(_same_item(x, y) for x, y in zip(left, right, strict=True))
