"""Content streams read token by token: what the fast reader in ``sources.content`` must give."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from palimpsest.sources.pdf import WHITE, hexadecimal, literal

TOKENS = 300_000

LEXEME = re.compile(r"%[^\r\n]*|[\0\t\n\f\r ]+|\(|<<|>>|<|\[|/[^\t\n\x0b\f\r \xa0()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/]+|.", re.S)
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+", re.ASCII)


def number(raw: str) -> float | str:
    clean = raw.strip("\t\n\x0b\f\r \xa0")
    if not clean:
        return 0.0
    if not NUMBER.fullmatch(clean):
        return raw
    try:
        value = float(int(clean, 0)) if clean[1:2].lower() in ("x", "b", "o") else float(clean)
    except OverflowError:
        return raw
    return value if abs(value) < float("inf") else raw


def array(source: str, at: int) -> tuple[list, int]:
    """Strings and numbers of an array; what is glued to a number is lost with it."""
    out: list = []
    inner = re.compile(r"[\0\t\n\f\r ]*(\]|\(|<(?!<)|[^\0\t\n\f\r \]]+|\Z)")
    while True:
        m = inner.match(source, at)
        if m is None or m[1] in ("]", ""):
            return out, m.end() if m else len(source)
        if m[1] == "(":
            value, at = literal(source, m.start(1))
            out.append(("string", value))
        elif m[1] == "<":
            value, at = hexadecimal(source, m.start(1))
            out.append(("string", value))
        else:
            out.append(("other", m[1]))
            at = m.end()


def tokens(source: str) -> Iterator[tuple[str, object]]:
    at = n = 0
    while at < len(source) and n < TOKENS:
        m = LEXEME.match(source, at)
        lexeme, at = m[0], m.end()
        if lexeme[0] in "%\0\t\n\f\r ":
            continue
        if lexeme == "(":
            value, at = literal(source, m.start())
            yield "string", value
        elif lexeme == "<":
            value, at = hexadecimal(source, m.start())
            yield "string", value
        elif lexeme == "[":
            value, at = array(source, at)
            yield "array", value
        elif lexeme[0] == "/" or lexeme in ("<<", ">>"):
            yield "name", lexeme
        elif lexeme in ("]", ")", ">", "{", "}"):
            continue
        else:
            value = number(lexeme)
            yield ("word" if isinstance(value, str) else "number"), value
        n += 1


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3],
            m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def box(m: Matrix, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    """left, right, bottom, top of the transformed rectangle."""
    corners = [(m[0] * a + m[2] * b + m[4], m[1] * a + m[3] * b + m[5]) for a in (x, x + w) for b in (y, y + h)]
    xs, ys = zip(*corners)
    return min(xs), max(xs), min(ys), max(ys)


def squeeze(value: str, most: int) -> str:
    value = WHITE.sub(" ", value).strip(" ")
    return value if len(value) <= most else value[: most - 1].rstrip(" ") + "…"


@dataclass
class Page:
    """Graphics and text state; q and Q keep the matrix and the fill only, text settings outlive them."""

    ctm: Matrix = UNIT
    fill: tuple[float, float, float] = (0.0, 0.0, 0.0)
    saved: list = field(default_factory=list)
    text: Matrix = UNIT
    line: Matrix = UNIT
    size: float = 12.0
    mode: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    path: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    rects: list = field(default_factory=list)

    def show(self, value: str) -> None:
        clean = squeeze(value, 300)
        if not clean:
            return
        width = max(self.size * 0.35, len(clean) * abs(self.size) * 0.5 * abs(self.scale / 100))
        height = max(1.0, abs(self.size))
        self.texts.append((clean, *box(times(self.ctm, self.text), 0, -0.2 * height, width, height), self.mode, *self.fill))
        self.text = times(self.text, (1, 0, 0, 1, width / max(0.01, abs(self.ctm[0] or 1)), 0))

    def move(self, x: float, y: float) -> None:
        self.line = self.text = times(self.line, (1, 0, 0, 1, x, y))

    def step(self, operator: str, operands: list) -> None:
        def last(n: int) -> list[float] | None:
            got = operands[-n:]
            return [v for _, v in got] if len(got) == n and all(k == "number" for k, _ in got) else None

        kind, value = operands[-1] if operands else ("", None)
        match operator:
            case "q":
                self.saved.append((self.ctm, self.fill))
            case "Q" if self.saved:
                self.ctm, self.fill = self.saved.pop()
            case "cm" if v := last(6):
                self.ctm = times(self.ctm, tuple(v))
            case "g" if v := last(1):
                self.fill = (v[0],) * 3
            case "rg" if v := last(3):
                self.fill = tuple(v)
            case "k" if v := last(4):
                self.fill = tuple(1 - min(1.0, c + v[3]) for c in v[:3])
            case "re" if v := last(4):
                self.path.append(box(self.ctm, *v))
            case "f" | "F" | "f*" | "B" | "B*" | "b" | "b*":
                self.rects += [(*b, *self.fill) for b in self.path]
                self.path = []
            case "n" | "S" | "s":
                self.path = []
            case "BT":
                self.text = self.line = UNIT
            case "Tf" if v := last(1):
                self.size = v[0]
            case "Tr" if v := last(1):
                self.mode = v[0]
            case "Tz" if v := last(1):
                self.scale = v[0]
            case "TL" if v := last(1):
                self.leading = v[0]
            case "Tm" if v := last(6):
                self.text = self.line = tuple(v)
            case "Td" | "TD" if v := last(2):
                if operator == "TD":
                    self.leading = -v[1]
                self.move(*v)
            case "T*":
                self.move(0, -self.leading)
            case "'" | "Tj" | '"':
                if operator == "'":
                    self.move(0, -self.leading)
                if kind == "string":
                    self.show(value)
            case "TJ" if kind == "array":
                for k, v in value:
                    if k == "string":
                        self.show(v)


def interpret(source: str) -> Page:
    page, operands = Page(), []
    for kind, value in tokens(source):
        if kind == "word":
            page.step(value, operands)
            operands = []
        else:
            operands.append((kind, value))
    return page
