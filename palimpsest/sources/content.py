"""Content streams of PDF files: what is shown and filled where.

One pattern finds a whole token at a time, plain strings and arrays included; only nested or escaped ones are walked. The
graphics state is followed operator by operator, but boxes are not worked out there: the state at each shown text and path is
noted, and ``boxes`` transforms all of them, of many streams, at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

from ..functions.text import SPACE
from .pdf import WHITE, hexadecimal, literal, text_of

#: Fixed value: tokens of a stream that are read.
TOKENS = 300_000
#: Matches between two looks at how many operands have piled up.
STEP = 1 << 16
GAP, BORDER = r"\0\t\n\f\r ", r"\0\t\n\f\r ()<>\[\]{}/"
DIGITS = r"[+-]?(?:\d++\.?\d*+|\.\d++)"
#: Fixed value: what a name is made of; then what it is not: bytes of white space and delimiters.
NAME = rf"/[^{SPACE}()<>\[\]{{}}/%]*+"
TOKEN = re.compile("|".join((
    rf"[{GAP}]*+(?:((?:{DIGITS}[{GAP}]++){{0,6}}+)([A-Za-z'\"*][^{BORDER}]*+)",  # 1, 2: numbers and the operator after them
    rf"\(([^()\\]*+)\)(?:[{GAP}]*+(Tj)(?=[{BORDER}]|\Z))?",                    # 3, 4: a plain string, perhaps shown at once
    rf"({DIGITS})(?=[{BORDER}]|\Z)",                                            # 5: a number
    rf"([^{BORDER}%][^{BORDER}]*+)",                                             # 6: another word
    rf"({NAME}|<<|>>)",                                                         # 7
    rf"\[((?:[{GAP}]++|\([^()\\]*+\)|[^{GAP}()<>\[\]]++(?=[{GAP}\]]))*+)\]",    # 8: a plain array
    r"(\()|(\[)|(<)",                                                           # 9, 10, 11: to be walked
    r"%[^\r\n]*+|[\])>{}])")), re.ASCII)
ITEM = re.compile(rf"\(([^()\\]*+)\)|[^{GAP}]+")
INNER = re.compile(rf"[{GAP}]*(\]|\(|<(?!<)|[^{GAP}\]]+|\Z)")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+", re.ASCII)
BLANKS = "\t\n\x0b\f\r \xa0"
#: What squeezing would change, within a string and at its ends.
UNEVEN = re.compile(rf"[{SPACE.replace(' ', '')}]|  |^ | $")
FILLS, ENDS = {"f", "F", "f*", "B", "B*", "b", "b*"}, {"n", "S", "s"}
#: Stands for an operand that no operator reads.
NONE = object()

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def number(raw: str) -> float | None:
    """A word as a finite number, if it is one."""
    clean = raw.strip(BLANKS)
    if not clean:
        return 0.0
    if not NUMBER.fullmatch(clean):
        return None
    try:
        value = float(int(clean, 0)) if clean[1:2].lower() in ("x", "b", "o") else float(clean)
    except OverflowError:
        return None
    return value if abs(value) < float("inf") else None


def strings_of(source: str, at: int) -> tuple[list[str], int]:
    """The strings of an array whose inside begins at ``at``, and where it ends; what is glued to a number is lost with it."""
    out: list[str] = []
    while True:
        m = INNER.match(source, at)
        if m is None or m[1] in ("]", ""):
            return out, m.end() if m else len(source)
        if m[1] == "(":
            value, at = literal(source, m.start(1))
            out.append(value)
        elif m[1] == "<":
            value, at = hexadecimal(source, m.start(1))
            out.append(value)
        else:
            at = m.end()


def squeeze(value: str, most: int) -> str:
    if UNEVEN.search(value):
        value = WHITE.sub(" ", value).strip(" ")
    return value if len(value) <= most else value[: most - 1].rstrip(" ") + "…"


def times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3],
            m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


@dataclass
class Page:
    """The texts shown, and for each (matrix, width, height, render mode, fill); for each filled path (matrix, x, y, w, h, fill)."""

    texts: list[str] = field(default_factory=list)
    shown: list[tuple[float, ...]] = field(default_factory=list)
    filled: list[tuple[float, ...]] = field(default_factory=list)


def boxes(matrix: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """left, right, bottom, top of transformed rectangles, one a row."""
    with np.errstate(all="ignore"):
        a, b, c, d, e, f = matrix.T
        corners = [(a * u + c * v + e, b * u + d * v + f) for u in (x, x + w) for v in (y, y + h)]
        xs, ys = (np.stack(side) for side in zip(*corners))
        return np.stack([xs.min(0), xs.max(0), ys.min(0), ys.max(0)], 1)


def text_boxes(shown: np.ndarray) -> np.ndarray:
    return boxes(shown[:, :6], np.zeros(len(shown)), -0.2 * shown[:, 7], shown[:, 6], shown[:, 7])


def path_boxes(filled: np.ndarray) -> np.ndarray:
    return boxes(filled[:, :6], *filled[:, 6:10].T)


def interpret(source: str) -> Page:
    """Follows the graphics and text state; q and Q keep the matrix and the fill only, text settings outlive them."""
    page = Page()
    texts, shown, filled = page.texts, page.shown, page.filled
    ctm = text = line = UNIT
    fill = (0.0, 0.0, 0.0)
    saved: list = []
    path: list = []
    size, mode, scale, leading = 12.0, 0.0, 100.0, 0.0
    operands: list = []
    numbers: list | tuple = ()
    put = operands.append
    seen = at = 0

    def show(value: str, text: Matrix) -> Matrix:
        clean = squeeze(value, 300)
        if not clean:
            return text
        wide = abs(size)
        width = max(size * 0.35, len(clean) * wide * 0.5 * abs(scale / 100))
        texts.append(clean)
        shown.append((*times(ctm, text), width, max(1.0, wide), mode, *fill))
        return times(text, (1, 0, 0, 1, width / max(0.01, abs(ctm[0] or 1)), 0))

    def last(n: int) -> list[float] | None:
        got = numbers[-n:] if len(numbers) >= n else [*operands, *numbers][-n:]
        return got if len(got) == n and (len(numbers) >= n or all(type(v) is float for v in got)) else None

    while at < len(source):
        tokens = TOKEN.finditer(source, at)
        at = len(source)
        while True:
            m = None
            for m in islice(tokens, STEP):
                kind = m.lastindex
                if kind == 3:
                    value = m[3]
                    put(value if value[:1] < "\xfe" else text_of(value.encode("latin-1")))
                    continue
                if kind == 5:
                    put(float(m[5]))
                    continue
                if kind == 7:
                    put(NONE)
                    continue
                if kind == 2:
                    run, word = m[1], m[2]
                    numbers = list(map(float, (run if "\0" not in run else run.replace("\0", " ")).split())) if run else ()
                elif kind == 4:
                    value, word, numbers = m[3], "Tj", ()
                    put(value if value[:1] < "\xfe" else text_of(value.encode("latin-1")))
                elif kind == 6:
                    word, numbers = m[6], ()
                    value = number(word)
                    if value is not None:
                        put(value)
                        continue
                elif kind == 8:
                    inner = m[8]
                    put([text_of(v.encode("latin-1")) if v[:1] >= "\xfe" else v for v in ITEM.findall(inner)])
                    continue
                elif kind is None:
                    continue
                else:
                    if kind == 10:
                        value, at = strings_of(source, m.end())
                    elif kind == 9:
                        value, at = literal(source, m.end() - 1)
                    else:
                        value, at = hexadecimal(source, m.end() - 1)
                    put(value)
                    break
                seen += len(operands) + len(numbers) + 1
                if seen > TOKENS:
                    return page
                if word == "Tj":
                    if not numbers and operands and type(operands[-1]) is str:
                        text = show(operands[-1], text)
                elif word == "Td" or word == "TD":
                    if v := last(2):
                        if word == "TD":
                            leading = -v[1]
                        line = text = times(line, (1, 0, 0, 1, v[0], v[1]))
                elif word == "BT":
                    text = line = UNIT
                elif word == "ET":
                    pass
                elif word == "Tf":
                    if v := last(1):
                        size = v[0]
                elif word == "TJ":
                    if not numbers and operands and type(operands[-1]) is list:
                        for value in operands[-1]:
                            text = show(value, text)
                elif word == "Tm":
                    if v := last(6):
                        text = line = tuple(v)
                elif word == "re":
                    if v := last(4):
                        path.append((*ctm, *v))
                elif word in FILLS:
                    filled += [(*p, *fill) for p in path]
                    path = []
                elif word in ENDS:
                    path = []
                elif word == "rg":
                    if v := last(3):
                        fill = tuple(v)
                elif word == "g":
                    if v := last(1):
                        fill = (v[0],) * 3
                elif word == "k":
                    if v := last(4):
                        fill = tuple(1 - min(1.0, c + v[3]) for c in v[:3])
                elif word == "Tr":
                    if v := last(1):
                        mode = v[0]
                elif word == "q":
                    saved.append((ctm, fill))
                elif word == "Q":
                    if saved:
                        ctm, fill = saved.pop()
                elif word == "cm":
                    if v := last(6):
                        ctm = times(ctm, tuple(v))
                elif word == "T*":
                    line = text = times(line, (1, 0, 0, 1, 0, -leading))
                elif word == "'" or word == '"':
                    if word == "'":
                        line = text = times(line, (1, 0, 0, 1, 0, -leading))
                    if not numbers and operands and type(operands[-1]) is str:
                        text = show(operands[-1], text)
                elif word == "Tz":
                    if v := last(1):
                        scale = v[0]
                elif word == "TL":
                    if v := last(1):
                        leading = v[0]
                if operands:
                    operands.clear()
            else:
                if m is None or seen + len(operands) > TOKENS:
                    return page
                continue
            break
    return page
