"""The kernel of the sensitive-value rules: all matches of a text in one pass of a Python worker, batch by batch.

A rule's pattern is only tried where a literal that it begins with stands, numbers only in runs of digits; the rules are tried in their
order and no longer than until a text's matches are full. Patterns mean what they mean as Java patterns: ASCII classes and borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import SPACE

#: What a match begins with; for the rules of any case, in lower case.
BEGINS = {
    "private-key": ("-----begin ",), "aws-access-key": ("AKIA", "ASIA"), "google-api-key": ("AIza",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm-token": ("npm_",), "slack-token": ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), "stripe-secret": ("sk_live_", "sk_test_"), "sendgrid-key": ("SG.",), "jwt": ("eyJ",),
    "bearer-token": ("bearer",), "credential-assignment": ("api", "client", "secret", "passw", "token"), "connection-string": ("postgres", "mysql://", "mongodb", "redis://"),
    "internal-url": ("http://", "https://"),
}
ANY_CASE = "(?i)"
#: Behind the first character of a match: there is a border before it.
AFTER = r"(?<![A-Za-z0-9_]{0})"
#: An IBAN's pattern, spelt so that it begins with a class that the engine looks for first.
IBAN = r"[A-Z]" + AFTER.format("[A-Z]") + r"[A-Z][0-9]{2}(?:[ ]?[A-Z0-9]){11,30}\b"
#: Digits, single blanks and hyphens between them; what SSNs and card numbers are found in.
RUN, GROUP = re.compile("([0-9][0-9]*+)(?:[ -][0-9]++)*+"), re.compile("[0-9]+")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
#: One of these is in every text with a match, of whatever rule, as a pattern for RE2: most short texts hold none.
SOME = "(?i)-----|akia|asia|aiza|gh[pousr]_|npm_|xox|sk_|sg[.]|eyj|bearer|api|client|secret|passw|token|postgres|mysql|mongodb|redis|https?://|@|[0-9][ -]?[0-9]"
AT_SIGN = re.compile(r"@[A-Z0-9.-]+\.[A-Z]{2,63}\b", re.ASCII | re.IGNORECASE)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPACES, DOUBLED = re.compile(f"[{SPACE}]+"), bytes.maketrans(b"0123456789", b"0246813579")


def luhn(value: str) -> bool:
    """13 to 19 digits, not all the same, with a valid check digit."""
    digits = value.replace(" ", "").replace("-", "").encode()
    if not 13 <= len(digits) <= 19 or digits == digits[:1] * len(digits):
        return False
    return (sum(digits[-1::-2]) + sum(digits[-2::-2].translate(DOUBLED)) - 48 * len(digits)) % 10 == 0


def iban(value: str) -> bool:
    """Remainder 1 modulo 97, letters counting as 10 to 35."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def cut(text: str, first: int, last: int) -> tuple[str, str]:
    """The ``first`` and the ``last`` UTF-16 units; a pair that would be cut in half is left out."""
    raw = text.encode("utf-16-be")
    head, tail = raw[: 2 * first], raw[len(raw) - 2 * last:] if last else b""
    head = head[:-2] if head and 0xD8 <= head[-2] <= 0xDB else head
    tail = tail[2:] if tail and 0xDC <= tail[0] <= 0xDF else tail
    return head.decode("utf-16-be"), tail.decode("utf-16-be")


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def redact(value: str) -> str:
    """White space squeezed, cut to 240 units; then the first six and last four units, or all of up to twelve."""
    plain = value.isascii() and value.isprintable() and "  " not in value  # no white space but single blanks
    clean = (value if plain else SPACES.sub(" ", value)).strip(" ")
    if units(clean) > 240:
        clean = cut(clean, 239, 0)[0].rstrip(" ") + "…"
    if units(clean) <= 12:
        return clean
    return clean[:6] + "…" + clean[-4:] if clean.isascii() else "…".join(cut(clean, 6, 4))


def lower(text: str) -> str:
    """ASCII letters in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def addresses(text: str, pattern: re.Pattern) -> Iterator[str]:
    """The pattern's matches: from an @ with a domain after it back to where its word may begin."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at > end and text[at - 1] in LOCAL and AT_SIGN.match(text, at):
            begin = at
            while begin > end and text[begin - 1] in LOCAL:
                begin -= 1
            m = pattern.search(text, begin)
            if m is None:
                return
            yield m.group()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """The groups (begin, end) of each run of digits that is long enough for a number.

    A number begins and ends with a group: inside one there is no border. A first group behind a word stands as (-1, end), a last one before a word as (begin, -1).
    """
    out = []
    for m in RUN.finditer(text):
        begin, end = m.span()
        if end - begin < 11:
            continue
        behind, before = begin > 0 and text[begin - 1] in WORD, end < len(text) and text[end] in WORD
        if m.end(1) == end:
            if 13 <= end - begin <= 19 and not behind and not before:
                out.append([(begin, end)])
            continue
        groups = [g.span() for g in GROUP.finditer(text, begin, end)]
        if behind:
            groups[0] = (-1, groups[0][1])
        if before:
            groups[-1] = (groups[-1][0], -1)
        out.append(groups)
    return out


def ssns(text: str, found: list[list[tuple[int, int]]]) -> Iterator[str]:
    for groups in found:
        i = 0
        while i + 2 < len(groups):
            (a, b), (c, d), (e, f) = groups[i: i + 3]
            if a >= 0 and f >= 0 and b - a == 3 and d - c == 2 and f - e == 4 and text[a] != "9" and text[a:b] not in ("000", "666") and text[c:d] != "00" and text[e:f] != "0000":
                yield text[a:f]
                i += 3
            else:
                i += 1


def cards(text: str, found: list[list[tuple[int, int]]]) -> Iterator[str]:
    """From each group on, the longest 13 to 19 digits in whole groups."""
    for groups in found:
        i = 0
        while i < len(groups):
            if len(groups) == 1:
                yield text[groups[0][0]: groups[0][1]]
                break
            first, digits, last = groups[i][0], 0, -1
            for j in range(i, len(groups) if first >= 0 else i):
                begin, end = groups[j]
                if end < 0:
                    break
                digits += end - begin
                if digits > 19:
                    break
                if digits >= 13:
                    last = j
            if last >= 0:
                yield text[first: groups[last][1]]
                i = last + 1
            else:
                i += 1


def beginning(text: str, looked: str, words: tuple[str, ...], pattern: re.Pattern) -> Iterator[str]:
    """The pattern's matches, each of which begins with one of the words."""
    places: list[int] = []
    for word in words:
        at = looked.find(word)
        while at >= 0:
            places.append(at)
            at = looked.find(word, at + 1)
    if len(words) > 1:
        places.sort()
    end = 0
    for at in places:
        if at >= end and (m := pattern.match(text, at)):
            yield m.group()
            end = m.end()


class Finder:
    """The matches of ``rules`` (id, label, severity, pattern, check), the first ``most`` of a text."""

    def __init__(self, rules: list[tuple[str, str, str, str, str]], most: int) -> None:
        self.most = most
        self.said = [[r[i] for r in rules] for i in range(3)]
        self.rules = [(k, name, re.compile(IBAN if name == "iban" else pattern.replace("<b>", r"\b").replace("<s>", SPACE), re.ASCII), pattern.startswith(ANY_CASE), {"luhn": luhn, "iban": iban}.get(check))
                      for k, (name, _, _, pattern, check) in enumerate(rules)]

    def found(self, text: str) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []
        low, digits = "", None
        for k, name, pattern, any_case, check in self.rules:
            if len(out) >= self.most:
                break
            if name in BEGINS:
                if any_case and not low:
                    low = lower(text)
                values = beginning(text, low if any_case else text, BEGINS[name], pattern)
            elif name == "email-address":
                values = addresses(text, pattern)
            elif name in ("us-ssn", "payment-card"):
                digits = runs(text) if digits is None else digits
                values = (ssns if name == "us-ssn" else cards)(text, digits)
            else:
                values = (m.group() for m in pattern.finditer(text))
            for value in values:
                if check is None or check(value):
                    out.append((k, value))
                    if len(out) >= self.most:
                        break
        return out

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Lists of (rule_ord, rule_id, label, severity, evidence); empty for a null text."""
        ends, order, evidence = [0], [], []
        raw = texts.cast(pa.binary())
        for i, some in enumerate(pc.match_substring_regex(raw, SOME).to_pylist()):
            if some:
                for k, value in self.found(raw[i].as_py().decode("utf-8", "replace")):
                    order.append(k)
                    evidence.append(redact(value))
            ends.append(len(order))
        place = pa.array(order, pa.int32())
        said = [pa.array(values, pa.string()).take(place) for values in self.said]
        items = pa.StructArray.from_arrays([place, *said, pa.array(evidence, pa.string())], names=["rule_ord", "rule_id", "label", "severity", "evidence"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def fnv1a(texts: pa.Array) -> pa.Array:
    """32-bit FNV-1a over UTF-16 units, eight hexadecimal digits (of no text: as of an empty one); all texts of a batch go on by one unit at a time."""
    raw = [(t.as_py() or b"").decode("utf-8", "replace").encode("utf-16-le") for t in texts.cast(pa.binary())]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    order = np.argsort(-size, kind="stable")  # those that go on are a prefix
    flat, begin = np.frombuffer(b"".join(raw), "<u2").astype(np.uint32), np.concatenate([[0], np.cumsum(size)])[:-1][order]
    alive, h = size[order], np.full(len(raw), 0x811C9DC5, np.uint32)
    n = len(raw)
    for i in range(int(alive[0]) if n else 0):
        while alive[n - 1] <= i:
            n -= 1
        h[:n] = (h[:n] ^ flat[begin[:n] + i]) * np.uint32(0x01000193)
    out = np.empty_like(h)
    out[order] = h
    return pa.array([f"{v:08x}" for v in out.tolist()], pa.string())
