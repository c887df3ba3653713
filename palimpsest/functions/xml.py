"""Regex-based XML and OOXML functions as Column expressions; any prefix, any case, malformed input welcome."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, SPACE, compact, let

PREFIX = r"(?:(?:[A-Za-z_][\w.-]*):)?"
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"))


def tag_pattern(name: str, edge: str = EDGE) -> str:
    """Fixed value: what a tag looks like, with what stands before its end tag if there is one."""
    name = re.escape(name)
    return rf"(?is)<{PREFIX}{name}{edge}([^>]*)/?>(?:(.*?)</{PREFIX}{name}[{SPACE}]*>)?"


def decode_xml(text: Column) -> Column:
    """Five named and all numeric entities, each decoded once; what names no character stays."""
    mark = "\uE0FF\uE0FE"
    text = F.regexp_replace(text, "(?i)&amp;", mark)
    for name, char in ENTITIES:
        text = F.regexp_replace(text, f"(?i)&{name};", char)

    def put(whole: Column, entity: Column) -> Column:
        body = F.regexp_extract(entity, "(?i)&#(x?[0-9a-f]+);", 1)
        digits = F.regexp_replace(F.regexp_replace(body, "(?i)^x", ""), "^0+(?=.)", "")
        code = F.when(F.length(digits) <= 8, F.when(body.rlike("(?i)^x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))).cast("bigint")

        def written(c: Column) -> Column:
            char = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
            return F.when(c.between(0, 0xD7FF) | c.between(0xE000, 0x10FFFF), F.replace(whole, entity, char)).otherwise(whole)

        return let(code, written)

    def numbers(plain: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(plain, F.lit("(?i)(&#(?:x[0-9a-f]+|[0-9]+);)"), F.lit(1)))
        return F.aggregate(found, plain, put)

    return F.regexp_replace(let(text, numbers), mark, "&")


def strip_xml(text: Column) -> Column:
    """The text without tags: CDATA unwrapped, breaks and paragraph ends as new lines, other tags as blanks. The patterns are fixed values."""
    for pattern, to in ((r"(?is)<\?xml.*?\?>", ""), (r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), (rf"(?i)<(?:a:)?br[{SPACE}]*/?>", "\n"),
                        (rf"(?i)</(?:a:)?p[{SPACE}]*>", "\n"), (r"<[^>]+>", " ")):
        text = F.regexp_replace(text, pattern, to)
    text = decode_xml(text)
    for pattern, to in ((r"[\t ]+", " "), (rf"[{SPACE}]*\n[{SPACE}]*", "\n"), (rf"^[{SPACE}]+|[{SPACE}]+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def tags(xml: Column, name: str) -> Column:
    """array<struct<raw, attributes, inner>> of all tags of that local name; attributes as written."""
    p = F.lit(tag_pattern(name))
    return F.arrays_zip(*[F.regexp_extract_all(xml, p, F.lit(g)).alias(n) for g, n in enumerate(("raw", "attributes", "inner"))])


#: Fixed value: what an attribute looks like.
ATTRIBUTE = rf"""([A-Za-z_][\w:.-]*)[{SPACE}]*=[{SPACE}]*(?:"([^"]*)"|'([^']*)')"""


def attribute(raw: Column, name: str) -> Column:
    """The last value of the attribute, decoded; null where it is absent."""
    def last(r: Column) -> Column:
        each = F.arrays_zip(*[F.regexp_extract_all(r, F.lit(ATTRIBUTE), F.lit(g)).alias(n) for g, n in enumerate("kab", 1)])
        return F.try_element_at(F.filter(each, lambda a: a["k"] == name), F.lit(-1))

    return decode_xml(let(let(raw, last), lambda a: F.concat(a["a"], a["b"])))


def text_runs(xml: Column) -> Column:
    """The contents of all ``t`` elements (the pattern is a fixed value) with one blank between them."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:[A-Za-z_][\w.-]*:)?t{EDGE}[^>]*>(.*?)</(?:[A-Za-z_][\w.-]*:)?t[{SPACE}]*>"), F.lit(1))
    return F.trim(F.regexp_replace(F.array_join(F.transform(found, decode_xml), " "), f"[{SPACE}]+", " "))


def first_text(xml: Column, name: str) -> Column:
    first = F.try_element_at(tags(xml, name), F.lit(1))["inner"]
    return F.coalesce(compact(strip_xml(first), 500), F.lit(""))


def resolve_part(base: Column, target: Column) -> Column:
    """A relationship target as a part name: relative to the folder of ``base`` unless it begins with a slash."""
    folder = F.split(F.regexp_replace(base, "[^/]*$", ""), "/")
    start = F.filter(F.slice(folder, 1, F.size(folder) - 1), lambda s: F.lit(True))
    steps = F.split(F.replace(target, F.lit("\\"), F.lit("/")), "/")
    walked = F.aggregate(steps, start, lambda path, s: F.when(s.isin("", "."), path).when(
        s == "..", F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(s))))
    return F.when(target == "", "").when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.array_join(walked, "/"))


def relationships_part(part: Column) -> Column:
    leaf = F.substring_index(part, "/", -1)
    return F.concat(F.substring(part, 1, F.length(part) - F.length(leaf)), F.lit("_rels/"), leaf, F.lit(".rels"))


#: How a link to a local or network path begins.
LOCAL = r"(?i)^(?:file:|[A-Za-z]:[\\/]|\\\\|/Users/|/home/)"


def link_class(kind: Column, target: Column) -> Column:
    return F.when(target.rlike(LOCAL), "local-path").when(kind.rlike("(?i)/hyperlink$"), "hyperlink").otherwise("linked-data")
