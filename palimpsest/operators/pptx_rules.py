"""The PowerPoint rules over package entries: joins of parts, one exploded pass over the slides' shapes, grouped lists.

Evidence derived more than once (relationships, shapes) is a DataFrame of its own; Spark shares or prunes it per branch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import xml
from ..functions.text import EDGE, SPACE, compact, format_bytes, squeezed
from ..functions.urls import without_secrets
from ..sources.content import squeeze
from .evidence import NEED
from .packages import LARGE, RATIO, comment_authors, compression_ratio, encrypted, nth_of_name, orphans, safe_path
from .rules import emit, hit, in_order, listed

#: The checks that a report names, and (in ``coverage``) what limits one.
CHECKS = ("Office package structure, integrity, and entry safety", "Macros and executable content", "Author, company, and custom document properties",
          "Speaker notes, hidden slides, hidden objects, off-slide objects, cropped images, and alt text", "Comments and collaboration data",
          "Embedded files, custom XML, and retained application data", "External relationships and linked data", "Embedded image metadata")
OPENED = "Office package structure"
CORE = (("creator", "docProps/core.xml", "creator"), ("lastModifiedBy", "docProps/core.xml", "lastModifiedBy"), ("company", "docProps/app.xml", "Company"),
        ("manager", "docProps/app.xml", "Manager"), ("template", "docProps/app.xml", "Template"))
#: What a finding's data tells of the document's properties, in this order.
FIELDS = ("creator", "lastModifiedBy", "title", "subject", "keywords", "company", "manager", "template", "application")
SLIDE = r"(?i)^ppt/slides/slide(\d+)\.xml$"
STEP = 10**9  # between groups of rules in the order of emission


def number(raw: Column) -> Column:
    """An attribute as a number: absent is null, blank is 0."""
    return F.when(squeezed(raw) == "", 0.0).otherwise(raw.try_cast("double"))


def one_of(value: Column, *words: str) -> Column:
    return F.lower(F.coalesce(value, F.lit(""))).isin(*words)


def named(entries: DataFrame) -> DataFrame:
    """The parts: of entries with equal names the last."""
    return entries.where("part")


def required(entries: DataFrame) -> DataFrame:
    """Files whose package has the required parts."""
    return entries.where("whole AND idx = 0").select("file_id")


def structure_hits(files: DataFrame, entries: DataFrame) -> DataFrame:
    unreadable = emit(entries.where("idx = -1"), hit(0, "pptx.package.invalid", evidence=F.col("error")))
    ratio = compression_ratio(F.col("packed"), F.col("unpacked"))
    e = nth_of_name(entries.where("idx >= 0")).withColumn("ratio", ratio)
    named_ = F.concat(F.lit("Duplicate or case-colliding entry name: "), "name")
    at = F.col("idx").cast("bigint") * 4
    odd = emit(
        e,
        hit(at, "pptx.package.unsafe-path", ~safe_path(F.col("name")), evidence=F.col("name")),
        hit(at + 1, "pptx.package.duplicate-name", F.col("nth") > 1, evidence=F.col("name"), summary=named_),
        hit(at + 2, "pptx.package.large-entry", F.col("unpacked") > LARGE, evidence=F.col("name")),
        hit(at + 3, "pptx.package.high-compression-ratio", F.col("ratio") > RATIO, evidence=F.col("name"),
            summary=F.concat(F.lit("Entry compression ratio is "), F.when(F.col("ratio") == float("inf"), "Infinity").otherwise(F.floor(F.col("ratio") + 0.5).cast("string")), F.lit(":1."))))
    odd = odd.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("ord"))).where("nth <= 30").drop("nth")
    locked = e.where(encrypted(F.col("flags"))).groupBy("file_id").agg(in_order(F.lit(True), F.col("name"), F.col("idx")).alias("names"))
    n = F.size("names")
    locked = emit(locked, hit(STEP, "pptx.package.encrypted-entry", evidence=listed(F.col("names"), 8, ", "),
                              summary=F.concat(n.cast("string"), F.lit(" internal file"), F.when(n == 1, "").otherwise("s"), F.lit(" are encrypted."))))
    empty = files.where("detected = 'zip'").join(entries.where("idx = -1").select("file_id"), "file_id", "left_anti")
    bare = emit(empty.join(required(entries), "file_id", "left_anti"), hit(STEP + 1, "pptx.package.signature"))
    return unreadable.unionByName(odd).unionByName(locked).unionByName(bare)


def relationships(parts: DataFrame) -> DataFrame:
    """file_id, part (the .rels), idx, seq, rel_id, type, target, external of each relationship with an id or a target."""
    t = parts.where("name LIKE '%.rels' AND text <> ''").select("file_id", F.col("name").alias("part"), "idx", F.posexplode(xml.tags(F.col("text"), "Relationship")).alias("seq", "t"))
    a = {n: xml.attribute(F.col("t.attributes"), n) for n in ("Id", "id", "Type", "Target", "TargetMode")}
    rows = t.select("file_id", "part", "idx", "seq", F.coalesce(F.nullif(a["Id"], F.lit("")), a["id"], F.lit("")).alias("rel_id"), F.coalesce(a["Type"], F.lit("")).alias("type"),
                    F.coalesce(a["Target"], F.lit("")).alias("target"), (F.lower(F.coalesce(a["TargetMode"], F.lit(""))) == "external").alias("external"))
    return rows.where("rel_id <> '' OR target <> ''")


def package_hits(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Rules that look at lists of a file's parts. The patterns of their names are fixed values."""
    name, idx = F.col("name"), F.col("idx")
    text_of = lambda part: F.max(F.when(name == part, F.coalesce("text", F.lit(""))))
    matching = lambda p, **k: in_order(name.rlike(p), k.get("value", name), idx)
    shown = F.concat(name, F.lit(" ("), format_bytes(F.col("unpacked")), F.lit(")"))
    custom_xml = compact(xml.strip_xml(F.coalesce("text", F.lit(""))), 600)
    whole = parts.groupBy("file_id").agg(
        matching(r"(?i)(^|/)vbaProject\.bin$").alias("macros"), text_of(NEED[0]).alias("types"), text_of("docProps/core.xml").alias("core"), text_of("docProps/app.xml").alias("app"),
        text_of("docProps/custom.xml").alias("custom"), matching(r"(?i)^ppt/comments/.*\.xml$").alias("comments"),
        matching(r"(?i)(^|/)(people|persons|authors|commentAuthors)\.xml$|/commentsExt/").alias("people"),
        in_order(name.startswith("ppt/embeddings/") & ~F.col("directory"), shown, idx).alias("embedded"),
        matching(r"(?i)^customXml/(?!_rels/).*\.xml$").alias("custom_names"), matching(r"(?i)^customXml/(?!_rels/).*\.xml$", value=custom_xml).alias("custom_texts"),
        matching(r"(?i)(revision|userData|viewProps|presProps|tags)/").alias("state")).join(files.select("file_id", "extension"), "file_id")
    macro = (F.size("macros") > 0) | F.col("types").rlike(r"(?i)presentation\.macroEnabled\.main\+xml")
    part = {"docProps/core.xml": "core", "docProps/app.xml": "app"}
    value = lambda p, tag: xml.first_text(F.coalesce(part[p], F.lit("")), tag)
    identity = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), value(p, tag).alias("v")) for k, p, tag in CORE]), lambda x: x["v"] != "")
    of = {k: (p, tag) for k, p, tag in CORE} | {k: ("docProps/core.xml", k) for k in ("title", "subject", "keywords")} | {"application": ("docProps/app.xml", "Application")}
    fields = F.struct(*[value(*of[k]).alias(k) for k in FIELDS])
    pairs = lambda rows: F.transform(rows, lambda x: F.concat(x["k"], F.lit(": "), x["v"]))
    properties = F.filter(F.transform(xml.tags(F.coalesce("custom", F.lit("")), "property"), lambda t: F.struct(
        F.coalesce(F.nullif(xml.attribute(t["attributes"], "name"), F.lit("")), F.lit("Custom property")).alias("k"), compact(xml.strip_xml(t["inner"]), 300).alias("v"))), lambda x: x["v"] != "")
    whole = whole.withColumns({"identity": pairs(identity), "properties": pairs(properties), "macro": macro})
    read = F.filter(F.arrays_zip(F.slice("custom_names", 1, 20).alias("name"), F.slice("custom_texts", 1, 20).alias("text")), lambda x: x["text"] != "")
    whole = whole.withColumn("read", read)
    excerpts = F.transform("read", lambda x: F.concat(x["name"], F.lit(": "), x["text"]))
    base = emit(
        whole,
        hit(2 * STEP, "pptx.macro", F.col("macro"), evidence=F.when(F.size("macros") > 0, F.array_join("macros", ", ")).otherwise("Macro-enabled presentation content type")),
        hit(2 * STEP + 1, "pptx.macro.extension-mismatch", F.col("macro") & (F.col("extension") == "pptx")),
        hit(2 * STEP + 2, "pptx.metadata.personal", F.size("identity") > 0, evidence=listed(F.col("identity"), 8, "; "), data=F.to_json(F.struct(fields.alias("fields")))),
        hit(2 * STEP + 3, "pptx.metadata.custom", F.size("properties") > 0, evidence=listed(F.col("properties"), 10, "; "), scan=F.array_join("properties", "\n"), scan_location="Custom document properties"),
        hit(400 * STEP, "pptx.collaboration", (F.size("people") > 0) & (F.size("comments") == 0), evidence=listed(F.col("people"), 10, ", ")),
        hit(500 * STEP, "pptx.embedded-files", F.size("embedded") > 0, evidence=listed(F.col("embedded"), 15, ", ")),
        hit(501 * STEP, "pptx.custom-xml", F.size("custom_names") > 0, evidence=F.when(F.size("read") > 0, listed(excerpts, 8, " | ")).otherwise(listed(F.col("custom_names"), 10, ", "))),
        hit(502 * STEP, "pptx.retained-state", F.size("state") > 0, evidence=listed(F.col("state"), 12, ", ")))
    inner = emit(whole.select("file_id", F.posexplode("read").alias("k", "x")), hit(500 * STEP + 1 + F.col("k"), "", scan=F.col("x.text"), location=F.col("x.name")))
    return base.unionByName(inner)


def written(n: Column) -> Column:
    """A whole number of any size as it is shown: all digits below 10**21, else with an exponent."""
    text = n.cast("string")
    digits, power = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$|\.", ""), F.substring_index(text, "E", -1).try_cast("int")
    short = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    return F.when(n < 2.0**53, n.try_cast("bigint").cast("string")).when(n == float("inf"), "Infinity").when(
        n < 1e21, F.rpad(digits, power + 1, "0")).otherwise(F.concat(short, F.lit("e+"), power.cast("string")))


def slides(parts: DataFrame) -> DataFrame:
    """The slides with their number, however many digits its name has, and ``turn``, their place by number within the file."""
    rows = parts.where(F.col("name").rlike(SLIDE) & (F.coalesce("text", F.lit("")) != "")).select(
        "file_id", "idx", F.col("name").alias("slide"), F.regexp_extract("name", SLIDE, 1).try_cast("double").alias("n"), F.col("text").alias("xml"),
        xml.relationships_part(F.col("name")).alias("part"))
    turn = F.row_number().over(Window.partitionBy("file_id").orderBy("n", "idx"))
    return rows.select("file_id", "slide", written(F.col("n")).alias("number"), turn.cast("bigint").alias("turn"), "xml", "part")


def slide_hits(parts: DataFrame, rels: DataFrame) -> DataFrame:
    s = slides(parts)
    place = F.concat(F.lit("Slide "), "number")
    base = 10 * STEP + F.col("turn") * 1_000_000
    root = F.regexp_extract("xml", rf"(?is)<p:sld{EDGE}([^>]*)>", 1)
    text = compact(xml.text_runs(F.col("xml")), 1600)
    hidden = emit(s.withColumn("text", text).withColumn("off", one_of(xml.attribute(root, "show"), "0", "false", "off", "no")),
                  hit(base, "pptx.slide.hidden", F.col("off"), evidence=F.coalesce(F.nullif("text", F.lit("")), F.lit("Hidden slide with no extractable text")), location=place, scan=F.col("text")))
    linked = s.join(rels, ["file_id", "part"]).select("file_id", "slide", "number", "turn", "seq", "rel_id", "type", xml.resolve_part(F.col("slide"), F.col("target")).alias("to"))
    notes = linked.where(F.col("type").rlike("(?i)/notesSlide$")).groupBy("file_id", "slide", "number", "turn").agg(F.min_by("to", "seq").alias("name"))
    texts = parts.select("file_id", "name", F.coalesce("text", F.lit("")).alias("xml"))
    spoken = notes.join(texts, ["file_id", "name"]).withColumn("text", compact(xml.text_runs(F.col("xml")), 2400)).where("text <> ''")
    spoken = emit(spoken, hit(base + 1, "pptx.notes", evidence=F.col("text"), location=place, scan=F.col("text"), scan_location=F.concat(place, F.lit(" speaker notes"))))
    lost = orphans(parts.where(F.col("name").rlike(r"(?i)^ppt/notesSlides/notesSlide\d+\.xml$")), notes.select("file_id", "name"), ["file_id", "name"])
    lost = lost.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("idx"))).where("nth <= 20")
    lost = lost.withColumn("said", compact(xml.text_runs(F.coalesce("text", F.lit(""))), 1800)).where("said <> ''")
    lost = emit(lost, hit(300 * STEP + F.col("nth"), "pptx.notes.orphaned", evidence=F.col("said"), location=F.col("name"), scan=F.col("said")))
    return hidden.unionByName(spoken).unionByName(lost).unionByName(shape_hits(parts, s, linked))


def shapes(parts: DataFrame, s: DataFrame) -> DataFrame:
    """One row for each shape block with its properties, box, crop and relationship id."""
    p = F.lit(rf"(?is)<p:(sp|pic|graphicFrame|cxnSp){EDGE}.*?</p:\1[{SPACE}]*>")
    blocks = F.arrays_zip(F.regexp_extract_all("xml", p, F.lit(0)).alias("xml"), F.regexp_extract_all("xml", p, F.lit(1)).alias("type"))
    b = s.select("file_id", "slide", "number", "turn", F.posexplode(blocks).alias("seq", "b")).select("file_id", "slide", "number", "turn", "seq", F.col("b.xml").alias("xml"), F.col("b.type").alias("type"))
    moved = F.regexp_extract("xml", rf"(?is)<a:xfrm{EDGE}[^>]*>(.*?)</a:xfrm[{SPACE}]*>", 1)
    b = b.withColumns({"props": tag(F.col("xml"), "p:cNvPr"), "moved": F.when(moved != "", moved).otherwise(F.col("xml")), "rect": tag(F.col("xml"), "a:srcRect"), "blip": tag(F.col("xml"), "a:blip")})
    b = b.withColumns({"off": tag(F.col("moved"), "a:off"), "ext": tag(F.col("moved"), "a:ext")})
    at = lambda col, name: xml.attribute(F.col(col), name)
    text = lambda name: F.coalesce(at("props", name), F.lit(""))
    return b.join(slide_sizes(parts), "file_id").select(
        "file_id", "slide", "number", "turn", "seq", "type", F.coalesce(F.nullif(text("name"), F.lit("")), F.trim(F.concat(F.lit("Object "), text("id")))).alias("name"),
        one_of(at("props", "hidden"), "1", "true", "on", "yes").alias("hidden"), text("descr").alias("descr"), text("title").alias("title"), compact(xml.text_runs(F.col("xml")), 1000).alias("text"),
        *[number(at("off", a)).alias(a) for a in "xy"], *[number(at("ext", a)).alias(a) for a in ("cx", "cy")],
        *[number(F.coalesce(F.nullif(at("rect", a), F.lit("")), F.lit("0"))).alias(f"crop_{a}") for a in "ltrb"],
        F.coalesce(F.nullif(at("blip", "r:embed"), F.lit("")), at("blip", "embed"), F.lit("")).alias("rel_id"), "width", "height")


def tag(col: Column, name: str) -> Column:
    """The attributes of the first such tag."""
    return F.regexp_extract(col, rf"(?i)<{name}{EDGE}([^>]*)/?[{SPACE}]*>", 1)


def slide_sizes(parts: DataFrame) -> DataFrame:
    """file_id, width and height of the slides."""
    size = parts.where(f"name = '{NEED[1]}'").select("file_id", tag(F.coalesce("text", F.lit("")), "p:sldSz").alias("sz"))
    width, height = (F.coalesce(F.nullif(number(xml.attribute(F.col("sz"), a)), F.lit(0.0)), F.lit(float(d))) for a, d in zip(("cx", "cy"), g.SLIDE))
    return size.select("file_id", width.alias("width"), height.alias("height"))


def shape_hits(parts: DataFrame, s: DataFrame, linked: DataFrame) -> DataFrame:
    media = linked.groupBy("file_id", "slide", "rel_id").agg(F.max_by("to", "seq").alias("media"))
    sh = shapes(parts, s).join(media, ["file_id", "slide", "rel_id"], "left")
    place = F.concat(F.lit("Slide "), "number", F.lit(" — "), "name")
    base = 10 * STEP + F.col("turn") * 1_000_000 + 2 + F.col("seq") * 4
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    joined = lambda sep, *c: F.array_join(F.filter(F.array(*c), lambda x: x != ""), sep)
    held, words = first("text", "descr", "title", "name"), joined("\n", "text", "descr", "title")
    crop = [F.col(f"crop_{a}") for a in "ltrb"]
    beside = g.off_slide(*[F.col(c) for c in ("x", "y", "cx", "cy")], F.col("width"), F.col("height"))
    return emit(
        sh,
        hit(base, "pptx.object.hidden", F.col("hidden"), evidence=held, location=place, scan=words),
        hit(base + 1, "pptx.object.off-slide", beside, evidence=held, location=place, scan=words, data=F.to_json(F.struct(F.struct("x", "y", F.col("cx").alias("width"), F.col("cy").alias("height")).alias("geometry")))),
        hit(base + 2, "pptx.image.cropped", g.has_crop(*crop) & (F.col("type") == "pic"), evidence=first("media", "name"), location=place,
            data=F.to_json(F.struct(F.struct(*[c.alias(n) for c, n in zip(crop, ("left", "top", "right", "bottom"))]).alias("crop")))),
        hit(base + 3, "", joined(" — ", "title", "descr") != "", scan=joined(" — ", "title", "descr"), location=F.concat(place, F.lit(" alternate text"))))


def comment_hits(parts: DataFrame) -> DataFrame:
    c = parts.where(F.col("name").rlike(r"(?i)^ppt/comments/.*\.xml$"))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("idx"))).where("nth <= 200").withColumn("xml", F.coalesce("text", F.lit("")))
    values = F.filter(F.transform(xml.tags(F.col("xml"), "text"), lambda t: compact(xml.strip_xml(t["inner"]), 2000)), lambda v: v != "")
    runs = xml.text_runs(F.col("xml"))
    c = c.withColumns({"values": values, "runs": runs})
    text = compact(F.array_join(F.when((F.col("runs") != "") & ~F.array_contains("values", F.col("runs")), F.array_append("values", F.col("runs"))).otherwise(F.col("values")), " | "), 4000)
    c = c.withColumn("said", text).where("said <> ''").select("file_id", F.col("name").alias("part"), "nth", "said", F.regexp_extract_all("xml", F.lit(rf"""(?i)authorId[{SPACE}]*=[{SPACE}]*["']([^"']+)["']"""), F.lit(1)).alias("ids"))
    who = parts.where("name = 'ppt/commentAuthors.xml'").select("file_id", F.posexplode(xml.tags(F.coalesce("text", F.lit("")), "cmAuthor")).alias("k", "t"))
    a = lambda n: F.nullif(xml.attribute(F.col("t.attributes"), n), F.lit(""))
    who = who.select("file_id", "k", F.coalesce(a("id"), F.lit("")).alias("author_id"), a("name").alias("name"), a("initials").alias("initials"))
    who = who.groupBy("file_id", "author_id").agg(F.max_by(F.struct("name", "initials"), "k").alias("w")).select("file_id", "author_id", "w.name", "w.initials")
    seen = c.select("file_id", "part", F.posexplode("ids").alias("seq", "author_id"))
    c = c.join(comment_authors(seen, who), ["file_id", "part"], "left")
    return emit(c, hit(350 * STEP + F.col("nth"), "pptx.comments", evidence=F.col("said"), scan=F.col("said"), scan_location=F.col("part"),
                       location=F.concat_ws(" — ", "part", F.nullif("authors", F.lit("")))))


def safe_target(target: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: squeeze(without_secrets(v), 220))

    return F.pandas_udf(run, "string")(target)


def link_hits(rels: DataFrame) -> DataFrame:
    e = rels.where("external").withColumns({"link": xml.link_class(F.col("type"), F.col("target")), "safe": safe_target(F.col("target"))})
    kind = lambda k, value: in_order(F.col("link") == k, value, F.col("idx"), F.col("seq"))
    whole = e.groupBy("file_id").agg(kind("local-path", F.col("safe")).alias("local"), kind("hyperlink", F.col("safe")).alias("hyper"),
                                     kind("linked-data", F.concat(F.substring_index("type", "/", -1), F.lit(": "), "safe")).alias("data"))
    base = emit(whole, *[hit(i * STEP, f"pptx.external.{rule}", F.size(c) > 0, evidence=listed(F.col(c), 12, ", "))
                         for i, rule, c in ((600, "local-path", "local"), (601, "linked-data", "data"), (602, "hyperlinks", "hyper"))])
    at = F.row_number().over(Window.partitionBy("file_id").orderBy("idx", "seq"))
    inner = e.where("link = 'hyperlink'").withColumn("at", at)
    return base.unionByName(emit(inner, hit(602 * STEP + F.col("at"), "", scan=F.col("target"), location=F.concat("part", F.lit(" external relationship")))))


def image_hits(parts: DataFrame) -> DataFrame:
    m = parts.where("fields IS NOT NULL AND (latitude IS NOT NULL OR size(fields) > 0)")
    degrees = F.concat("name", F.lit(": "), F.format_string("%.5f", "latitude"), F.lit(", "), F.format_string("%.5f", "longitude"))
    fields = F.array_join(F.transform(F.slice("fields", 1, 5), lambda f: F.concat(f["name"], F.lit("="), compact(f["value"], 80))), ", ")
    whole = m.groupBy("file_id").agg(in_order(F.col("latitude").isNotNull(), degrees, F.col("idx")).alias("gps"),
                                     in_order(F.size("fields") > 0, F.concat("name", F.lit(": "), fields), F.col("idx")).alias("fields"))
    return emit(whole, hit(700 * STEP, "pptx.image.gps", F.size("gps") > 0, evidence=listed(F.col("gps"), 8, "; ")),
                hit(701 * STEP, "pptx.image.metadata", F.size("fields") > 0, evidence=listed(F.col("fields"), 8, "; ")))


def hits(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Rule rows of the packages; without the required parts only those on the structure."""
    parts = named(entries).where("whole")
    rels = relationships(parts)
    rows = structure_hits(files, entries)
    for more in (package_hits(files, parts), slide_hits(parts, rels), comment_hits(parts), link_hits(rels), image_hits(parts)):
        rows = rows.unionByName(more)
    return rows


def coverage(files: DataFrame, entries: DataFrame, strict: bool = True) -> DataFrame:
    """file_id, checks, limitations. ``strict``: an optional part that cannot be read is a limitation too."""
    from ..sources.archives import MEDIA_BYTES, XML_BYTES

    needed = F.col("name").isin(*NEED) | F.col("name").rlike(SLIDE)
    xml_part = F.lower("name").rlike(r"\.(xml|rels)$")
    media = F.col("name").startswith("ppt/media/")
    limit = F.when(F.col("idx") == -1, F.col("error")).when(
        xml_part & (F.col("unpacked") > XML_BYTES), F.concat("name", F.lit(" exceeds the XML inspection limit."))).when(
        media & (F.col("unpacked") > MEDIA_BYTES), F.concat("name", F.lit(" exceeds the embedded-image metadata inspection limit."))).when(
        F.col("error").isNotNull() & media & F.col("zip_error"), F.concat("name", F.lit(" could not be inspected: "), "error")).when(
        F.col("error").isNotNull() & xml_part & (needed | F.lit(strict)), F.concat("name", F.lit(" could not be read: "), "error"))
    held = entries.groupBy("file_id").agg(in_order(limit.isNotNull(), limit, F.col("idx")).alias("limits"), F.bool_or(encrypted(F.col("flags"))).alias("locked"), F.bool_or(F.col("idx") == -1).alias("closed"))
    rows = files.where("detected = 'zip'").select("file_id").join(held, "file_id", "left").join(required(entries).withColumn("whole", F.lit(True)), "file_id", "left")
    closed, bare = F.coalesce("closed", F.lit(False)), F.col("whole").isNull()
    more = F.array_compact(F.array(F.when(F.col("locked"), "Encrypted package entries were not inspected.")))
    limits = F.when(bare & ~closed, F.array(F.lit("Required PowerPoint package parts are missing."))).otherwise(
        F.concat(more, F.coalesce("limits", F.array().cast("array<string>"))))
    checks = F.when(closed, F.array(F.lit(OPENED))).when(bare, F.array(F.lit(CHECKS[0]))).otherwise(F.lit(list(CHECKS)))
    return rows.select("file_id", checks.alias("checks"), limits.alias("limitations"))


def details(files: DataFrame, entries: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """The counters of presentation reports, by file_id; ``rule_rows`` are the rows of ``hits``."""
    parts = named(entries).where("whole")
    count = lambda *rules: F.count_if(F.col("rule").isin(*rules))
    many = lambda p: F.count_if(F.col("name").rlike(p))
    opened = entries.where("idx >= 0").groupBy("file_id").agg(F.count("*").alias("packageEntries"), F.bool_or("zip64").alias("zip64"))
    held = parts.groupBy("file_id").agg(
        many(SLIDE).alias("slides"), many(r"(?i)^ppt/comments/.*\.xml$").alias("commentFiles"), F.count_if(F.col("name").startswith("ppt/embeddings/") & ~F.col("directory")).alias("embeddedFiles"),
        many(r"(?i)^customXml/(?!_rels/).*\.xml$").alias("customXmlParts"), F.count_if(F.col("latitude").isNotNull() | (F.size("fields") > 0)).alias("imagesWithMetadata"))
    shown = rule_rows.groupBy("file_id").agg(
        count("pptx.notes", "pptx.notes.orphaned").alias("notes"), count("pptx.slide.hidden").alias("hiddenSlides"), count("pptx.object.hidden").alias("hiddenObjects"),
        count("pptx.object.off-slide").alias("offSlideObjects"), count("pptx.image.cropped").alias("croppedImages"), count("pptx.comments").alias("commentsWithText"))
    links = relationships(parts).where("external").groupBy("file_id").agg(F.count("*").alias("externalRelationships"))
    whole = held.join(shown, "file_id", "left").join(links, "file_id", "left").fillna(0)
    return opened.join(slide_sizes(parts).select("file_id", F.struct("width", "height").alias("slideSize")), "file_id", "left").join(whole, "file_id", "left")
