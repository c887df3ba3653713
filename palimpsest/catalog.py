"""All registered queries of the exposure engine over the given tables, each with its SQL equivalent.

``documents.text`` and ``pages.html`` stand for concealed text units; numeric columns of ``lineitem`` and ``part``
stand for boxes; package entries, relationships and comments are derived from the rows of the star schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dealt, on_workers
from .functions import geometry as g
from .functions import sensitive, text, xml
from .operators import findings as fo
from .operators import packages as po
from .operators import pptx_rules
from .operators.rules import in_order, listed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import built_rules, files

    return QUERIES | files.QUERIES | built_rules.QUERIES


def oracle_sql() -> dict[str, str]:
    from .plans import built_rules

    return ORACLES | built_rules.ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text -------------------------------------------------------------------------------------------------------

_SPACE = sensitive.Rule("", "", "", "[<s>]+").re2()


def _compact(x: str, most: int) -> str:
    clean = f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"
    return f"CASE WHEN length({clean}) <= {most} THEN {clean} ELSE rtrim(substring({clean}, 1, {most - 1})) || '…' END"


def _redact(x: str) -> str:
    clean = _compact(x, 240)
    return f"CASE WHEN length({clean}) <= 12 THEN {clean} ELSE substring({clean}, 1, 6) || '…' || right({clean}, 4) END"


def _fnv(x: str) -> str:
    return (f"lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT))),"
            " lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0')")


@query(f"SELECT doc_id, {_compact('text', 180)} AS compacted FROM documents")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("compacted"))


@query(f"""SELECT page_id, {_compact("regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')", 220)} AS evidence FROM pages""")
def safe_evidence(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_evidence(F.col("html")).alias("evidence"))


@query(f"SELECT c_custkey, {_redact('c_name')} AS redacted, {_redact('c_mktsegment')} AS short FROM customer")
def redact_secret(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.redact(F.col("c_name")).alias("redacted"), text.redact(F.col("c_mktsegment")).alias("short"))


@query("SELECT page_id, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '[^.]*$')) ELSE '' END AS extension FROM pages")
def extension_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.extension_of(F.col("url")).alias("extension"))


@query(r"""SELECT page_id, CASE WHEN regexp_extract(replace(url, '\', '/'), '[^/]*$') = '' THEN url ELSE regexp_extract(replace(url, '\', '/'), '[^/]*$') END AS leaf FROM pages""")
def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("leaf"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * 1000 + o_orderkey AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B'
  WHEN n < 1048576 THEN CASE WHEN n / 1024.0::DOUBLE >= 10 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.2f KB', n / 1024.0::DOUBLE) END
  WHEN n < 1073741824 THEN CASE WHEN n / 1048576.0::DOUBLE >= 10 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f MB', n / 1048576.0::DOUBLE) END
  WHEN n < 1099511627776 THEN CASE WHEN n / 1073741824.0::DOUBLE >= 10 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END
  ELSE CASE WHEN n / 1099511627776.0::DOUBLE >= 10 THEN printf('%.1f TB', n / 1099511627776.0::DOUBLE) ELSE printf('%.2f TB', n / 1099511627776.0::DOUBLE) END END AS size
FROM s""")
def format_bytes(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 1000 + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_bytes(n).alias("size"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS escaped_sha256 FROM pages""")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("escaped_sha256"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '([\\`*_{}\[\]()#+\-.!|>])', '\\\1', 'g')) AS escaped_sha256 FROM documents""")
def escape_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.escape_markdown(F.col("text")), 256).alias("escaped_sha256"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def file_descriptor(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))


@query(f"SELECT page_id, {_fnv('url')} AS hash FROM pages")
def fnv1a_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.fnv1a(F.col("url")).alias("hash"))


# ---- sensitive values -------------------------------------------------------------------------------------------

_DIGITS = "regexp_replace({0}, '\\D', '', 'g')"


def _sql_check(check: str, x: str) -> str:
    if check == "luhn":
        d = _DIGITS.format(x)
        one = f"CAST(substring({d}, CAST(i AS INTEGER), 1) AS INTEGER)"
        double = f"CASE WHEN {one} * 2 > 9 THEN {one} * 2 - 9 ELSE {one} * 2 END"
        total = f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN {double} ELSE {one} END))"
        return f"length({d}) BETWEEN 13 AND 19 AND length(replace({d}, substring({d}, 1, 1), '')) > 0 AND {total} % 10 = 0"
    if check == "iban":
        plain = f"upper(regexp_replace({x}, '{_SPACE}', '', 'g'))"
        turned = f"(substring({plain}, 5) || substring({plain}, 1, 4))"
        step = "CASE WHEN c BETWEEN 10 AND 35 THEN (r * 100 + c) % 97 ELSE (r * 10 + c) % 97 END"
        codes = f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN unicode(c) - 55 ELSE unicode(c) - 48 END)"
        return f"regexp_full_match({plain}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce(list_prepend(0, {codes}), lambda r, c: {step}) = 1"
    if check == "ssn":
        return f"NOT regexp_matches({x}, '^(000|666|9..)') AND substring({x}, 5, 2) <> '00' AND substring({x}, 8, 4) <> '0000'"
    return "true"


def _sql_rule(i: int, source: str, key: str, column: str) -> str:
    r = sensitive.RULES[i]
    pattern = r.re2() if r.id != "us-ssn" else r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"
    pattern = pattern.replace("'", "''")
    check = _sql_check("ssn" if r.id == "us-ssn" else r.check, "raw")
    return (f"SELECT {key}, {i} AS rule_ord, k, '{r.id}' AS rule_id, '{r.label}' AS label, '{r.severity}' AS severity, raw FROM ("
            f"SELECT {key}, unnest(found) AS raw, generate_subscripts(found, 1) AS k FROM (SELECT {key}, regexp_extract_all({column}, '{pattern}') AS found FROM {source})) WHERE {check}")


def _sql_matches(source: str, key: str, column: str) -> str:
    """Rows key, ord, rule_id, label, severity, evidence of the first 50 matches in rule order."""
    every = " UNION ALL ".join(_sql_rule(i, source, key, column) for i in range(len(sensitive.RULES)))
    return (f"SELECT {key}, nth - 1 AS ord, rule_id, label, severity, {_redact('raw')} AS evidence FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rule_ord, k) AS nth FROM ({every})) WHERE nth <= {sensitive.MOST}")


def _one_rule(i: int):
    r = sensitive.RULES[i]
    built = _sql_rule(i, "built", "o_orderkey", "text")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("key"), "text")
        rows = docs.unionByName(constructed(spark, sf_dir).select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("key"), "text"))
        return rows.select("origin", "key", F.explode(sensitive.rule_matches(F.col("text"), r)).alias("raw")).select("origin", "key", text.redact(F.col("raw")).alias("evidence"))

    run.__name__ = "sensitive_" + r.id.replace("-", "_")
    sql = (f"WITH built AS ({CONSTRUCTED}) SELECT 'documents' AS origin, doc_id AS key, {_redact('raw')} AS evidence FROM ({_sql_rule(i, 'documents', 'doc_id', 'text')})"
           f" UNION ALL SELECT 'orders' AS origin, o_orderkey AS key, {_redact('raw')} AS evidence FROM ({built})")
    query(sql)(run)


#: Positives for rules that the given texts never meet, built from order keys; the same text in both dialects.
_PARTS = ("'-----BEGIN RSA PRIVATE KEY----- AKIA'", "KEY", "' AIza'", "LONG", "' ghp_'", "KEY", "KEY", "' npm_'", "KEY", "KEY", "' xoxb-'", "KEY",
          "' sk_live_'", "KEY", "' SG.'", "KEY", "'.'", "KEY", "' eyJ'", "KEY", "'.'", "KEY", "'.'", "KEY", "' Bearer '", "LONG", "' token = '", "KEY",
          "' postgres://u:p@h/'", "KEY", "' http://db.internal/'", "KEY", "' a'", "KEY", "'@example.com 123-45-'", "YEAR", "' 000-12-3456 GB82WEST12345698765432 GB00WEST'",
          "KEY", "' 4'", "KEY")


def _constructed(engine: str) -> str:
    kind = "STRING" if engine == "spark" else "VARCHAR"
    key = f"lpad(CAST(o_orderkey AS {kind}), 16, '0')"
    year = f"lpad(CAST(1000 + o_orderkey % 8000 AS {kind}), 4, '0')"
    parts = {"KEY": key, "LONG": f"lpad(CAST(o_orderkey AS {kind}), 35, '0')", "YEAR": year}
    return "concat(" + ", ".join(parts.get(p, p) for p in _PARTS) + ")"


CONSTRUCTED = f"SELECT o_orderkey, {_constructed('duckdb')} AS text FROM orders"


def constructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return orders.selectExpr("o_orderkey", f"{_constructed('spark')} AS text")


for _i in range(len(sensitive.RULES)):
    _one_rule(_i)


@query(f"SELECT doc_id, ord, rule_id, label, severity, evidence FROM ({_sql_matches('documents', 'doc_id', 'text')})")
def sensitive_all(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sensitive.matches(F.col("text"))).alias("ord", "m"))
    return m.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "m.rule_id", "m.label", "m.severity", "m.evidence")


@query(f"WITH built AS ({CONSTRUCTED}), wide AS (SELECT o_orderkey // 20 AS g, string_agg(text, ' ' ORDER BY o_orderkey) AS text FROM built GROUP BY 1)"
       f" SELECT g, ord, rule_id, severity, evidence FROM ({_sql_matches('wide', 'g', 'text')})")
def sensitive_capped(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 20).cast("bigint").alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    wide = dealt(keys, "g").selectExpr("g", f"array_join(transform(keys, o_orderkey -> {_constructed('spark')}), ' ') AS text")  # only keys are shuffled
    m = wide.select("g", F.posexplode(sensitive.matches(F.col("text"))).alias("ord", "m"))
    return m.select("g", F.col("ord").cast("bigint").alias("ord"), "m.rule_id", "m.severity", "m.evidence")


# ---- findings, reports ------------------------------------------------------------------------------------------

def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.text_findings(table(spark, sf_dir, "documents"), "doc_id", "text", F.concat(F.lit("Source "), "source"))


def constructed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.text_findings(constructed(spark, sf_dir), "o_orderkey", "text", F.lit(""))


_HIGH = "'Revoke or rotate the credential, remove the content and scan a fresh copy.'"
_LOW = "'Confirm that the value is meant for the recipient or remove it.'"


def _sql_findings(matches: str, key: str, location: str) -> str:
    rule = "'content.' || rule_id"
    return (f"SELECT CAST({key} AS VARCHAR) AS file_id, ord, {rule} AS rule_id, severity, 'high' AS confidence, label || ' found in concealed content' AS title, "
            f"'{fo.CONCEALED}' AS summary, evidence, {location} AS location, CASE WHEN severity = 'high' THEN {_HIGH} ELSE {_LOW} END AS remediation, "
            f"{rule} || '-' || {_fnv(f'''({location} || chr(0) || evidence || chr(0) || '{fo.CONCEALED}')''')} AS id FROM ({matches})")


_DOCS = f"SELECT m.*, d.source FROM ({_sql_matches('documents', 'doc_id', 'text')}) m JOIN documents d USING (doc_id)"
DOC_FINDINGS = _sql_findings(_DOCS, "doc_id", "('Source ' || source)")
BUILT_FINDINGS = _sql_findings(_sql_matches(f"({CONSTRUCTED})", "o_orderkey", "text"), "o_orderkey", "'Document'")
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, id ORDER BY ord) AS nth FROM f) WHERE nth = 1"
_WEIGHT = "CASE severity WHEN 'high' THEN 2800 WHEN 'medium' THEN 1000 WHEN 'low' THEN 300 ELSE 0 END"
_COUNTS = f"""SELECT file_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
 count(*) FILTER (severity = 'info') AS info, count(*) AS total, CAST(least(100, (sum({_WEIGHT}) + 50) // 100) AS INTEGER) AS score FROM u GROUP BY file_id"""


@query(f"SELECT file_id, ord, id, rule_id, severity, title, evidence, location, remediation FROM ({DOC_FINDINGS})")
def findings(spark, sf_dir):
    return document_findings(spark, sf_dir).select("file_id", "ord", "id", "rule_id", "severity", "title", "evidence", "location", "remediation")


@query(f"WITH f AS ({DOC_FINDINGS} UNION ALL {DOC_FINDINGS.replace('ord, ', 'ord + 1000 AS ord, ', 1)}) SELECT file_id, id, ord, rule_id, evidence FROM ({_FIRST})")
def first_wins_dedupe(spark, sf_dir):
    f = document_findings(spark, sf_dir)
    return fo.first_wins(f.unionByName(f.withColumn("ord", F.col("ord") + 1000))).select("file_id", "id", "ord", "rule_id", "evidence")


@query(f"WITH f AS ({BUILT_FINDINGS}), u AS ({_FIRST}) SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, rule_id, location, ord) AS place FROM u")
def finding_sort(spark, sf_dir):
    return fo.ordered(fo.first_wins(constructed_findings(spark, sf_dir))).select("file_id", "id", F.col("place").cast("bigint").alias("place"))


@query(f"WITH f AS ({BUILT_FINDINGS}), u AS ({_FIRST}) {_COUNTS}")
def severity_counts(spark, sf_dir):
    return fo.counted(fo.first_wins(constructed_findings(spark, sf_dir)))


_REPORT = f"""WITH f AS ({DOC_FINDINGS}), u AS ({_FIRST}), c AS ({_COUNTS}),
r AS (SELECT CAST(d.doc_id AS VARCHAR) AS file_id, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(total, 0) AS total, coalesce(score, 0) AS score,
 (d.doc_id % 5 <> 0) AS complete FROM documents d LEFT JOIN c ON c.file_id = CAST(d.doc_id AS VARCHAR))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("file_id"))
    coverage = docs.select(F.col("doc_id").cast("string").alias("file_id"), (F.col("doc_id") % 5 != 0).alias("complete"))
    return fo.reports(files, document_findings(spark, sf_dir), coverage)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure reports of all documents."""
    return document_reports(spark, sf_dir)


@query(_REPORT + """ SELECT file_id, high, medium, total, score, complete,
 CASE WHEN high > 0 THEN 'DO_NOT_SEND' WHEN NOT complete THEN 'INCOMPLETE' WHEN medium > 0 THEN 'REVIEW' ELSE 'NO_OBVIOUS_RISKS' END AS verdict_code,
 CASE WHEN high > 0 THEN high || ' high-risk finding' || CASE WHEN high = 1 THEN '' ELSE 's' END || ' need attention before this file is shared.'
  WHEN NOT complete THEN 'Part of the file could not be inspected. Treat the absence of high-risk findings as inconclusive.'
  WHEN medium > 0 THEN medium || ' finding' || CASE WHEN medium = 1 THEN '' ELSE 's' END || ' may expose information the normal document view does not make obvious.'
  ELSE 'The enabled checks did not find a clear sharing risk. This is not a guarantee that the file is safe.' END AS verdict_summary FROM r""")
def document_reports(spark, sf_dir):
    return _report(spark, sf_dir).select("file_id", "high", "medium", "total", "score", "complete", "verdict_code", "verdict_summary")


@query(_REPORT + " SELECT CAST(CASE WHEN count(*) = 0 THEN 1 WHEN bool_or(high > 0 OR medium > 0) THEN 2 WHEN bool_or(NOT complete) THEN 3 ELSE 0 END AS INTEGER) AS exit_code FROM r")
def exit_code(spark, sf_dir):
    return fo.exit_codes(_report(spark, sf_dir), "medium")


@query(f"""WITH f AS ({BUILT_FINDINGS}) SELECT rule_id, regexp_replace(rule_id, '[^A-Za-z0-9]+', '_', 'g') AS name, arg_min(title, (file_id, ord)) AS short, arg_min(summary, (file_id, ord)) AS "full",
 arg_min(remediation, (file_id, ord)) AS help, CASE arg_min(severity, (file_id, ord)) WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, 'high' AS confidence FROM f GROUP BY rule_id""")
def sarif_rules(spark, sf_dir):
    return fo.sarif_rules(constructed_findings(spark, sf_dir))


@query(f"""WITH f AS ({DOC_FINDINGS}) SELECT file_id, ord, id AS finding_id, rule_id, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
 title || ' — ' || summary || ' — Evidence: ' || evidence || ' — Location: ' || location AS message, severity, confidence FROM f""")
def sarif_results(spark, sf_dir):
    return fo.sarif_results(document_findings(spark, sf_dir))


@query("""WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS file_id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'limitation' ELSE 'check' END AS kind, o_orderpriority AS text FROM orders),
d AS (SELECT file_id, kind, text, min(seq) AS seq FROM e GROUP BY ALL)
SELECT file_id, coalesce(string_agg(text, '|' ORDER BY seq) FILTER (kind = 'check'), '') AS checks, coalesce(string_agg(text, '|' ORDER BY seq) FILTER (kind = 'limitation'), '') AS limitations,
 count(*) FILTER (kind = 'limitation') = 0 AS complete FROM d GROUP BY file_id""")
def coverage_fold(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderkey").alias("seq"),
                                              F.when(F.col("o_orderstatus") == "P", "limitation").otherwise("check").alias("kind"), F.col("o_orderpriority").alias("text"))
    c = fo.fold_coverage(e)
    return c.select("file_id", F.array_join("checks", "|").alias("checks"), F.array_join("limitations", "|").alias("limitations"), "complete")


@query("""SELECT o_custkey, string_agg(p, '; ' ORDER BY nth) FILTER (nth <= 5) AS evidence, count(*) AS n FROM
 (SELECT o_custkey, o_orderpriority || ' ' || o_orderkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) GROUP BY o_custkey""")
def top_n_evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("p"))
    values = o.groupBy("o_custkey").agg(in_order(F.lit(True), F.col("p"), F.col("o_orderkey")).alias("values"))
    return values.select("o_custkey", listed(F.col("values"), 5, "; ").alias("evidence"), F.size("values").cast("bigint").alias("n"))


# ---- XML --------------------------------------------------------------------------------------------------------

def _re2_tag(name: str) -> str:
    return xml.tag_pattern(name, r"\b").replace(text.SPACE, _SPACE[1:-2])


@query("SELECT page_id, unnest(regexp_extract_all(html, '{0}', 0)) AS raw, unnest(list_transform(regexp_extract_all(html, '{0}', 2), lambda x: coalesce(x, ''))) AS \"inner\", unnest(range(len(regexp_extract_all(html, '{0}', 0)))) AS seq FROM pages".format(_re2_tag("p").replace("'", "''")))
def xml_tags(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.posexplode(xml.tags(F.col("html"), "p")).alias("seq", "t"))
    return t.select("page_id", F.col("seq").cast("bigint").alias("seq"), "t.raw", "t.inner")


_ATTRIBUTE = r"""href[{0}]*=[{0}]*(?:"([^"]*)"|''([^'']*)'')""".format(_SPACE[1:-2])


def _sql_entities(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


@query("SELECT page_id, seq, " + _sql_entities(f"(regexp_extract(a, '{_ATTRIBUTE}', 1) || regexp_extract(a, '{_ATTRIBUTE}', 2))") + " AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '{0}', 1)) AS a, unnest(range(len(regexp_extract_all(html, '{0}', 0)))) AS seq FROM pages) WHERE regexp_matches(a, '{1}')".format(_re2_tag("a").replace("'", "''"), _ATTRIBUTE))
def xml_attributes(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.posexplode(xml.tags(F.col("html"), "a")).alias("seq", "t"))
    return t.select("page_id", F.col("seq").cast("bigint").alias("seq"), xml.attribute(F.col("t.attributes"), "href").alias("href")).where("href IS NOT NULL")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(" + _sql_entities(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<\?xml.*?\?>', '', 'g'), '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '(?i)<(?:a:)?br\s*/?>', chr(10), 'g'), '(?i)</(?:a:)?p\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
    + r", '[\t ]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), chr(10) || ' ') AS plain FROM pages")
def strip_xml(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", xml.strip_xml(F.col("html")).alias("plain"))


@query(f"SELECT doc_id, {_compact('text', 1 << 30)} AS runs FROM documents")
def text_runs(spark, sf_dir):
    split = F.regexp_replace(text.escape_html(F.col("text")), " ", "</a:t></a:r>\n<a:r><a:t xml:space='preserve'>")
    return table(spark, sf_dir, "documents").select("doc_id", xml.text_runs(F.concat(F.lit("<p:sp><a:r><a:t>"), split, F.lit("</a:t></a:r></p:sp>"))).alias("runs"))


@query("SELECT p_partkey, lower(p_brand) AS creator, p_type AS title, '' AS company FROM (SELECT p_partkey, p_brand, p_type FROM part)")
def first_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    core = F.concat(F.lit("<cp:coreProperties><dc:Creator>"), F.lower("p_brand"), F.lit("</dc:Creator><dc:title> "), "p_type", F.lit("</dc:title></cp:coreProperties>"))
    part = part.select("p_partkey", core.alias("core"))
    return part.select("p_partkey", *[xml.first_text(F.col("core"), n).alias(n) for n in ("creator", "title", "company")])


_RELS = "concat('<Relationships><Relationship Id=\"rId', {k}, '\" Type=\"http://x/', CASE WHEN {k} % 3 = 0 THEN 'hyperlink' ELSE 'image' END, '\" Target=\"', CASE {k} % 4 WHEN 0 THEN '../media/i' WHEN 1 THEN 'file:///C:/i' WHEN 2 THEN 'https://h/?a=1&amp;b=' ELSE '/ppt/./i' END, {k}, '\"', CASE WHEN {k} % 4 IN (1, 2) THEN ' TargetMode=\"External\"' ELSE '' END, '/></Relationships>')"


def relationship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_id, type, target, external and link class from relationship parts built of part keys."""
    part = spark.sql("SELECT p_partkey, " + _RELS.format(k="p_partkey") + " AS rels FROM {part}", part=table(spark, sf_dir, "part"))
    parts = part.select(F.col("p_partkey").alias("file_id"), F.lit("ppt/_rels/presentation.xml.rels").alias("name"), F.lit(0).alias("idx"), F.col("rels").alias("text"))
    return pptx_rules.relationships(parts).select(F.col("file_id").alias("p_partkey"), "rel_id", "type", "target", "external")


_REL_SQL = """SELECT p_partkey, 'rId' || p_partkey AS rel_id, 'http://x/' || CASE WHEN p_partkey % 3 = 0 THEN 'hyperlink' ELSE 'image' END AS type,
 CASE p_partkey % 4 WHEN 0 THEN '../media/i' WHEN 1 THEN 'file:///C:/i' WHEN 2 THEN 'https://h/?a=1&b=' ELSE '/ppt/./i' END || p_partkey AS target, p_partkey % 4 IN (1, 2) AS external FROM part"""


@query(_REL_SQL)
def relationships(spark, sf_dir):
    return relationship_rows(spark, sf_dir)


@query(f"SELECT rel_id, CASE WHEN regexp_matches(target, '^file:') THEN 'local-path' WHEN type LIKE '%/hyperlink' THEN 'hyperlink' ELSE 'linked-data' END AS link FROM ({_REL_SQL}) WHERE external")
def link_class(spark, sf_dir):
    return relationship_rows(spark, sf_dir).where("external").select("rel_id", xml.link_class(F.col("type"), F.col("target")).alias("link"))


@query(f"SELECT rel_id, CASE p_partkey % 4 WHEN 0 THEN 'ppt/media/i' || p_partkey ELSE 'ppt/./i' || p_partkey END AS part, 'ppt/slides/_rels/slide' || p_partkey || '.xml.rels' AS rels FROM ({_REL_SQL}) WHERE NOT external")
def resolve_part(spark, sf_dir):
    slide = F.concat(F.lit("ppt/slides/slide"), F.col("p_partkey").cast("string"), F.lit(".xml"))
    r = relationship_rows(spark, sf_dir).where("NOT external")
    return r.select("rel_id", xml.resolve_part(slide, F.col("target")).alias("part"), xml.relationships_part(slide).alias("rels"))


# ---- geometry ---------------------------------------------------------------------------------------------------

_BOX = "l_quantity * 20 - 100 AS x, l_linenumber * 150.0::DOUBLE - 200 AS y, l_tax * 4000 + 1 AS w, l_discount * 500 AS h"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 20 - 100).alias("x"), (F.col("l_linenumber") * 150.0 - 200).alias("y"),
                       (F.col("l_tax") * 4000 + 1).alias("w"), (F.col("l_discount") * 500).alias("h"))


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(w > 0 AND h > 0 AND (x + w <= 0 OR y + h <= 0 OR x >= 800 OR y >= 600), false) AS off_slide,
 x + w < 0 OR x > 612 OR y + h < 0 OR y > 792 AS off_page FROM b""")
def off_slide(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", g.off_slide(x, y, w, h, 800, 600).alias("off_slide"), g.off_page(x, x + w, y, y + h).alias("off_page"))


@query("SELECT l_orderkey, l_linenumber, (l_discount <= 0.15 AND l_tax <= 0.15 AND l_quantity / 50 <= 0.15) AS dark, (l_quantity / 50 >= 0.94 AND l_discount + 0.92 >= 0.94 AND l_tax + 0.92 >= 0.94) AS pale, (l_tax <> 0 OR l_discount <> 0) AS crop FROM lineitem")
def fills(spark, sf_dir):
    q, d, t = F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.dark_fill(d, t, q).alias("dark"), g.pale_fill(q, d + 0.92, t + 0.92).alias("pale"), g.has_crop(t, d).alias("crop"))


@query("SELECT s_suppkey, round(CASE WHEN s_nationkey % 2 = 1 THEN -1 ELSE 1 END * (s_suppkey % 90 + (s_suppkey % 60) / 60.0::DOUBLE + 30 / 3600.0::DOUBLE), 6) AS degrees FROM supplier")
def dms_to_degrees(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(g.degrees((k % 90).cast("double"), (k % 60).cast("double"), F.lit(30.0), F.when(F.col("s_nationkey") % 2 == 1, "south").otherwise("N")), 6).alias("degrees"))


_OVER = """greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + 20, b.y + b.h) - greatest(a.y, b.y)) / greatest(1, a.w * 20)"""
_TEXTS = "SELECT l_orderkey, (l_linenumber * 1000000 + l_partkey) * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq, l_returnflag AS text, l_quantity * 4 AS x, l_linenumber * 10.0::DOUBLE AS y, l_tax * 1000 + 5 AS w, CAST(l_linenumber % 4 AS INTEGER) AS render_mode FROM lineitem"
_RECTS = "SELECT l_orderkey, (l_linenumber * 1000000 + l_partkey) * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq, l_quantity * 4 - 40 AS x, l_linenumber * 10.0::DOUBLE - 5 AS y, l_discount * 2000 AS w, l_tax * 500 AS h FROM lineitem WHERE l_linenumber % 2 = 0"


@query(f"""WITH a AS ({_TEXTS}), b AS ({_RECTS}) SELECT l_orderkey, seq, text, round(arg_min(ratio, rect), 6) AS ratio FROM (SELECT a.l_orderkey, a.seq, a.text, b.seq AS rect, {_OVER} AS ratio FROM a JOIN b USING (l_orderkey) WHERE a.render_mode NOT IN (3, 7))
 WHERE ratio >= 0.55 GROUP BY ALL""")
def covered_text(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    n, x, seq = F.col("l_linenumber"), F.col("l_quantity") * 4, (F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")
    texts = line.select("l_orderkey", seq.alias("seq"), F.col("l_returnflag").alias("text"), x.alias("left"), (x + (F.col("l_tax") * 1000 + 5)).alias("right"),
                        (n * 10.0).alias("bottom"), (n * 10.0 + 20).alias("top"), (n % 4).alias("render_mode"))
    rects = line.where(n % 2 == 0).select("l_orderkey", seq.alias("seq"), (x - 40).alias("left"), (x - 40 + F.col("l_discount") * 2000).alias("right"),
                                          (n * 10.0 - 5).alias("bottom"), (n * 10.0 - 5 + F.col("l_tax") * 500).alias("top"))
    return po.covered_texts(texts, rects, ["l_orderkey"]).select("l_orderkey", "seq", "text", F.round("ratio", 6).alias("ratio"))


# ---- package relations ------------------------------------------------------------------------------------------

@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_antijoin(spark, sf_dir):
    return po.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query("""SELECT CAST(o_custkey % 50 AS VARCHAR) AS file_id, o_orderpriority AS part, string_agg(who, ', ' ORDER BY seq) AS authors FROM
 (SELECT o_custkey, o_custkey % 50 AS f, o_orderpriority, who, min(o_orderkey) AS seq FROM (SELECT o.o_custkey % 50 AS o_custkey, o_orderpriority, o_orderkey, n_name AS who FROM orders o JOIN nation ON o_custkey % 30 = n_nationkey) GROUP BY ALL) GROUP BY ALL""")
def author_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("file_id"), F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 30).cast("int").alias("author_id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("author_id"), F.col("n_name").alias("name"), F.lit("").alias("initials"))
    return po.comment_authors(o, o.select("file_id", "author_id").distinct().join(n, "author_id"))


@query("SELECT l_orderkey AS file_id, l_linenumber AS idx, name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(name) ORDER BY l_linenumber) AS nth FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END || '/x' AS name FROM lineitem)) WHERE nth > 1")
def duplicate_names(spark, sf_dir):
    n = F.col("l_linenumber")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), n.alias("idx"), F.concat(F.when(n % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")), F.lit("/x")).alias("name"))
    return po.duplicate_names(e)


_NAMES = r"CASE p_partkey % 6 WHEN 0 THEN '../a' WHEN 1 THEN '/abs' WHEN 2 THEN 'c:\x' WHEN 3 THEN 'a/..b' WHEN 4 THEN 'a\..\b' ELSE 'ppt/a' END || p_partkey"


@query(f"SELECT p_partkey, name, p_partkey % 6 IN (3, 5) AS safe, (p_size & 65) <> 0 AS encrypted FROM (SELECT p_partkey, p_size, {_NAMES} AS name FROM part)")
def unsafe_path(spark, sf_dir):
    part = spark.sql("SELECT p_partkey, p_size, " + _NAMES.replace("\\", "\\\\") + " AS name FROM {part}", part=table(spark, sf_dir, "part"))
    return part.select("p_partkey", "name", po.safe_path(F.col("name")).alias("safe"), po.encrypted(F.col("p_size")).alias("encrypted"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN packed = 0 THEN NULL ELSE round(unpacked / packed, 6) END AS ratio, packed = 0 OR unpacked / packed > 2000 AS flagged FROM (SELECT l_orderkey, l_linenumber, round(l_discount * 100) AS packed, l_extendedprice AS unpacked FROM lineitem)")
def compression_ratio(spark, sf_dir):
    r = po.compression_ratio(F.round(F.col("l_discount") * 100), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(r < float("inf"), F.round(r, 6)).alias("ratio"), (r > po.RATIO).alias("flagged"))
