"""From matches and evidence rows to findings, and from findings to counts, scores and verdicts.

A finding belongs to a file (``file_id``) and carries ``ord``, its place in the order of emission: of findings with
one id the first stays, and sorting is stable by it. All folds group by file_id and combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sensitive
from ..functions.text import finding_id

#: Ranks and weights; a weight is severity times confidence in hundredths.
SEVERITIES = ("high", "medium", "low", "info")
SEVERITY_WEIGHT = {"high": 28, "medium": 10, "low": 3, "info": 0}
CONFIDENCE_PERCENT = {"high": 100, "medium": 78, "low": 50}

SCHEMA = ("file_id string, ord bigint, id string, rule_id string, severity string, confidence string, title string, summary string, "
          "evidence string, location string, remediation string, tags array<string>, data string")


def rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, i)
    return out


def identified(rows: DataFrame) -> DataFrame:
    """Adds id; empty evidence becomes null, an empty location the whole document, tags distinct and sorted."""
    return rows.withColumn("id", finding_id(F.col("rule_id"), F.col("location"), F.col("evidence"), F.col("summary"))).withColumns({
        "location": F.when(F.coalesce("location", F.lit("")) == "", "Document").otherwise(F.col("location")),
        "evidence": F.when(F.col("evidence") != "", F.col("evidence")),
        "tags": F.array_sort(F.array_distinct("tags"))})


SEVERE = "Revoke or rotate the credential, remove the content and scan a fresh copy."
MILD = "Confirm that the value is meant for the recipient or remove it."
CONCEALED = "A private or credential-like value appears in concealed content."


def sensitive_findings(texts: DataFrame, text: str, summary: Column, remediation: Column) -> DataFrame:
    """A finding for each sensitive value in the text, at most ``sensitive.MOST`` a text; texts have file_id, base (the first ``ord``), location.

    A null ``remediation`` stands for the advice of the value's severity.
    """
    m = texts.select("file_id", "base", "location", summary.alias("said"), remediation.alias("advice"), F.posexplode(sensitive.matches(F.col(text))).alias("k", "m"))
    return identified(m.select(
        "file_id", (F.col("base") + F.col("k")).cast("bigint").alias("ord"), F.concat(F.lit("content."), "m.rule_id").alias("rule_id"),
        F.col("m.severity").alias("severity"), F.lit("high").alias("confidence"), F.concat("m.label", F.lit(" found in concealed content")).alias("title"),
        F.col("said").alias("summary"), F.col("m.evidence").alias("evidence"), "location", F.coalesce("advice", F.when(F.col("m.severity") == "high", SEVERE).otherwise(MILD)).alias("remediation"),
        F.array(F.lit("sensitive-content"), F.lit("hidden-content")).alias("tags"), F.lit(None).cast("string").alias("data")))


def text_findings(texts: DataFrame, file_id: str, text: str, location: Column) -> DataFrame:
    """The findings of a table of concealed texts."""
    rows = texts.select(F.col(file_id).cast("string").alias("file_id"), F.lit(0).alias("base"), location.alias("location"), F.col(text).alias("text"))
    return sensitive_findings(rows, "text", F.lit(CONCEALED), F.lit(None).cast("string"))


def first_wins(findings: DataFrame) -> DataFrame:
    """Of the findings of a file with one id, the first emitted."""
    w = Window.partitionBy("file_id", "id").orderBy("ord")
    nth = findings.repartition("file_id").withColumn("nth", F.row_number().over(w))  # what follows goes by file_id: no other shuffle
    return nth.where("nth = 1").select("file_id", "id", *[c for c in findings.columns if c not in ("file_id", "id")])


def ordered(findings: DataFrame) -> DataFrame:
    """Adds ``place``: by severity, rule, location (Unicode order), then order of emission."""
    w = Window.partitionBy("file_id").orderBy(rank(F.col("severity")), F.collate("rule_id", "UNICODE"), F.collate("location", "UNICODE"), "ord")
    return findings.withColumn("place", F.row_number().over(w))


def weight() -> Column:
    value = F.lit(0)
    for s, a in SEVERITY_WEIGHT.items():
        for c, b in CONFIDENCE_PERCENT.items():
            value = F.when((F.col("severity") == s) & (F.col("confidence") == c), a * b).otherwise(value)
    return value


def counted(findings: DataFrame) -> DataFrame:
    """file_id, high, medium, low, info, total, score."""
    score = F.least(F.lit(100), F.floor((F.sum(weight()) + 50) / 100)).cast("int")
    return findings.groupBy("file_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"), score.alias("score"))


def verdict(high: Column, medium: Column, complete: Column) -> dict[str, Column]:
    """code, title and summary; low and info findings never decide, and what is incomplete is never cleared."""
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    cases = [  # fixed values
        (high > 0, "DO_NOT_SEND", "Do not send yet", F.concat(high.cast("string"), F.lit(" high-risk finding"), plural(high), F.lit(" need attention before this file is shared."))),
        (~complete, "INCOMPLETE", "Scan incomplete", F.lit("Part of the file could not be inspected. Treat the absence of high-risk findings as inconclusive.")),
        (medium > 0, "REVIEW", "Review before sending", F.concat(medium.cast("string"), F.lit(" finding"), plural(medium), F.lit(" may expose information the normal document view does not make obvious."))),
        (F.lit(True), "NO_OBVIOUS_RISKS", "No obvious hidden content found", F.lit("The enabled checks did not find a clear sharing risk. This is not a guarantee that the file is safe.")),
    ]
    out = {}
    for i, name in enumerate(("code", "title", "summary"), 1):
        value = None
        for case in cases:
            then = F.lit(case[i]) if isinstance(case[i], str) else case[i]
            value = F.when(case[0], then) if value is None else value.when(case[0], then)
        out[name] = value
    return out


def reports(files: DataFrame, findings: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One row for each file: counts, score, verdict. ``coverage`` has file_id and complete; without it all is complete."""
    counts = counted(first_wins(findings))
    out = files.join(counts, "file_id", "left").fillna(0, [*SEVERITIES, "total", "score"])
    out = out.join(coverage, "file_id", "left") if coverage is not None else out.withColumn("complete", F.lit(True))
    out = out.withColumn("complete", F.coalesce("complete", F.lit(False)))
    v = verdict(F.col("high"), F.col("medium"), F.col("complete"))
    return out.withColumns({f"verdict_{k}": c for k, c in v.items()})


def exit_codes(reports_: DataFrame, fail_on: str = "high") -> DataFrame:
    """One row: 2 if a finding reaches the threshold, else 3 if a report is incomplete, else 0 (no rows: 1)."""
    reached = [s for i, s in enumerate(SEVERITIES) if fail_on != "never" and i <= SEVERITIES.index(fail_on)]
    met = F.lit(False)
    for s in reached:
        met = met | (F.col(s) > 0)
    return reports_.agg(F.count("*").alias("n"), F.bool_or(met).alias("met"), F.bool_or(~F.col("complete")).alias("open")).select(
        F.when(F.col("n") == 0, 1).when(F.col("met"), 2).when(F.col("open"), 3).otherwise(0).alias("exit_code"))


LEVEL = {"high": "error", "medium": "warning", "low": "note", "info": "note"}


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "high", "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    evidence = F.when(F.col("evidence").isNotNull(), F.concat(F.lit("Evidence: "), "evidence"))
    location = F.when(F.col("location") != "", F.concat(F.lit("Location: "), "location"))
    return findings.select("file_id", "ord", F.col("id").alias("finding_id"), "rule_id", sarif_level(F.col("severity")).alias("level"),
                           F.concat_ws(" — ", "title", "summary", evidence, location).alias("message"), "severity", "confidence")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """For each rule what its first finding says (by file, then order)."""
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("title", "summary", "remediation", "severity", "confidence"), F.struct("file_id", "ord")).alias("f"))
    return first.select("rule_id", F.regexp_replace("rule_id", "[^A-Za-z0-9]+", "_").alias("name"), F.col("f.title").alias("short"), F.col("f.summary").alias("full"),
                        F.coalesce("f.remediation", "f.summary").alias("help"), sarif_level(F.col("f.severity")).alias("level"), F.col("f.confidence").alias("confidence"))


def fold_coverage(events: DataFrame) -> DataFrame:
    """(file_id, seq, kind check|limitation, text) as distinct ordered lists; complete where nothing limits."""
    def texts(kind: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "text"))))
        return F.array_distinct(F.transform(mine, lambda e: e["text"]))

    return events.groupBy("file_id").agg(texts("check").alias("checks"), texts("limitation").alias("limitations")).withColumn(
        "complete", F.size("limitations") == 0)
