"""Licence notices that are hard-wrapped over several lines."""

import textwrap

import pytest

from palimpsest.llm import op3_license


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices_are_found(spark, width):
    rows = []
    for i, (_, notice, *_) in enumerate(op3_license.TEMPLATES):
        body = "\n".join("# " + line for line in textwrap.wrap(notice, width))
        rows.append((i, "alpha beta " * 80 + "\n" + body + "\n" + "gamma delta " * 80))
    rows.append((99, "released\n" + "alpha " * 90 + "under the\n" + "beta " * 90 + "mit license"))  # the words, but far apart
    got = {r["doc_id"]: r for r in op3_license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, *_) in enumerate(op3_license.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, (i, got[i])
    assert got[99]["labels"] == "" and got[99]["score"] == 0.0


def test_notices_of_close_licenses_are_told_apart(spark):
    work, gpl = "This work is licensed under a Creative Commons Attribution", "This work is licensed under the GNU General Public License, version"
    want = {f"{work} 4.0 International License": "cc-by", f"{work}-NoDerivatives 4.0 International License": "cc-by-nd", f"{gpl} 2.": "gpl-2", f"{gpl} 3.": "gpl-3",
            f"{work}-NonCommercial 4.0 International License": "cc-by-nc", f"{work}-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa"}
    rows = [(i, t) for i, t in enumerate(want)] + [(100 + i, "alpha beta\n" + t.replace(" ", "\n") + "\ngamma delta") for i, t in enumerate(want)]
    got = {r["doc_id"]: r["labels"] for r in op3_license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k + i: label for i, label in enumerate(want.values()) for k in (0, 100)}
