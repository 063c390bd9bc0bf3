"""Licence notices within longer lines and across paragraphs."""

from __future__ import annotations

from stallmark.llm import licenses

PROSE = "the river and the stone walk under a bright sky"


def test_notices_inside_longer_texts(spark, none):
    mit = licenses.TEMPLATES["MIT-text"].replace(": The above", ":\n\nThe above").replace("Software. THE", "Software.\n\nTHE")
    header = "\n".join(f"# {x}" for x in licenses.TEMPLATES["Apache-2.0-header"].replace("Unless", "\n\nUnless").split("\n"))
    varied = "\n".join(f"stone{i} and river{i} walk{i}" for i in range(200))
    cases = [
        ("Copyright 2024 Example Inc. All rights reserved.", "All-rights-reserved", 1),
        ("Licensed under CC BY 4.0. See the project page.", "CC-BY-4.0", 1),
        ("This library is released under the MIT License.", "MIT", 1),
        (f"Copyright 2024 Example\n\n{mit}\n\n{varied}", "MIT-text", 1),
        (f"{varied}\n{header}\n{varied}", "Apache-2.0-header", 1),
        (f"All rights reserved.\n{PROSE} released under the MIT License {PROSE}", "All-rights-reserved,MIT", 2),
        (f"{PROSE} under the license of all {PROSE}", "", 0),
        ("all rights\nAll rights reserved.\nreserved", "All-rights-reserved", 1),
        (None, "", 0), ("", "", 0)]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, inside=True).collect()}
    for i, (text, names, units) in enumerate(cases):
        assert (got[i].licenses, got[i].units) == (names, units), (text, got[i])
        assert got[i].dice == (1.0 if names else 0.0), (text, got[i])
    assert licenses.scan(none, inside=True).collect() == []
