"""Notices as license files and headers wrap them."""

import textwrap

import pytest

from urlmill.llm import licenses

MARKS = {"plain": "", "hash": "# ", "star": " * ", "slashes": "// "}


def _wrapped(template, width, mark, between="\n"):
    before, after = "Copyright holders and others 2024\nAll rights reserved", "No warranty is given\nSee below"
    return between.join([mark + x for x in before.split("\n") + textwrap.wrap(template.capitalize() + ".", width - len(mark)) + after.split("\n")])


@pytest.mark.parametrize("mark", sorted(MARKS))
def test_wrapped_notices_are_found(spark, mark):
    rows, want = [], {}
    for label, template in licenses.TEMPLATES:
        for width in (30, 50, 72):
            for between in ("\n", "\r\n", "\n\n"):
                want[len(rows)] = label
                rows.append((len(rows), _wrapped(template, width, MARKS[mark], between)))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i][0].split(",") and got[i][1] == 1.0 for i, label in want.items())


def test_scattered_words_are_no_notice(spark):
    template = licenses.TEMPLATES[1][1].split()
    rows = [(1, "\n".join(f"{w} some other words" for w in template)), (2, " ".join(template[:10]) + "\nfiller" * 30 + "\n" + " ".join(template[10:])), (3, None), (4, "")]
    assert all((r.labels, r.score) == ("", 0.0) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_of_similar_notices_the_closest_is_named(spark):
    kinds = [label for label, t in licenses.TEMPLATES if t.startswith("licensed under cc ")]
    rows = [(i, f"Some text.\nLicensed under {k.upper().replace('-', ' ', 1)} 4.0.\nMore text.") for i, k in enumerate(kinds)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(kinds)) and len(kinds) == 6


def test_copies_of_a_notice(spark):
    notice = "This work is released under the MIT license"
    rows = [(i, notice) for i in range(2000)] + [(i, None) for i in range(2000, 3000)] + [(i, f"other text {i}") for i in range(3000, 3100)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3100 and all((r.labels == "mit") == (r.doc_id < 2000) for r in got)
