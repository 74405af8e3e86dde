"""Templates recur in documents, wherever their lines stand in them."""

import pytest

from lumenscreen.llm import line_templates

NAMES = "abcdefghijkl"
BLOCK = ["we use cookies on this site", "read the terms of use", "all content belongs to its owners", "contact the editors by mail"]
#: Where the repeated lines stand: a document around them, and which lines they are.
SHAPES = {
    "blank-framed": ("own {0} text\n\n{1}\n\nmore {0} words", BLOCK[:1]),
    "header": ("{1}\nown {0} text\nmore {0} words", BLOCK[:2]),
    "footer": ("own {0} text\nmore {0} words\n{1}", BLOCK[:2]),
    "block": ("own {0} text\n{1}\nmore {0} words", BLOCK),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_repeated_lines_go_wherever_they_stand(spark, shape):
    form, repeated = SHAPES[shape]
    rows = [(i, form.format(c, "\n".join(repeated))) for i, c in enumerate(NAMES)]
    got = {r.doc_id: r.text for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = lambda text: "\n".join(x for x in text.split("\n") if x not in repeated)
    assert got == {i: kept(t) if i else t for i, t in rows}


def test_copies_count_once_and_so_do_lines_of_one_document(spark):
    copy = "\n\n".join(["own start", *BLOCK])
    rows = [(i, copy.replace("\n\n", "\n" * (1 + i % 3))) for i in range(20)] + [(30, "\n".join(f"{c} before\nrepeated within one text\n{c} after" for c in NAMES))]
    got = line_templates.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.n_dropped for r in got} == {0}
    short = [(i, f"own {c}\nthe shared line") for i, c in enumerate(NAMES[:7])]
    assert line_templates.drop_lines(spark.createDataFrame(short, "doc_id long, text string")).where("text NOT LIKE '%shared%'").count() == 0


def test_templates_of_different_lines_between_blank_lines(spark):
    rows = [(i, f"own {c} text\n\nHere was posted by {c}{c} an answer\n\n{c} more") for i, c in enumerate(NAMES)]
    got = {r.doc_id: r.text for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ["posted" in got[i] for i in range(12)] == [True] + [False] * 11 and all(f"own {c} text" in got[i] for i, c in enumerate(NAMES))
