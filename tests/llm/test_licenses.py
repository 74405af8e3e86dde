"""Whole license texts are found wrapped, in one line and as a list."""

import itertools
import random
import re
import textwrap
from pathlib import Path

import pytest

from lumenscreen.llm.licenses import _INNER, _RULES, _SENTENCE, RARE, RULES, SENTENCES, TEXTS, TITLES, known_as, match_rules, normal, scan, sentences


@pytest.mark.parametrize("name", TEXTS)
def test_whole_texts_are_found(name):
    lines = TEXTS[name].splitlines()
    one = " ".join(lines)
    for text in (one, textwrap.fill(one, 76), "\n\n".join(textwrap.fill(x, 60) for x in lines), "\n".join(f"{i}. {x}" for i, x in enumerate(lines))):
        text = f"Copyright (c) 2020 Someone\n\n{text}\nint main() {{ }}"
        found = match_rules(sentences(text))
        assert [x[0] for x in found] == [name]
        # All sentences belong to the span.
        assert text[found[0][1] : found[0][2]].strip().startswith(lines[0][:20]) and " ".join(text[: found[0][2]].split()).endswith(lines[-1].split()[-1])


def test_a_wrapped_mit_grant_is_enough():
    assert [x[0] for x in match_rules(sentences(textwrap.fill(TEXTS["MIT"].splitlines()[0], 70)))] == ["MIT"]


@pytest.mark.parametrize("text, names", [
    ("See file. Released under the MIT License by Foo", ["MIT"]),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */ int x;", ["GPL-2.0-or-later"]),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os", ["(MIT OR Apache-2.0)"]),
    ("This file is licensed under the Apache License,\nVersion 2.0, by all of us.", ["Apache-2.0"]),
    ("licensed under the mit licensee", []), ("the license of the software is not named", []), ("SPDX-License-Identifier:", []),
])
def test_notices_within_sentences_and_tags(text, names):
    assert [x[0] for x in match_rules(sentences(text))] == names


def test_every_license_has_a_rare_word():
    for name, wanted in RULES:
        assert re.search(RARE, " ".join(SENTENCES[w] for w in wanted)), name
    assert all(re.search(RARE, t) for t in TEXTS.values())


OFFICIAL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("file", OFFICIAL)
def test_official_texts_of_this_machine(file):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("the texts aren't installed")
    found = {x[0] for x in match_rules(sentences(path.read_text()))}
    assert OFFICIAL[file] in found and not {n for n in OFFICIAL.values() if n != OFFICIAL[file]} & found


def test_scan_of_nulls_repeated_rows_and_long_texts(spark):
    notice = "Released under the MIT License."
    rows = [(1, None, 0), (2, "", 0), (3, notice, 0), (3, notice, 0), (None, notice, 0), (4, "plain words " * 100_000 + notice, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((str(r.doc_id), r.licenses, r.n_spans) for r in scan(df).collect())
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "MIT", 1), ("3", "MIT", 1), ("None", "MIT", 1), ("4", "MIT", 1)])
    assert scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, names", [
    ("MIT License\n\nCopyright (c) 2020 A", ["MIT"]), ("x\nLicense: MIT\ny", ["MIT"]), ("Apache License\nVersion 2.0, January 2004\nhttp", ["Apache-2.0"]), ("The MIT License is one of many", []),
    ("Dual licensed under the MIT and Apache-2.0 licenses", ["MIT OR Apache-2.0"]), ("dual-licensed under MIT/GPLv3.", ["MIT OR GPL-3.0"]), ("dual licensed under MIT and friends", []),
    ("// SPDX-License-Identifier: MIT/Apache-2.0\n", ["MIT OR Apache-2.0"]), ("SPDX-License-Identifier: MIT ??? x", []), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 -->", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("License: see below", []), ("# license : Apache 2.0.", ["Apache-2.0"]),
])
def test_titles_lines_and_dual_notices(text, names):
    assert [x[0] for x in match_rules(sentences(text))] == names


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"])
def test_texts_with_named_holders(name):
    text = TEXTS[name].replace("the copyright holder nor", "Google Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
    text = text.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME LTD").replace("AND THE AUTHOR DISCLAIMS", "AND JANE DOE DISCLAIMS").replace("SHALL THE AUTHOR BE", "SHALL JANE DOE BE")
    for shape in (text, textwrap.fill(text, 72)):
        assert [x[0] for x in match_rules(sentences(f"Copyright (c) 2019, Google Inc.\n\n{shape}\nint x;"))] == [name]
    other = " ".join(text.split()).replace("as is", "as such").replace("AS IS", "AS SUCH")
    assert name not in {x[0] for x in match_rules(sentences(other.replace("hereby granted", "never granted")))} or name == "MIT"


def slow_matches(text):
    """All windows of cuts against all sentences, then all rules at every place, the longest first."""
    cuts = [(m.start(), m.end(), normal(m.group())) for m in _SENTENCE.finditer(text)]
    cuts = [c for c in cuts if c[2]]
    found, i = [], 0
    while i < len(cuts):
        windows = [(j, " ".join(c[2] for c in cuts[i:j])) for j in range(i + 1, len(cuts) + 1)]
        hits = [(j, known_as(w)) for j, w in windows if known_as(w)]
        if not hits:
            inner = [(j, m) for j, w in windows[:2] if (m := _INNER.search(w)) and m.start() < len(cuts[i][2])]
            hits = [(i + 1 if inner[-1][1].end() <= len(cuts[i][2]) else i + 2, known_as(inner[-1][1].group()))] if inner else []
        j, name = hits[-1] if hits else (i + 1, None)
        found.append((name, cuts[i][0], cuts[j - 1][1]))
        i = j
    out, i = [], 0
    while i < len(found):
        ends = []
        for order, (name, wanted) in enumerate(_RULES):
            for skips in itertools.product(range(2), repeat=len(wanted) - 1):
                at, good = i, found[i][0] == wanted[0]
                for skip, w in zip(skips, wanted[1:], strict=True):
                    gap = found[at + 1 : at + 1 + skip]
                    at += 1 + skip
                    good = good and at < len(found) and found[at][0] == w and all(g[0] is None for g in gap)
                if good:
                    ends.append((-len(wanted), order, name, at))
                if not good and len(wanted) > 6:
                    break
        if ends:
            _, _, name, at = min(ends)
            out.append((name, found[i][1], found[at][2]))
            i = at
        i += 1
    return out


def test_random_documents_against_all_windows():
    draw = random.Random(11)
    pool = [*SENTENCES.values(), *(t for titles in TITLES.values() for t in titles), *(line for n in ("BSD-2-Clause", "ISC") for line in TEXTS[n].splitlines())]
    noise = ["int x = 3", "Copyright (c) 2020 A", "the quick brown fox", "this file", "software"]
    some = 0
    for _ in range(250):
        parts = [draw.choice(pool if draw.random() < 0.7 else noise) for _ in range(draw.randrange(1, 9))]
        text = "".join(p + draw.choice([". ", "\n", ".\n", " ", "; ", "\n\n"]) for p in parts)
        got = match_rules(sentences(text))
        assert got == slow_matches(text), text
        some += len(got)
    assert some > 300
