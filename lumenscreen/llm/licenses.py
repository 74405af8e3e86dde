"""License scans by sentence rules (operator 8).

A text is cut into sentences, each is normalised (lower case, letters, digits and dots of versions only) and looked up
among known license sentences. The identifiers that are found, in order, are matched against rules: a rule is an
ordered list of identifiers, and it holds where they stand in this order, with at most ``gap`` unknown sentences
between neighbours. The longest rule wins at each place. Short notices are also known within a longer sentence; titles
are sentences of their own line. A sentence that names its holder is known by what stands around the name. Tags with an
SPDX expression, "License: name" lines and dual-license notices name their licenses themselves: they are sentences
whose identifier is the expression. Of the long licenses one sentence of each text is known.

Defined cases: null and empty texts have no license; repeated sentences give repeated spans; rows that repeat a doc_id
each get their result; spans are code points of the text, end exclusive; a text of any length is read whole; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Sentences of public license texts and notices, by identifier.
SENTENCES = {
    "all-rights": "All rights reserved",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-notice": "Licensed under the BSD 3-Clause License",
    "bsd-released": "Released under the BSD License",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-notice": "This library is licensed under the GNU Lesser General Public License, version 3",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "agpl3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "apache-text": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "gpl2-text": "To protect your rights, we need to make restrictions that forbid anyone to deny you these rights or to ask you to surrender the rights",
    "gpl3-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "lgpl21-text": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it",
    "lgpl3-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "mpl-text": "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: License, and the sentences that show it, in order.
RULES = [
    ("Apache-2.0", ("apache-notice",)), ("Apache-2.0", ("apache-notice-the", "apache-use", "apache-copy")), ("Apache-2.0", ("apache-notice-the",)),
    ("BSD-3-Clause", ("bsd-notice",)), ("BSD", ("bsd-released",)), ("BSD", ("bsd-redistribution",)),
    ("CC-BY-4.0", ("cc-by",)), ("CC-BY-4.0", ("cc-by-long",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("GPL-2.0-or-later", ("gpl2-program", "gpl-hope")), ("GPL-2.0-or-later", ("gpl2-program",)),
    ("GPL-3.0", ("gpl3-notice",)), ("GPL-3.0-or-later", ("gpl3-program", "gpl-hope")), ("GPL-3.0-or-later", ("gpl3-program",)),
    ("LGPL-3.0", ("lgpl-notice",)), ("MIT", ("mit-grant", "mit-notice", "mit-warranty")), ("MIT", ("mit-grant",)), ("MIT", ("mit-licensed",)), ("MIT", ("mit-released",)),
    ("MPL-2.0", ("mpl-notice",)), ("Unlicense", ("unlicense",)), ("all-rights-reserved", ("all-rights",)),
    ("AGPL-3.0", ("agpl3-text",)), ("Apache-2.0", ("apache-text",)), ("GPL-2.0", ("gpl2-text",)), ("GPL-3.0", ("gpl3-text",)), ("LGPL-2.1", ("lgpl21-text",)), ("LGPL-3.0", ("lgpl3-text",)), ("MPL-2.0", ("mpl-text",)),
]
#: Titles of public licenses, each alone in its line, by license.
TITLES = {
    "AGPL-3.0": ("GNU Affero General Public License, Version 3", "GNU Affero General Public License Version 3, 19 November 2007"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "GPL-2.0": ("GNU General Public License, Version 2", "GNU General Public License Version 2, June 1991"),
    "GPL-3.0": ("GNU General Public License, Version 3", "GNU General Public License Version 3, 29 June 2007"),
    "ISC": ("ISC License", "The ISC License"),
    "LGPL-2.1": ("GNU Lesser General Public License, Version 2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    "LGPL-3.0": ("GNU Lesser General Public License, Version 3", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License Version 2.0"),
    "Unlicense": ("The Unlicense",),
}
#: How license names are written in notices, and their SPDX identifiers.
NAMES = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "Apache 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "BSD 2-Clause": "BSD-2-Clause", "BSD 3-Clause": "BSD-3-Clause",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0-only", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPLv2": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0-only", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPLv3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "AGPL-3.0": "AGPL-3.0",
    "MPL-2.0": "MPL-2.0", "ISC": "ISC", "0BSD": "0BSD", "Zlib": "Zlib", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0",
}
#: Notices that count within a longer sentence, too.
INNER = ("apache-notice", "bsd-notice", "bsd-released", "cc-by", "cc-by-sa", "cc-by-nc", "mit-released", "mit-licensed", "mpl-notice", "unlicense")
#: Every license has a sentence with one of these; texts without any aren't cut into sentences.
RARE = r"(?i)licen[cs]|rights|warrant|software|redistribut"
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
#: Whole sentences of public licenses (of the long ones, their notices), a line each; all must follow.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_ENDORSE + _BSD_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty.
In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution.
""",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.\n",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.\n",
}
#: A sentence ends at a line end, or at a mark that stands before a space or the text's end (not within "2.0" or a url).
_SENTENCE = re.compile(r"[^\n]+?(?:[.;:!?]+(?=\s|$)|(?=\n)|$)", re.MULTILINE)
_PART = re.compile(r"[a-z0-9]+")


def normal(sentence: str) -> str:
    return " ".join(_PART.findall(sentence.lower()))


def _known() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifiers by normal form, and the rules: a known sentence with inner marks is known by its parts' joint form."""
    known, rules = {normal(s): name for name, s in SENTENCES.items()}, list(RULES)
    for license_, text in TEXTS.items():
        wanted = tuple(known.setdefault(normal(s), f"{license_}-{i}") for i, s in enumerate(text.splitlines()))
        rules.append((license_, wanted))
    for license_, titles in TITLES.items():
        for i, title in enumerate(titles):
            rules.append((license_, (known.setdefault(normal(title), f"title-{license_}-{i}"),)))
    # The whole first sentence of MIT shows it as its first part does.
    rules.append(("MIT", (known[normal(TEXTS["MIT"].splitlines()[0])],)))
    return known, sorted(rules, key=lambda r: -len(r[1]))


_BY_NORMAL, _RULES = _known()
_INNER = re.compile("(?<![a-z0-9])(?:" + "|".join(normal(SENTENCES[n]) for n in sorted(INNER, key=lambda n: -len(SENTENCES[n]))) + ")(?![a-z0-9])")
_ID = r"\(?[A-Za-z0-9.+-]*[A-Za-z0-9.+]\)?"
#: A tag counts only if all of its line can be read: identifiers with OR, AND, WITH or a slash between, then a comment's end at most.
_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:(?:[ \t]+(?:OR|AND|WITH)[ \t]+|[ \t]*/[ \t]*){_ID})*)(?=[ \t]*(?:\*/|-->|#\}}|[\"'`;,]|$|\n|\r))", re.MULTILINE)
_NAME = "(?:" + "|".join(re.escape(n).replace(r"\ ", r"[ \t]+") for n in sorted(NAMES, key=lambda n: -len(n))) + ")"
_LINE = re.compile(rf"^[^\w\n]*licen[cs]e[ \t]*:[ \t]*({_NAME})(?:[ \t]+licen[cs]e)?[ \t]*[.;,]?[ \t]*$", re.IGNORECASE | re.MULTILINE)
_DUAL = re.compile(rf"\bdual[ \t-]+licen[cs]ed[ \t]+under[ \t]+(?:both[ \t]+)?(?:the[ \t]+)?({_NAME})(?:[ \t]+licen[cs]e)?[ \t]*(?:and/or|and|or|/|&)[ \t]*(?:the[ \t]+)?({_NAME})(?![\w-])", re.IGNORECASE)
_SPDX = {re.sub(r"\s+", " ", n).lower(): i for n, i in NAMES.items()}
#: A holder's name of up to 16 words, where a license's own text says who holds or gives it.
_HOLDER = r"(?:[a-z0-9]+ ){1,16}?"


def _with_holders() -> list[tuple[re.Pattern, str]]:
    """Patterns of known sentences in which the holder's name may be another."""
    out = []
    for holder in ("the copyright holder nor", "the copyright holders and contributors as", "the copyright holder or contributors be", "the authors or copyright holders be", "the author disclaims", "the author be"):
        *name, after = holder.split()
        for s, identifier in _BY_NORMAL.items():
            if (place := f" {holder} ") in s:
                low, high = s.split(place, 1)
                out.append((re.compile(f"{low} {_HOLDER}{after} {high}"), identifier))
    return out


_HELD = _with_holders()


def known_as(sentence: str) -> str | None:
    """The identifier of a normal form."""
    if sentence in _BY_NORMAL:
        return _BY_NORMAL[sentence]
    if sentence.startswith(_HELD_LEADS):
        return next((i for pattern, i in _HELD if pattern.fullmatch(sentence)), None)
    return None


_LEADS = {s.split()[0] + " " + s.split()[1] for s in _BY_NORMAL}
_HELD_LEADS = tuple({" ".join(p.pattern.split()[:3]) for p, _ in _HELD})
_MOST_WORDS = max(len(s.split()) for s in _BY_NORMAL) + 16


def sentences(text: str) -> list[tuple[str | None, int, int]]:
    """(identifier or None, start, end) of all sentences; a known sentence that marks cut up is put together again.

    What names its licenses itself is a sentence of its own, known as "spdx:" and its expression.
    """
    out, at = [], 0
    for start, end, expression in self_named(text):
        if start >= at:
            out += _between(text, at, start)
            out.append((f"spdx:{expression}", start, end))
            at = end
    return out + _between(text, at, len(text))


def self_named(text: str) -> list[tuple[int, int, str]]:
    """(start, end, SPDX expression) of tags, "License: name" lines and dual-license notices."""
    spdx = lambda name: _SPDX[re.sub(r"\s+", " ", name).lower()]
    found = [(m.start(), m.end(), " ".join(re.sub(r"[ \t]*/[ \t]*", " OR ", m[1]).split())) for m in _TAG.finditer(text)]
    found += [(m.start(), m.end(), spdx(m[1])) for m in _LINE.finditer(text)]
    found += [(m.start(), m.end(), f"{spdx(m[1])} OR {spdx(m[2])}") for m in _DUAL.finditer(text)]
    return sorted(found)


def _between(text: str, low: int, high: int) -> list[tuple[str | None, int, int]]:
    cuts = [(m.start(), m.end(), normal(m.group())) for m in _SENTENCE.finditer(text, low, high)]
    cuts = [c for c in cuts if c[2]]
    out, i = [], 0
    while i < len(cuts):
        joined, taken = cuts[i][2], 0
        if " ".join(joined.split()[:2]) in _LEADS or len(joined.split()) < 2:
            j = i
            while True:
                if identifier := known_as(joined):
                    taken, name = j - i + 1, identifier
                j += 1
                if j >= len(cuts) or len(joined.split()) > _MOST_WORDS:
                    break
                joined += " " + cuts[j][2]
        if taken:
            out.append((name, cuts[i][0], cuts[i + taken - 1][1]))
        else:
            # Up to two cuts together, as a mark or a line end may stand within a notice.
            pair = cuts[i][2] + (" " + cuts[i + 1][2] if i + 1 < len(cuts) else "")
            inner = _INNER.search(pair)
            if inner and inner.start() < len(cuts[i][2]):
                taken = 1 if inner.end() <= len(cuts[i][2]) else 2
                out.append((_BY_NORMAL[inner.group()], cuts[i][0], cuts[i + taken - 1][1]))
            else:
                out.append((None, cuts[i][0], cuts[i][1]))
        i += max(taken, 1)
    return out


def match_rules(found: list[tuple[str | None, int, int]], gap: int = 1) -> list[tuple[str, int, int]]:
    """(license, start, end): at each place the longest rule whose identifiers follow."""
    out, i = [], 0
    while i < len(found):
        step = 1
        if (found[i][0] or "").startswith("spdx:"):
            out.append((found[i][0][5:], found[i][1], found[i][2]))
        for name, wanted in _RULES:
            at, k = i, 0
            while k < len(wanted) and at < len(found):
                skipped = 0
                while k and at < len(found) and found[at][0] is None and skipped < gap:
                    at, skipped = at + 1, skipped + 1
                if at >= len(found) or found[at][0] != wanted[k]:
                    break
                at, k = at + 1, k + 1
            if k == len(wanted):
                out.append((name, found[i][1], found[at - 1][2]))
                step = at - i
                break
        i += step
    return out


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leads = re.compile("(?<![a-z0-9])(?:" + "|".join(sorted({x.replace(" ", "[^a-z0-9]+") for x in _LEADS})) + ")|" + "|".join(sorted({SENTENCES[n].split()[0] + " " + SENTENCES[n].split()[1] for n in INNER})) + "|SPDX-|licen[cs]e[ \t]*:|dual[ \t-]+licen", re.IGNORECASE)
    for batch in batches:
        names, spans, counts = [], [], []
        for text in batch.column(1).to_pylist():
            hits = match_rules(sentences(text)) if text and leads.search(text) else []
            names.append(",".join(sorted({h[0] for h in hits})))
            spans.append(",".join(f"{n}:{s}:{e}" for n, s, e in hits))
            counts.append(len(hits))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(spans, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "licenses", "spans", "n_spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted names), spans (license:start:end), n_spans of every document."""
    small_batches(docs.sparkSession)
    text = F.when(F.col("text").rlike(RARE), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_scanner, "doc_id long, licenses string, spans string, n_spans long")
