import hashlib

import pytest

from sparkloom.llm import licenses, recipes


def test_exact_dedup(documents, prose):
    long = prose(3000)
    rows = [(k, prose(prose.rng.randint(0, 3))[:6]) for k in range(200)] + [(300, long), (301, long), (302, long + " x"), (303, None), (304, ""), (305, "A\nb"), (306, "a\nb"), (307, "é"), (7, "again"), (300, long), (None, long)]
    found = recipes.exact_dedup(documents(rows)).collect()
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    expected = []
    for k, t in rows:
        own = groups[t or ""]
        keep = max(x for x in own if x is not None)
        expected.append((k, keep, len(own), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found))) == sorted(map(str, expected))


def test_chunks_join_to_the_text_and_survive_edits(documents, prose):
    text = "\n".join(prose(40) for _ in range(60))
    docs = documents([(1, text), (2, "one more line at the start\n" + text), (3, ""), (4, "x" * 5000)])
    found = {r.doc_id: r.c for r in docs.select("doc_id", recipes.chunks(docs.text).alias("c")).collect()}
    assert "".join(found[1]) == text and "".join(found[4]) == "x" * 5000 and found[3] == []
    assert max(map(len, found[4])) <= 1024
    assert len(set(found[1]) & set(found[2])) > 0.9 * len(found[1])


def test_a_shared_identifier_does_not_join_texts(documents, monkeypatch):
    monkeypatch.setattr(recipes.F, "xxhash64", lambda *c: recipes.F.lit(1).cast("long"))
    found = recipes.exact_dedup(documents([(1, "abc"), (2, "abd"), (3, "abc")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in found) == [(1, 3), (2, 2), (3, 3)]


def test_empty_tables(documents):
    assert recipes.exact_dedup(documents([])).count() == 0 and licenses.license_scan(documents([])).count() == 0


def test_no_python_in_the_plans(documents):
    docs = documents([(1, "a")])
    for frame in (recipes.recipes(docs), recipes.ambiguous_ids(docs), licenses.license_scan(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_licenses(documents):
    s = licenses.SENTENCES
    mit = ". ".join(s[x] for x in ("mit-grant", "mit-keep", "mit-warranty", "mit-liability"))
    wrapped = mit.upper().replace(" THE ", "\nTHE ")
    rows = [
        (1, "text.\nReleased under the MIT License.\nmore"), (2, mit), (3, "x\n" + mit.replace(" the ", "  THE\t") + ". y"), (4, ". ".join(reversed(mit.split(". ")))), (5, None), (6, ""),
        (7, "All rights reserved. Licensed under the Apache License, Version 2.0."), (8, "We released under the MIT license a thing."), (9, s["mit-grant"] + ".\nsomething between.\n" + mit[len(s["mit-grant"]) + 2 :]), (10, wrapped), (None, "SPDX-License-Identifier: MIT"),
    ]
    found = {r.doc_id: r for r in licenses.license_scan(documents(rows)).collect()}
    assert [found[k].licenses for k, _ in rows] == ["MIT", "MIT", "MIT", "", "", "", "All-Rights-Reserved,Apache-2.0", "MIT", "MIT", "MIT", "MIT"]
    assert found[4].n_sentences == 4 and found[7].sentence_ids == "reserved,apache-notice"


MIT = """The MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{0}1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{0}2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{1}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NAMES = """{}3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_standard_texts_as_they_are_wrapped(documents):
    comma = GPL.replace("Foundation;", "Foundation,")
    texts = [MIT, comma.format(":", 3), comma.format(";", 2), GPL.format(";", 2), BSD.format("", ""), BSD.format("\n", ""), BSD.format("", NAMES.format("")), BSD.format("\n", NAMES.format("\n")), APACHE]
    bullets = BSD.format("", "").replace("1. ", "* ").replace("2. ", "* ")
    found = {r.doc_id: r.licenses for r in licenses.license_scan(documents(list(enumerate([*texts, bullets, MIT.replace("\n", "\r\n")])))).collect()}
    assert [found[k] for k in range(11)] == ["MIT", "GPL-3.0", "GPL-2.0", "GPL-2.0", "BSD-2-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "Apache-2.0", "BSD-2-Clause", "MIT"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This project is licensed under the MIT License.", "MIT"), ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("MIT OR Apache-2.0", "Apache-2.0,MIT"), ("It is free. Licensed under the GNU Lesser General Public License, version 2.1 or later", "LGPL-2.1"),
        ("This program is distributed under the terms of the GNU AGPL v3.", "AGPL-3.0"), ("The text is available under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"), ("Distributed under the terms of the Apache License 2.0.", "Apache-2.0"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later", "Apache-2.0,GPL-2.0,MIT"), ("x " * 2000 + "released under the ISC license " + "y " * 2000, "ISC"), ("The road is covered by snow and ice.", ""), ("Used by the mit students", ""), ("mit or without", ""), ("", ""), (None, ""),
    ],
)
def test_notices_and_expressions(documents, text, expected):
    assert licenses.license_scan(documents([(1, text)])).first().licenses == expected
