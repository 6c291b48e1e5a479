"""License scans by sentence rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, in lower case with runs of other characters as one space.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-short": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
}

#: A licence and the known sentences that name it, in this order.
RULES = [
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-the", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-warranty", "apache-see")),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty", "mit-liability")),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl3-notice-short",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty", "gpl-see")),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty", "gpl-see")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "mit-warranty")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("reserved",)),
]

#: What the standard texts hold beside these, as they are parted. In tables of their own: SQL is made from those above.
MORE_SENTENCES = {
    "gpl-program": "this program is free software",
    "gpl3-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-program-modify": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-either": "either version 3 of the license or at your option any later version",
    "gpl2-either": "either version 2 of the license or at your option any later version",
    "gpl-any-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-even-warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}
#: A GPL notice is parted at its semicolons, which differ between versions.
GPL_WARRANTIES = [("gpl-warranty",), ("gpl-any-warranty", "gpl-even-warranty")]
MORE_RULES = [
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    *(
        (f"GPL-{v}.0", (*head, *warranty, "gpl-see"))
        for v, free in ((3, "gpl-free"), (2, "gpl2-free"))
        for head in ((free,), ("gpl-program", f"gpl{v}-modify"), ("gpl-program", "gpl-modify", f"gpl{v}-either"), ("gpl-program-modify", f"gpl{v}-either"))
        for warranty in GPL_WARRANTIES
        if (head, warranty) != ((free,), GPL_WARRANTIES[0])
    ),
]
#: SPDX identifiers of licences that notices name, and the other names of those that have no version or one only.
IDENTIFIERS = """0BSD AFL-3.0 Artistic-2.0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 ISC
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Unlicense UPL-1.0 WTFPL Zlib ZPL-2.1""".split()
OTHER_NAMES = {
    "MIT": ["mit license", "expat license", "mit x11 license", "x11 license", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license version 2", "apache license 2 0", "apache license v2 0", "apache license v2", "apache software license version 2 0", "apache software license 2 0", "apache 2 0 license", "apache version 2 0", "apache 2 license", "apache license"],
    "BSD-2-Clause": ["2 clause bsd license", "two clause bsd license", "bsd two clause license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["3 clause bsd license", "three clause bsd license", "bsd three clause license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license", "boost license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "eclipse public license 2 0"],
    "EUPL-1.2": ["european union public licence 1 2", "european union public licence version 1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license"],
    "CC0-1.0": ["cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons zero", "cc0 license", "cc0"],
    "ISC": ["isc license", "isc licence"], "Zlib": ["zlib license", "zlib libpng license"], "Unlicense": ["the unlicense"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "sil open font license"], "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "ODbL-1.0": ["open database license version 1 0", "open database license"], "PSF-2.0": ["python software foundation license version 2", "psf license"],
}
GNU = {"GPL": ("general public license", ("2.0", "3.0", "1.0")), "LGPL": ("lesser general public license", ("2.1", "3.0", "2.0")), "AGPL": ("affero general public license", ("3.0", "1.0"))}
CREATIVE = {"by": ["attribution"], "nc": ["noncommercial", "non commercial"], "nd": ["noderivatives", "no derivatives", "noderivs"], "sa": ["sharealike", "share alike"]}
KINDS, VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("4.0", "3.0", "2.5", "2.0", "1.0")


def plain(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def called() -> dict[str, str]:
    """Names of licences in normal form, made by rule from those above, and the identifier that each stands for."""
    out = {plain(name): name for name in IDENTIFIERS}
    out |= {plain(name): ident for ident, names in OTHER_NAMES.items() for name in names}
    for short, (long, versions) in GNU.items():
        for version in versions:
            for v in {version, version.removesuffix(".0")}:
                heads = (f"gnu {long}", long, f"gnu {short}", short)
                names = [f"{head} {sign}{v}" for head in heads for sign in ("version ", "v", "v ", "")] + [f"{short}v{v}", f"{short}{v}"]
                names += [f"version {v} of the gnu {long}", f"gnu {long} {short} version {v}", f"gnu {long} {short} v{v}"]
                out |= {plain(name): f"{short}-{version}" for name in names}
    for kind in KINDS:
        longs = [""]
        for word in kind.split("-"):
            longs = [f"{head} {x}" for head in longs for x in CREATIVE[word]]
        for version in VERSIONS:
            ident = f"CC-{kind.upper()}-{version}"
            names = [f"cc {kind} {version}", f"creative commons {kind} {version}"] + [f"creative commons{long} {middle}{version}" for long in longs for middle in ("", "license ", "international ", "license version ")]
            names += [f"creative commons{long} {version} international" for long in longs]
            out |= {plain(name): ident for name in names}
    return out


VERBS = "licensed|licenced|released|distributed|redistributed|available|published|provided|covered|offered|shared|governed|used"
ARTICLES = "(?:the |a |an |either |both |your choice of )*"


def patterns() -> tuple[str, str, str]:
    """A notice, a whole sentence that is a licence expression, and each licence of an expression (after ``or``); groups hold the names."""
    names = "|".join(sorted(called(), key=lambda x: (-len(x), x)))
    suffix = "(?: or later| only)?"
    notice = rf"(?:^| )(?:(?:{VERBS})(?: [a-z]+)?(?: [a-z]+)? under|covered by|governed by) {ARTICLES}(?:terms (?:and conditions )?of {ARTICLES})?({names})(?: |$)"
    return notice, rf"^(?:{names}){suffix}(?: (?:or|and) (?:{names}){suffix})+$", rf"(?:identifier|or|and|with) ({names})\b"


SPDX = "spdx license identifier "
#: What a notice or an expression adds to the identifiers: this and the licence.
NOTICE = "names-"
ENDS, SPACE = r"([.!?;])[ \t\r\f]+", r"[ \t\r\n\f]+"
#: Where a paragraph or an item of a list begins: after lines without letters and digits, at a number or letter with ``.``
#: or ``)``, and at a bullet after ``. : ;``. BREAK stands for it while line ends become spaces.
BLANK, NUMBER, BULLET, BREAK = r"\n[^A-Za-z0-9\n]*\n", r"\n[ \t*#/]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+", r"([.:;])[ \t\r]*\n[ \t]*[-*\u2022][ \t]+", "\x1e"


def normal(sentence):
    return F.trim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def known(text, sentences: dict[str, str]):
    """The identifiers, in order, of the known sentences, licence notices and licence expressions among the lines and sentences of ``text``."""
    notice, expression, each = patterns()
    table = F.create_map(*[F.lit(x) for name, value in sentences.items() for x in (value, name)])
    names = F.create_map(*[F.lit(x) for name, value in called().items() for x in (name, NOTICE + value)])
    is_known = lambda n: n.isin(list(sentences.values()))
    first = sorted({name.split()[0] for name in called()})  # what an expression can begin with; the pattern is for few sentences only
    is_notice = lambda n: n.contains(" under ") | n.contains("covered by ") | n.contains("governed by ")
    is_listed = lambda n: n.contains(SPDX) | (F.substring_index(n, " ", 1).isin(first) & (n.contains(" or ") | n.contains(" and ")) & n.rlike(expression))

    def identified(n):
        listed = F.transform(F.regexp_extract_all(F.concat(F.lit("or "), n), F.lit(each), F.lit(1)), lambda x: F.try_element_at(names, x))
        return F.when(is_known(n), F.array(F.try_element_at(table, n))).when(is_listed(n), listed).otherwise(F.array(F.try_element_at(names, F.regexp_extract(n, notice, 1))))

    parts = F.transform(F.filter(F.split(F.regexp_replace(text, ENDS, "$1\n"), "\n"), lambda s: F.length(s) >= 3), normal)
    told = F.filter(parts, lambda n: is_known(n) | is_listed(n) | is_notice(n))
    return F.filter(F.flatten(F.transform(told, identified)), lambda x: x.isNotNull())


def paragraphs(text):
    """``text`` with one line for each paragraph and item of a list."""
    parted = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BULLET, f"$1{BREAK}"), NUMBER, BREAK), BLANK, BREAK)
    return F.translate(F.regexp_replace(parted, SPACE, " "), BREAK, "\n")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """Which licences the sentences of every row state.

    A text is parted at line ends and after ``. ! ? ;`` before white space; a wrapped text is also read with its line ends
    as spaces, and once more with the line ends inside paragraphs and items of lists as spaces (item numbers are dropped).
    Known sentences become identifiers, and so do the names of licences in a notice ("... is licensed under the terms of the
    MIT License ...", anywhere in a sentence) and in a licence expression (SPDX, or a sentence of names with or and and).
    Sentences of any length are normalised and looked at. A rule fits if its identifiers follow each other in the sequence of one of the
    readings. The identifiers returned are those of the reading that knows most (the first of equal ones). No row leaves its task: the
    sentences and rules are literals of the plan.

    Returns doc_id, sentence_ids (comma-joined, in order), n_sentences, licenses (comma-joined, by name). A null or empty
    text has none. Very long texts are read whole. Repeated rows are returned each; null ids stay. An empty table gives an
    empty result; other columns are ignored.
    """
    sentences, rules = sentences or SENTENCES | MORE_SENTENCES, (rules or RULES + MORE_RULES) + [(name, (NOTICE + name,)) for name in sorted(set(called().values()))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    readings = {"_lines": text, "_whole": F.regexp_replace(text, SPACE, " "), "_parts": paragraphs(text)}
    read = docs.select(F.col(id_col).alias("doc_id"), *[known(t, sentences).alias(name) for name, t in readings.items()])
    most = F.greatest(*map(F.size, readings))
    ids = read.select("*", F.coalesce(*[F.when(F.size(name) == most, F.col(name)) for name in readings]).alias("_ids"))
    held = F.concat(F.lit(","), F.concat_ws(",,;,", *[F.array_join(name, ",") for name in readings]), F.lit(","))
    joined = ids.select("doc_id", F.array_join("_ids", ",").alias("sentence_ids"), F.size("_ids").cast("long").alias("n_sentences"), held.alias("_held"))
    by_name = {name: [r for n, r in rules if n == name] for name in sorted({n for n, _ in rules})}
    fits = [F.when(F.greatest(*[F.contains("_held", F.lit(f",{','.join(r)},")) for r in own], F.lit(False)), F.lit(name)) for name, own in by_name.items()]
    return joined.withColumn("licenses", F.concat_ws(",", *fits)).drop("_held")
