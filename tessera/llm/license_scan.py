"""Operator 1, licence scan: sentence recognition, then ordered rules over sentence identifiers.

A text is normalised: letters in lower case, every run of other characters than a-z and 0-9 one separator. A line's end
and a stop (. ! ? : ;) before white space is a mark. A known sentence is found where its
words stand between two marks, whatever separates the words: line ends, as licence texts are wrapped, comment
signs, or abbreviations' stops; a sentence of LONG words is found without marks too, as texts lose line ends. Of
sentences that begin at one place the longest is taken, and the search goes on behind it. The sentences' identifiers, in text order, form a sequence.

Rules are ordered sequences of identifiers; the sequence is read from left to right, at each place the first rule that
fits takes its identifiers, and the reading goes on behind them. All of it is one projection: no shuffle, no Python
on the executors. The patterns are built from the catalogue as a prefix tree, so that a text's words are compared with
sentences that share their beginning once; texts that lack all of a few words, of which every known sentence has one, are not searched.

Null and empty texts have no sentence: empty strings and 0. Texts of any length are scanned whole. Repeated rows give
repeated results. Only the text column is read; columns of docs that have the names of the results are replaced.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Sentences of standard licence texts and notices, fixed values: identifier and text.
TEXTS = [
    ("mit_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit_notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("mit_as_is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit_as_is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("mit_liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc_grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zero_bsd_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc_as_is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("isc_liability", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_adverts", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd_names", "Neither the name of OWNER nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd_as_is", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd_liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache2_ref", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache2_use", "you may not use this file except in compliance with the License."),
    ("apache2_copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2_copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2_as_is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2_as_is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
    ("apache2_limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache2_title", "Apache License Version 2.0, January 2004"),
    ("apache2_title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache2_terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mpl2_ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl2_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl2_title", "Mozilla Public License Version 2.0"),
    ("unlicense_domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense_anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib_as_is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib_liability", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib_origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib_altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("zlib_notice", "This notice may not be removed or altered from any source distribution."),
    ("boost_title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost_grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("cc0_title", "CC0 1.0 Universal"),
    ("cc0_waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("fsf_verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("gpl_hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl3_title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2_title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl3_title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl21_title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("agpl3_title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("reserved", "All rights reserved."),
]

#: Families whose notices and references differ by name and version alone: prefix of identifiers, name, version as written in the long notice.
GNU = [("gpl2", "General Public License", "2"), ("gpl3", "General Public License", "3"), ("lgpl21", "Lesser General Public License", "2.1"), ("lgpl3", "Lesser General Public License", "3"), ("agpl3", "Affero General Public License", "3")]
#: Names under which a licence is referred to: prefix of identifiers, SPDX identifier, names.
NAMED = [
    ("mit", "MIT", ("MIT License", "MIT Licence", "MIT")),
    ("isc", "ISC", ("ISC License",)),
    ("apache2", "Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0")),
    ("bsd2", "BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("bsd3", "BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License")),
    ("mpl2", "MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0")),
    ("boost", "BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("zlib", "Zlib", ("zlib License",)),
    ("unlicense", "Unlicense", ("Unlicense",)),
    ("cc0", "CC0-1.0", ("CC0 1.0", "CC0")),
    ("gpl2", "GPL-2.0-only", ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2")),
    ("gpl3", "GPL-3.0-only", ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPLv3")),
    ("lgpl21", "LGPL-2.1-only", ("GNU Lesser General Public License, version 2.1", "LGPLv2.1")),
    ("lgpl3", "LGPL-3.0-only", ("GNU Lesser General Public License, version 3", "LGPLv3")),
    ("agpl3", "AGPL-3.0-only", ("GNU Affero General Public License, version 3", "AGPLv3")),
]
CREATIVE = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CREATIVE_WORDS = {"by": "Attribution", "sa": "ShareAlike", "nd": "NoDerivatives", "nc": "NonCommercial"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def normal(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def catalogue() -> dict[str, str]:
    """Normalised sentence to identifier: the texts, and what the families' and names' rules make."""
    out = {normal(text): ident for ident, text in TEXTS}
    for ident, name, version in GNU:
        free = f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
        for subject in ("This program", "This library", "This software"):
            out[normal(f"{subject} {free}, either version {version} of the License, or (at your option) any later version.")] = f"{ident}_later"
            out[normal(f"{subject} {free}, version {version} of the License.")] = f"{ident}_only"
            out[normal(f"{subject} {free}, version {version}.")] = f"{ident}_only"
    names = [(ident, x) for ident, _, listed in NAMED for x in listed]
    for ident, name in names:
        for verb, article, subject in product(("licensed", "released", "distributed"), ("the ", ""), ("", "This work is ", "This project is ", "This software is ")):
            out.setdefault(normal(f"{subject}{verb} under {article}{name}"), f"{ident}_ref")
    for kind, version, subject in product(CREATIVE, VERSIONS, ("", "This work is ")):
        ident = f"cc_{kind.replace('-', '_')}_{version.replace('.', '')}_ref"
        out[normal(f"{subject}licensed under CC {kind} {version}")] = ident
        out[normal(f"{subject}licensed under a Creative Commons {'-'.join(CREATIVE_WORDS[x] for x in kind.split('-'))} {version} International License")] = ident
    for ident, spdx, _ in NAMED:
        out[normal(f"SPDX-License-Identifier: {spdx}")] = f"{ident}_ref"
    return out


#: Ordered rules: licence, class, the identifiers that must follow each other; those with ? may be missing.
RULES = [
    ("MIT", "permissive", "mit_grant mit_notice mit_as_is? mit_liability?"),
    ("ISC", "permissive", "isc_grant isc_as_is? isc_liability?"),
    ("0BSD", "permissive", "zero_bsd_grant isc_as_is? isc_liability?"),
    ("BSD-4-Clause", "permissive", "bsd_grant bsd_source? bsd_binary? bsd_adverts bsd_names? bsd_as_is? bsd_liability?"),
    ("BSD-3-Clause", "permissive", "bsd_grant bsd_source? bsd_binary? bsd_names bsd_as_is? bsd_liability?"),
    ("BSD-2-Clause", "permissive", "bsd_grant bsd_source? bsd_binary? bsd_as_is? bsd_liability?"),
    ("Apache-2.0", "permissive", "apache2_title apache2_terms? apache2_ref? apache2_use? apache2_copy? apache2_as_is? apache2_limits?"),
    ("Apache-2.0", "permissive", "apache2_ref apache2_use? apache2_copy? apache2_as_is? apache2_limits?"),
    ("MPL-2.0", "weak copyleft", "mpl2_title? mpl2_ref mpl2_copy?"),
    ("MPL-2.0", "weak copyleft", "mpl2_title"),
    ("Zlib", "permissive", "zlib_as_is? zlib_liability? zlib_grant zlib_origin? zlib_altered? zlib_notice?"),
    ("BSL-1.0", "permissive", "boost_title? boost_grant"),
    ("Unlicense", "public domain", "unlicense_domain unlicense_anyone?"),
    ("CC0-1.0", "public domain", "cc0_title? cc0_waiver"),
    ("CC0-1.0", "public domain", "cc0_title"),
]
RULES += [(spdx, kind, f"{ident}_title fsf_verbatim?") for ident, spdx, kind in (("gpl3", "GPL-3.0-only", "copyleft"), ("gpl2", "GPL-2.0-only", "copyleft"), ("lgpl3", "LGPL-3.0-only", "weak copyleft"), ("lgpl21", "LGPL-2.1-only", "weak copyleft"), ("agpl3", "AGPL-3.0-only", "copyleft"))]
RULES += [
    (f"{spdx}-{end}", kind, f"{ident}_{'later' if end == 'or-later' else 'only'} gpl_hope?")
    for ident, spdx, kind in (("gpl3", "GPL-3.0", "copyleft"), ("gpl2", "GPL-2.0", "copyleft"), ("lgpl3", "LGPL-3.0", "weak copyleft"), ("lgpl21", "LGPL-2.1", "weak copyleft"), ("agpl3", "AGPL-3.0", "copyleft"))
    for end in ("or-later", "only")
]
_KINDS = {spdx: kind for spdx, kind, _ in RULES} | {"GPL-2.0-only": "copyleft"}
RULES += [(spdx, _KINDS.get(spdx, "permissive"), f"{ident}_ref") for ident, spdx, _ in NAMED if ident not in ("apache2", "mpl2")]
RULES += [
    (f"CC-{kind.upper()}-{version}", "noncommercial" if "nc" in kind else "no derivatives" if "nd" in kind else "copyleft" if "sa" in kind else "permissive", f"cc_{kind.replace('-', '_')}_{version.replace('.', '')}_ref")
    for kind, version in product(CREATIVE, VERSIONS)
]
RULES += [("LicenseRef-Proprietary", "proprietary", "reserved")]

#: Marks: stops (with closing quotes or brackets) before white space, and line ends.
MARKS, OTHERS, SINGLE = r"[.!?:;][\"')\]]{0,3}[\x20\t\f\n\r]|[\n\r]", r"[^a-z0-9\x01]+", "\x20*\x01[\x20\x01]*"
#: Sentences of so many words are known wherever they stand; shorter ones are references, known between marks alone.
LONG = 10
GAP = "[ \x01]+"
#: A licence's owner within a sentence stands for any: of one to twelve words.
OWNER = (f"neither{GAP}the{GAP}name{GAP}of{GAP}(?:[a-z0-9]+{GAP}){{1,12}}?nor{GAP}the{GAP}names", "neither the name of owner nor the names")


def tree_pattern(sequences: list[tuple[str, ...]], gap: str) -> str:
    """A pattern that matches any of the sequences of words, the longest first, with common beginnings written once."""
    tree: dict = {}
    for s in sequences:
        node = tree
        for w in s:
            node = node.setdefault(w, {})
        node[""] = {}

    def write(node: dict) -> str:
        """What may follow a node; empty if nothing may."""
        options = []
        for w, below in node.items():
            if w:
                parts = [w]
                while len(below) == 1 and "" not in below:  # a path without branches
                    ((w, below),) = below.items()
                    parts.append(w)
                rest = write(below)
                options.append(gap.join(parts) + (f"(?:{gap}{rest})?" if rest and "" in below else gap + rest if rest else ""))
        return f"(?:{'|'.join(options)})" if len(options) > 1 else "".join(options)

    return write(tree)


def sentence_pattern(sentences, long: int = LONG) -> str:
    """A known sentence between marks, or one of `long` words or more between any separators."""
    cut = [tuple(x.split(" ")) for x in sentences]
    whole, short = [x for x in cut if len(x) >= long], [x for x in cut if len(x) < long]
    options = ([f"(?<=[ \x01]){tree_pattern(whole, GAP)}(?=[ \x01])"] if whole else []) + ([f"(?<=\x01){tree_pattern(short, GAP)}(?= ?\x01)"] if short else [])
    return "|".join(options)


def anchors(sentences) -> list[str]:
    """Few words of which every sentence has one: the word of the most sentences that are left, again and again."""
    left, out = [set(x.split(" ")) for x in sentences], []
    while left:
        count: dict[str, int] = {}
        for words in left:
            for w in words:
                if len(w) > 2:
                    count[w] = count.get(w, 0) + 1
        if not count:
            return []
        out.append(max(count, key=lambda w: (count[w] * (len(w) > 5), count[w], w)))
        left = [x for x in left if out[-1] not in x]
    return out


def expanded(rules=None) -> list[tuple[str, str, tuple[str, ...]]]:
    """Each rule with every choice of its identifiers that may be missing, the fullest first; rules stay in order."""
    out, seen = [], set()
    for name, kind, parts in RULES if rules is None else rules:
        options = [(p.rstrip("?"), p.endswith("?")) for p in (parts.split() if isinstance(parts, str) else parts)]
        choices = product(*[((x,), ()) if may else ((x,),) for x, may in options])
        for ids in sorted((tuple(y for c in choice for y in c) for choice in choices), key=len, reverse=True):
            if ids and ids not in seen:
                seen.add(ids)
                out.append((name, kind, ids))
    return out


def framed(ids: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in ids)


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules=None) -> DataFrame:
    """Adds n_sentences, sentence_ids (each in <>, in text order), licenses (distinct, in order of finding, with commas) and license_class to docs.

    license_class is that of the found licence whose rule is first.
    """
    sentences = catalogue() if sentences is None else sentences
    rows = expanded(rules)
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER + "\x01", LOWER + " ")
    marked = F.regexp_replace(F.regexp_replace(lowered, MARKS, "\x01"), OTHERS, " ")
    marked = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\x01"), marked, F.lit("\x01")), SINGLE, "\x01"), *OWNER)
    found = F.regexp_extract_all(marked, F.lit(sentence_pattern(sentences)), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    ids = F.transform(found, lambda x: F.try_element_at(known, F.regexp_replace(x, GAP, " ")))
    if words := anchors(sentences):
        # Texts without any word that a known sentence must have are not searched.
        low = F.lower(F.col(text))
        ids = F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), ids).otherwise(F.array().cast("array<string>"))
    seq = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    out = docs.withColumns({"n_sentences": F.size(ids).cast("long"), "sentence_ids": seq})
    matches = F.regexp_extract_all("sentence_ids", F.lit("(" + "|".join(framed(r[2]) for r in rows) + ")"), F.lit(1))
    order = {}
    for name, kind, _ in rows:
        order.setdefault(name, (len(order), kind))
    named = F.create_map(*[F.lit(x) for name, _, r in rows for x in (framed(r), name)])
    ranks = F.create_map(*[F.lit(x) for name, (k, _) in order.items() for x in (name, k)])
    kinds = F.array(*[F.lit(kind) for _, kind in order.values()])
    listed = F.array_distinct(F.transform(matches, lambda x: F.try_element_at(named, x)))
    out = out.withColumn("licenses", F.array_join(listed, ","))
    names = F.filter(F.split("licenses", ","), lambda x: x != "")
    best = F.array_min(F.transform(names, lambda x: F.try_element_at(ranks, x)))
    return out.withColumn("license_class", F.coalesce(F.try_element_at(kinds, best + 1), F.lit("none")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licenses", "license_class")


def oracle() -> str:
    """The same rows in another way: texts are cut at their marks, every run of up to 24 pieces is looked up as a sentence, and folds take the longest from left to right.

    The catalogue's data are shared; no known sentence of the tables has more pieces, or stands without marks.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in catalogue().items())
    rules = ", ".join(f"({k}, {quoted(framed(ids))}, {len(ids)}, {quoted(name)}, {quoted(kind)})" for k, (name, kind, ids) in enumerate(expanded()))
    first: dict[str, int] = {}
    for name, _, _ in expanded():
        first.setdefault(name, len(first))
    owner = r"neither the name of ([a-z0-9]+ ){1,12}?nor the names"
    return rf"""
    WITH known(sentence, ident) AS (VALUES {known}), heads AS (SELECT DISTINCT split_part(sentence, ' ', 1) AS head FROM known),
    rules(k, ids, n, name, kind) AS (VALUES {rules}),
    cut AS (SELECT doc_id, string_split_regex(regexp_replace(lower_, '[.!?:;]["'')\]]{{0,3}}[ \t\f\n\r]|[\n\r]', chr(1), 'g'), chr(1)) AS raw
            FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}' || chr(1), '{LOWER} ') AS lower_ FROM documents)),
    piece AS (SELECT doc_id, list_transform(raw, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS p FROM cut),
    start_ AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM piece),
    run AS (SELECT doc_id, i, j, regexp_replace(array_to_string(list_filter(p[i:j], lambda x: x <> ''), ' '), '{owner}', 'neither the name of owner nor the names') AS sentence
            FROM (SELECT doc_id, p, i, unnest(range(i, least(i + 24, len(p) + 1))) AS j FROM start_ WHERE split_part(p[i], ' ', 1) IN (FROM heads))),
    best AS (SELECT doc_id, i, max(j) AS j, arg_max(ident, j) AS ident FROM run JOIN known USING (sentence) WHERE sentence <> '' GROUP BY doc_id, i),
    taken AS (SELECT doc_id, list_reduce(list_prepend({{'i': 0, 'j': 0, 's': ''}}, list({{'i': i, 'j': j, 's': '<' || ident || '>'}} ORDER BY i)),
                lambda a, x: CASE WHEN x.i > a.j THEN {{'i': a.i + 1, 'j': x.j, 's': a.s || x.s}} ELSE a END) AS a FROM best GROUP BY doc_id),
    q AS (SELECT d.doc_id, coalesce(a.i, 0)::BIGINT AS n_sentences, coalesce(a.s, '') AS sentence_ids FROM documents d LEFT JOIN taken USING (doc_id)),
    r AS (WITH RECURSIVE w(doc_id, rest, names) AS (
            SELECT DISTINCT doc_id, sentence_ids, []::VARCHAR[] FROM q
            UNION ALL
            SELECT doc_id, CASE WHEN hit IS NULL THEN substr(rest, strpos(rest, '>') + 1) ELSE substr(rest, length(hit.ids) + 1) END, CASE WHEN hit IS NULL THEN names ELSE list_append(names, hit.name) END
            FROM (SELECT doc_id, rest, names, (SELECT arg_min({{'ids': ids, 'name': name}}, k) FROM rules WHERE starts_with(w.rest, ids)) AS hit FROM w WHERE rest <> ''))
          SELECT doc_id, names FROM w WHERE rest = ''),
    named AS (SELECT doc_id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses, names FROM r)
    SELECT q.doc_id, n_sentences, sentence_ids, licenses, coalesce((SELECT arg_min(kind, k) FROM rules WHERE list_contains(n.names, name)), 'none') AS license_class
    FROM q JOIN named n USING (doc_id)"""
