"""Operator 1 on standard licence texts, wrapped and not, alone and in a row."""

import re

from pyspark.sql import functions as F

from tessera.llm import license_scan

MIT = """MIT License

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
ISC = """ISC License

Copyright (c) 2020 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD3 = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Person & Sons, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE IS") :]
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""

NAMES = {"MIT": MIT, "ISC": ISC, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "MPL-2.0": MPL}


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license_scan.scan(rows.withColumns({c: F.lit("clash") for c in ("licenses", "found", "ids", "marked")}))
    return [(r.licenses, r.license_class, r.n_sentences) for r in out.orderBy("doc_id").collect()]


def test_references_and_odd_texts(spark):
    texts = [
        None, "", " \n. ", "x. This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "All rights reserved",
        "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "// SPDX-License-Identifier: BSD-3-Clause\nint x;",
        "not licensed under the MIT License", "Licensed under CC BY-NC 4.0.", "no. " * 50_000 + "Released under the MIT License.",
    ]
    want = [("", "none", 0)] * 3 + [("GPL-3.0-only,MIT", "copyleft", 2), ("LicenseRef-Proprietary", "proprietary", 1), ("Apache-2.0", "permissive", 2), ("BSD-3-Clause", "permissive", 1), ("", "none", 0), ("CC-BY-NC-4.0", "noncommercial", 1), ("MIT", "permissive", 1)]
    got = scanned(spark, texts + texts)
    assert [x[0] for x in got[:10]] == [x[0] for x in want] and [x[2] for x in got[:10]] == [x[2] for x in want] and got[:10] == got[10:]
    assert got[4][1] == "proprietary" and got[8][1] == "noncommercial" and got[0][1] == "none"
    assert scanned(spark, ["x"])[0][2] == 0 and license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_standard_texts_in_every_form(spark):
    texts = list(NAMES.values())
    forms = [
        texts, [re.sub("(?m)^", " * ", x) for x in texts], [x.replace("\n", "\r\n# ") for x in texts], [" ".join(x.split()) for x in texts],
        [x + x for x in texts], [" ".join((x + x).split()) for x in texts], ["/* " + x + " */\nint main() { return 0; }" for x in texts],
    ]
    got = scanned(spark, [x for form in forms for x in form])
    for k, form in enumerate(forms):
        assert [x[0] for x in got[k * len(texts) : (k + 1) * len(texts)]] == list(NAMES), k


def test_rules_take_their_identifiers_from_left_to_right(spark):
    got = scanned(spark, [BSD3 + "\n" + BSD2, BSD2 + BSD3 + MIT, MIT + APACHE + MIT])
    assert [x[0] for x in got] == ["BSD-3-Clause,BSD-2-Clause", "BSD-2-Clause,BSD-3-Clause,MIT", "MIT,Apache-2.0"]


def test_every_sentence_of_the_catalogue_is_matched_whole():
    pattern = re.compile(license_scan.sentence_pattern(license_scan.catalogue()))
    for s in license_scan.catalogue():
        assert [m[0] for m in pattern.finditer(f"\x01{s}\x01")] == [s]
    idents = set(license_scan.catalogue().values())
    assert all(x in idents for _, _, ids in license_scan.expanded() for x in ids)
