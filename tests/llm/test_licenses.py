"""Operator 5 on published license texts, word for word, and against a scanner in plain Python over a whole table."""
import re

import pytest

from loanlens.llm import op5_licenses

SF_MID = "/root/testdata/sf0.01"

BSD3 = """Copyright (c) 2024, Acme Corp. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
MIT = """MIT License

Copyright (c) 2024 Jane Doe

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
LGPL21 = """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.

    This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    Lesser General Public License for more details.
"""
AGPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
GPL2_ONLY = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; version 2 of the License.
"""
MPL2 = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
APACHE_HTTPS = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""

# text -> (licenses, restricted)
PUBLISHED = {
    BSD3: (["BSD-3-Clause (full text)"], False), MIT: (["MIT (full text)"], False), LGPL21: (["LGPL-2.1-or-later (full notice)"], True),
    AGPL3: (["AGPL-3.0-or-later"], True), GPL2_ONLY: (["GPL-2.0"], True), MPL2: (["MPL-2.0 (full notice)"], True), ISC: (["ISC (full text)"], False),
    UNLICENSE: (["Unlicense (full text)"], False), APACHE_HTTPS: (["Apache-2.0 (full notice)"], False),
    "Copyright 2024 Acme. All rights reserved.": (["Proprietary"], True),
    "This file is not licensed under the MIT License.": ([], False), "It was never released under the GPL version 2.": ([], False),
    "The code is no longer distributed under the MIT license.": ([], False),
    "Distributed under the MIT License.": (["MIT"], False), "released under the MIT license, see LICENSE.": (["MIT"], False),
    "Available under the terms of the Mozilla Public License 2.0.": (["MPL-2.0"], True),
    "It is licensed under a CC BY-NC-SA 4.0 license.": (["CC-BY-NC-SA-4.0"], True), "Licensed under CC BY-ND 4.0": (["CC-BY-ND-4.0"], True),
    "Licensed under CC BY 4.0.": (["CC-BY-4.0"], False), "Licensed under Creative Commons Attribution 4.0 International License.": (["CC-BY-4.0"], False),
    "Licensed under the GNU Lesser General Public License v3 or later.": (["LGPL-3.0-or-later"], True),
    "Licensed under the 3-clause BSD license (see COPYING)": (["BSD-3-Clause"], False),
    "// SPDX-License-Identifier: GPL-2.0-only\n": (["GPL-2.0"], True), "# SPDX-License-Identifier: MIT OR Apache-2.0\n": (["MIT", "Apache-2.0"], False),
    "SPDX-License-Identifier: CC-BY-4.0": (["CC-BY-4.0"], False), "SPDX-License-Identifier: MIT AND GPL-3.0-or-later": (["MIT", "GPL-3.0-or-later"], True),
    "/* SPDX-License-Identifier: (GPL-2.0+ OR MIT) AND Apache-2.0 */": (["GPL-2.0-or-later", "MIT", "Apache-2.0"], False),
    "SPDX-License-Identifier: (MIT OR BSD-2-Clause) AND GPL-2.0-only": (["MIT", "BSD-2-Clause", "GPL-2.0"], True),
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR ISC": (["GPL-2.0", "ISC"], False),
    "SPDX-License-Identifier: ((MIT AND (GPL-2.0-only OR LGPL-2.1-only)) OR (Apache-2.0 AND (MIT)))": (["MIT", "GPL-2.0", "LGPL-2.1", "Apache-2.0"], False),
}


def commented(text, sign):
    return "".join(f"{sign} {line}".rstrip() + "\n" for line in text.splitlines())


def scanned(spark, texts):
    rows = op5_licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    return [r for _, r in sorted((r.doc_id, r) for r in rows)]


@pytest.mark.parametrize("sign", [None, "#", "//", " *"])
def test_published_texts(spark, sign):
    texts = [t if sign is None or "SPDX" in t else commented(t, sign) for t in PUBLISHED]
    got = [(r.licenses, r.restricted, r.unmatched) for r in scanned(spark, texts)]
    for t, g, (licenses, restricted) in zip(texts, got, PUBLISHED.values()):
        assert g == (licenses, restricted, []), t


def test_unknown_tags_and_lone_sentences_are_unmatched(spark):
    rows = scanned(spark, ["SPDX-License-Identifier: LicenseRef-Own OR MIT", "See the GNU General Public License for more details.", "no such thing", None, ""])
    assert [(r.licenses, r.restricted, r.unmatched) for r in rows[:2]] == [(["MIT"], False, ["spdx:licenseref-own"]), ([], False, ["gpl-details"])]
    assert all((r.n_sentences, r.licenses, r.unmatched) == (0, [], []) for r in rows[2:])


def plain_scan(text):
    """Identifiers of the known sentences of a text, by looking at every place of its sentences."""
    known = {}
    for i, s in op5_licenses.SENTENCES.items():
        known.setdefault(s, i)
    found = []
    low = re.sub(r"(?<![.!?;:])(?<! v)[;:]*[.!?][.!?;:]*(?=\s|$)", "\x01", (text or "").lower().replace("https:", "http:"))
    for part in low.split("\x01"):
        marked = re.sub(r"(?<![.!?;:])[;:]+(?=\s|$)|\n\s*\n|[\r\n]+|[,()\[\]{}\"“”]+", "\x02", part)
        words = re.findall(r"[^\W_]+|\x02", marked)
        ends = {n for n, w in enumerate(words + ["\x02"]) if w == "\x02"}
        at = 0
        while at < len(words):
            best = None
            if words[at] != "\x02":
                said, n = "", at
                while n < len(words) and len(said) < 600:
                    if words[n] != "\x02":
                        said = f"{said} {words[n]}".strip()
                        if said in known and n + 1 in ends and [w for w in words[:at] if w != "\x02"][-1:] not in (["not"], ["never"]):
                            best = (n, known[said])
                    n += 1
            if best:
                found.append(best[1])
                at = best[0]
            at += 1
    return found


def test_whole_table_against_the_plain_scanner(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.sentence_ids for r in op5_licenses.scanned(docs).collect()}
    word = re.compile("licen|rights reserved|redistribut|granted|warrant|public domain|free software", re.I)
    want = {d: plain_scan(t) if word.search(t or "") else [] for d, t in texts.items()}
    assert got == want
    assert sum(bool(x) for x in got.values()) > 10


def test_no_python_in_the_plan(spark):
    plan = op5_licenses.op5_license_scan(spark, SF_MID)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
