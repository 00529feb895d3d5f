"""Operator 5: license scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, which are normalised (lower case, runs of other
signs than letters and digits become one space) and looked up among known
license sentences. The identifiers found, in text order, are matched against
ordered license rules: each rule is a sequence of identifiers, rules come from
the most to the least specific, and a match consumes its identifiers, so a
short rule does not report again what a longer one has explained.

A colon, a semicolon or a blank line ends a sentence as a full stop does, but known
sentences hold some of them (``free software: you can``), so the look-up goes over
them. In the text between full stops a known sentence begins at any word and ends
where a line or part ends, or at a comma, bracket or quotation mark (wrapped license
texts, also in comments, and texts with words around them). Of known sentences that
overlap, the first counts, and of those that begin alike the longest. Behind "not",
"never" or "no longer" none begins.

Sentences that name a license (``distributed under the terms of the MIT license``)
are known by a verb, "under", and a name of ``NAMES``; their identifier is
``notice:<license>``. SPDX tags are read as expressions: their identifiers are
looked up, and AND, OR, WITH and brackets decide whether the whole is restricted
(a choice is not, if one of its sides is free). "All rights reserved" is a license of
its own only where no other is found: the notices of free licenses have it, too.

All work is done in the row of a document: no shuffle, and tables of fixed size.
A text without a word that every known sentence has is not cut into sentences.

Defined cases: null and empty texts have no sentences; a document without known
sentences has empty lists; a sentence that stands twice counts twice; known
sentences that no rule explains, and SPDX identifiers that are not known, are
returned as ``unmatched``; a very long text is scanned whole, in its row; repeated
rows are scanned each; rules and names are tried in a fixed order, so there are no
ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import read_table

# Sentences of public licenses and notices, normalised.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-compliance": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
                     "as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                 "files the software to deal in the software without restriction including without limitation the rights to use copy "
                 "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
                 "software is furnished to do so subject to the following conditions",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                   "the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
                 "warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
                     "an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
                     "other dealings in the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                        "license as published by the free software foundation either version 3 of the license or at your option any "
                        "later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                         "license as published by the free software foundation either version 2 of the license or at your option any "
                         "later version",
    "gpl-useful": "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                  "warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                          "following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                  "disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "all-rights": "all rights reserved",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
                 "that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
                 "warranties of merchantability and fitness",
    "unlicense-release": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
                        "compiled binary for any purpose commercial or non commercial and by any means",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
                 "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and "
                 "to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all "
                 "subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
                  "redistribute it freely subject to the following restrictions",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
                  "available at http www eclipse org legal epl 2 0",
}

# The notices of the GNU family, by rule: what is licensed, under which license and version, with or without later ones.
_GNU = {"": ("GPL", ("2", "3")), "lesser ": ("LGPL", ("2 1", "3")), "library ": ("LGPL", ("2",)), "affero ": ("AGPL", ("3",))}


def _spdx_version(words: str) -> str:
    return words.replace(" ", ".") if " " in words else words + ".0"


GNU_RULES = []
for _thing in ("program", "library", "software", "file"):
    for _kind, (_short, _versions) in _GNU.items():
        _useful, _details = f"gnu-useful-{_thing}", f"gnu-details-{_kind.strip() or 'general'}"
        SENTENCES.setdefault(_useful, f"this {_thing} is distributed in the hope that it will be useful but without any warranty without even the implied "
                                      "warranty of merchantability or fitness for a particular purpose")
        SENTENCES.setdefault(_details, f"see the gnu {_kind}general public license for more details")
        for _v in _versions:
            for _end, _later in (("", ""), (" or at your option any later version", "-or-later")):
                _id = f"gnu-{_thing}-{_short}-{_spdx_version(_v)}{_later}"
                SENTENCES[_id] = (f"this {_thing} is free software you can redistribute it and or modify it under the terms of the gnu {_kind}general "
                                  f"public license as published by the free software foundation either version {_v} of the license{_end}")
                SENTENCES[_id + "-of"] = SENTENCES[_id].replace("foundation either version", "foundation version")
                _license = f"{_short}-{_spdx_version(_v)}{_later}"
                for _own in (_id, _id + "-of"):
                    GNU_RULES += [(f"{_license} (full notice)", (_own, _useful, _details)), (_license, (_own,))]
#: one identifier for each sentence: of equal ones the first
_ID_OF = {}
for _id, _sentence in SENTENCES.items():
    _ID_OF.setdefault(_sentence, _id)
GNU_RULES = [(name, tuple(_ID_OF[SENTENCES[i]] for i in ids)) for name, ids in GNU_RULES]

# Names of licenses, normalised, and their SPDX identifiers.
NAMES = {
    "mit license": "MIT", "mit licence": "MIT", "expat license": "MIT", "isc license": "ISC", "unlicense": "Unlicense", "zlib license": "Zlib",
    "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0",
    "apache software license version 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause",
    "modified bsd license": "BSD-3-Clause", "bsd license": "BSD", "boost software license version 1 0": "BSL-1.0",
    "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mozilla public license v 2 0": "MPL-2.0", "mpl 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0", "eclipse public license 2 0": "EPL-2.0", "eclipse public license v2 0": "EPL-2.0",
    "eclipse public license version 1 0": "EPL-1.0", "eclipse public license v1 0": "EPL-1.0",
    "creative commons zero v1 0 universal": "CC0-1.0", "cc0 1 0": "CC0-1.0", "cc0": "CC0-1.0",
}
for _kind, (_short, _versions) in _GNU.items():
    for _v in (*_versions, *(("1", "2 0", "3 0") if _short == "GPL" else ("3 0",))):
        _license = f"{_short}-{_spdx_version(_v)}"
        for _name in (f"gnu {_kind}general public license", f"gnu {_short.lower()}", _short.lower()):
            NAMES |= {f"{_name} version {_v}": _license, f"{_name} v{_v}": _license, f"{_name} {_v}": _license, f"{_name} v {_v}": _license}
        NAMES[f"{_short.lower()}v{_v}"] = _license
for _terms, _long in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"),
                      ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives")):
    for _v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
        _license = f"CC-{_terms.upper().replace(' ', '-')}-{_v.replace(' ', '.')}"
        for _name in (f"cc {_terms} {_v}", f"creative commons {_long} {_v}"):
            for _end in ("", " license", " international", " international license", " unported license", " generic license"):
                NAMES[_name + _end] = _license

#: SPDX identifiers that are known: those of the names, and what they were called before.
SPDX = {x.lower(): x for x in {*NAMES.values()} - {"BSD"}}
SPDX |= {f"{x.lower()}-only": x for x in NAMES.values() if "GPL" in x} | {f"{x.lower()}-or-later": f"{x}-or-later" for x in NAMES.values() if "GPL" in x}
SPDX |= {f"{x.lower()}+": f"{x}-or-later" for x in NAMES.values() if "GPL" in x} | {"bsl-1.0": "BSL-1.0", "zlib": "Zlib"}

# Rules in order, the most specific first.
RULES = (
    ("Apache-2.0 (full notice)", ("apache2-the-license", "apache2-compliance", "apache2-copy", "apache2-basis", "apache2-see")),
    ("MIT (full text)", ("mit-grant", "mit-include", "mit-as-is", "mit-liability")),
    ("BSD-3-Clause (full text)", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause (full text)", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later (full notice)", ("gpl-redistribute", "gpl-useful", "gpl-details")),
    ("GPL-2.0-or-later (full notice)", ("gpl2-redistribute", "gpl-useful", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("Apache-2.0", ("apache2-the-license",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MPL-2.0 (full notice)", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("ISC (full text)", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("Unlicense (full text)", ("unlicense-release", "unlicense-anyone")),
    ("Unlicense", ("unlicense-release",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib (full text)", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    *GNU_RULES,
)

#: Where no other license is found.
LAST = ("Proprietary", "all-rights")

#: Licenses that do not allow free commercial use of the text, or ask for more than a notice.
RESTRICTED = ("GPL", "LGPL", "AGPL", "MPL", "EPL", "CC-BY-NC", "CC-BY-SA", "CC-BY-ND", "Proprietary")

# ends of a sentence, of a line, of a sentence where a known one may go on, and of a part of a sentence
_SENTENCE_END, _LINE_END, _PART_END, _PAUSE = "\x01", "\x02", "\x03", "\x04"
_INNER = f"{_LINE_END}{_PART_END}{_PAUSE}"
_GAP = f"[ {_INNER}]+"
_VERB = "(?:licensed|released|distributed|redistributed|published|provided|available|covered)"
_UNDER = r"under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
_LATER = "(?: or (?:at your option )?(?:any )?later(?: versions?)?)"


def _any(texts) -> str:
    return "|".join(sorted(set(texts), key=lambda x: (-len(x), x)))


_NOTICE = f"{_VERB} {_UNDER}(?:{_any(NAMES)}){_LATER}?"
_KNOWN = (r"(?<![\p{L}\p{N}])(?<!not )(?<!never )(?<!no longer )(?<!not be )(?:" + f"{_any(SENTENCES.values())}|{_NOTICE}".replace(" ", _GAP)
          + rf")(?=[{_INNER}]|$)")
#: Every known sentence and every SPDX tag holds one of these.
_HINTS = ("licen", "rights reserved", "redistribut", "hereby granted", "copyright", "warranty", "warranties", "public domain", " under ", "\nunder ", "under\n",
          "under the", "free software", "anyone is free", "to anyone", "mpl")
_TAG = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"


def sentences_of(text: Column) -> Column:
    """The text between full stops, in order, normalised; its lines and parts are still apart."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("https:"), F.lit("http:"))
    marked = F.regexp_replace(low, r"(?<![.!?;:])(?<! v)[;:]*+[.!?][.!?;:]*+(?=\s|$)", _SENTENCE_END)
    marked = F.regexp_replace(marked, r"(?<![.!?;:])[;:]++(?=\s|$)|\n\s*\n", _PART_END)
    marked = F.regexp_replace(F.regexp_replace(marked, r"[\r\n]+", _LINE_END), r"[,()\[\]{}\"“”]+", _PAUSE)
    marked = F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{_SENTENCE_END}{_INNER}]+", " ")
    edge = f"[ {_INNER}]*"
    parts = F.split(marked, f"{edge}{_SENTENCE_END}{edge}")
    clean = F.transform(parts, lambda s: _one_mark(F.regexp_replace(s, f"^{edge}|{edge}$", "")))
    return F.filter(clean, lambda s: s != "")


def _one_mark(s: Column) -> Column:
    """Of the marks between two words the strongest: a part's end, a line's end, a pause."""
    for mark in (_PART_END, _LINE_END, _PAUSE):
        s = F.regexp_replace(s, f"[ {_INNER}]*{mark}[ {_INNER}]*", mark)
    return s


def n_parts(sentence: Column) -> Column:
    """Sentences in the text between full stops, cut also at colons, semicolons and blank lines."""
    return F.length(sentence) - F.length(F.translate(sentence, _PART_END, "")) + 1


def known_ids(sentence: Column) -> Column:
    """Identifiers in the text between full stops, of sentences that end where a line or part of it ends."""
    known = F.create_map(*(F.lit(x) for s, i in _ID_OF.items() for x in (s, i)))
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    found = F.regexp_extract_all(sentence, F.lit(_KNOWN), F.lit(0))

    def identifier(s: Column) -> Column:
        plain = F.regexp_replace(s, _GAP, " ")
        name = F.regexp_extract(plain, f"^{_VERB} {_UNDER}(.*?){_LATER}?$", 1)
        later = F.when(plain.rlike(f"{_LATER}$"), F.lit("-or-later")).otherwise(F.lit(""))
        return F.coalesce(F.try_element_at(known, plain), F.concat(F.lit("notice:"), F.try_element_at(names, name), later))
    return F.transform(found, identifier)


def spdx_expressions(text: Column) -> Column:
    """The expressions of the text's SPDX tags."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_TAG), F.lit(1)), lambda e: F.trim(e)), lambda e: e != "")


def spdx_names(expression: Column) -> Column:
    """The licenses that an expression names, without those of its exceptions."""
    plain = F.regexp_replace(expression, r"(?i)(?<!\S)WITH\s+[A-Za-z0-9.+-]+|(?<![\w.+-])(?:AND|OR)(?![\w.+-])|[()]", " ")
    return F.filter(F.split(F.lower(plain), r"\s+"), lambda x: x != "")


def spdx_restricted(expression: Column, is_restricted) -> Column:
    """Whether every choice that an expression leaves holds a restricted license. AND binds more than OR."""
    marked = F.regexp_replace(expression, r"(?i)(?<!\S)WITH\s+[A-Za-z0-9.+-]+", " ")
    marked = F.regexp_replace(F.regexp_replace(marked, r"(?i)(?<![\w.+-])AND(?![\w.+-])", " & "), r"(?i)(?<![\w.+-])OR(?![\w.+-])", " | ")
    tokens = F.filter(F.split(F.regexp_replace(marked, r"([()&|])", " $1 "), r"\s+"), lambda x: x != "")
    word = F.array_join(F.transform(tokens, lambda t: F.when(t.isin("(", ")", "&", "|"), t).when(is_restricted(F.lower(t)), "R").otherwise("F")), "")

    def step(e: Column, _) -> Column:
        e = F.regexp_replace(F.regexp_replace(F.regexp_replace(e, r"\(([RF])\)", "$1"), r"F&F", "F"), r"R&[RF]|F&R", "R")
        return F.regexp_replace(F.regexp_replace(e, r"(?<!&)R\|R(?!&)", "R"), r"(?<!&)(?:F\|[RF]|R\|F)(?!&)", "F")
    # each step removes at least one operator or pair of brackets of what is left
    return F.aggregate(F.sequence(F.lit(0), F.size(tokens)), word, step) == "R"


def _literal_rules() -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (0 for a text without a word of a license), sentence_ids, licenses, unmatched, restricted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low, hinted = F.lower(text), F.lit(False)
    for hint in _HINTS:
        hinted = hinted | F.contains(F.col("low"), F.lit(hint))
    none = F.array().cast("array<string>")
    out = docs.select("doc_id", text.alias("text"), low.alias("low")).select("doc_id", F.when(hinted, F.col("text")).alias("text"))
    out = out.select("doc_id", F.when(F.col("text").isNotNull(), sentences_of(F.col("text"))).otherwise(none).alias("sentences"),
                     F.when(F.col("text").isNotNull(), spdx_expressions(F.col("text"))).otherwise(none).alias("tags"))
    out = out.select("doc_id", "tags", F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + n_parts(s)).alias("n_sentences"),
                     F.flatten(F.transform("sentences", known_ids)).alias("sentence_ids"))
    # rules consume identifiers from the left; what is consumed leaves a mark, so its neighbours do not join
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("rest"),
                     none.alias("licenses"))
    found = F.aggregate(_literal_rules(), start, lambda at, rule: F.when(
        F.instr(at["rest"], rule["ids"]) > 0,
        F.struct(F.replace(at["rest"], rule["ids"], F.lit("|")).alias("rest"),
                 F.array_append(at["licenses"], rule["name"]).alias("licenses"))).otherwise(at))
    out = out.withColumn("found", F.when(F.size("sentence_ids") > 0, found).otherwise(F.struct(F.lit("").alias("rest"), none.alias("licenses"))))
    # what rules left: names of licenses, SPDX identifiers, and "all rights reserved" if nothing else is found
    spdx = F.create_map(*(F.lit(x) for pair in sorted(SPDX.items()) for x in pair))
    named = F.transform(F.regexp_extract_all(F.col("found.rest"), F.lit("<notice:([^>]*)>")), lambda x: x)
    tagged = F.flatten(F.transform("tags", spdx_names))
    out = out.select("doc_id", "n_sentences", "sentence_ids", "tags", F.regexp_replace("found.rest", "<notice:[^>]*>", "|").alias("rest"),
                     F.array_distinct(F.concat(F.col("found.licenses"), named)).alias("by_text"),
                     F.filter(F.transform(tagged, lambda x: F.try_element_at(spdx, x)), lambda x: x.isNotNull()).alias("by_tag"),
                     F.transform(F.filter(tagged, lambda x: F.try_element_at(spdx, x).isNull()), lambda x: F.concat(F.lit("spdx:"), x)).alias("unknown"))
    alone = (F.size("by_text") + F.size("by_tag") == 0) & (F.instr("rest", f"<{LAST[1]}>") > 0)
    by_text = F.when(alone, F.array(F.lit(LAST[0]))).otherwise(F.col("by_text"))
    restricted = lambda x: x.rlike("^(" + "|".join(RESTRICTED) + ")")
    # the expressions decide on the licenses that only they name
    choice = F.exists("tags", lambda e: spdx_restricted(e, lambda t: F.coalesce(restricted(F.try_element_at(spdx, t)), F.lit(False))))
    left = F.regexp_extract_all(F.replace(F.col("rest"), F.lit(f"<{LAST[1]}>"), F.lit("|")), F.lit("<([^>]*)>"))
    return out.select("doc_id", "n_sentences", "sentence_ids", F.array_distinct(F.concat(by_text, F.col("by_tag"))).alias("licenses"),
                      F.concat(left, F.col("unknown")).alias("unmatched"), (F.exists(by_text, restricted) | choice).alias("restricted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read_table(spark, sf_dir, "documents"))
