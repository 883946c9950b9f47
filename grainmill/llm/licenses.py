"""Licence recognition by sentence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of published licences, normalised, and their identifiers. Normal form: lower case, every run of other
#: characters than ASCII letters and digits one space, no space at the ends.
SENTENCES: dict[str, str] = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this software is released under the mit license": "MITref",
    "spdx license identifier mit": "MITspdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "licensed under the apache license version 2 0": "ApacheRef2",
    "licensed under the apache license version 2 0 the license": "ApacheRef2",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "spdx license identifier apache 2 0": "ApacheSpdx",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "released under the bsd license": "BSDref",
    "licensed under cc by nc 4 0": "CCBYNC4",
    "licensed under cc by 4 0": "CCBY4",
    "licensed under cc by sa 4 0": "CCBYSA4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSA4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4",
    "all rights reserved": "AllRights",
    "apache license version 2 0 january 2004": "ApacheTitle2",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "ApacheGrant2",
    "gnu general public license version 2 june 1991": "GPL2title",
    "gnu general public license version 3 29 june 2007": "GPL3title",
    "gnu lesser general public license version 2 1 february 1999": "LGPL21title",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3title",
    "gnu affero general public license version 3 19 november 2007": "AGPL3title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "GNUverbatim",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLcopy",
    "you should have received a copy of the gnu lesser general public license along with this program": "LGPLcopy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLcopy",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2copy",
    "mozilla public license version 2 0": "MPL2title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSDgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "this is free and unencumbered software released into the public domain": "UnlicenseDedication",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "creative commons legal code cc0 1 0 universal": "CC0title",
    "cc0 1 0 universal": "CC0title",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0dedication",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "CC0dedication",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "boost software license version 1 0 august 17th 2003": "BoostTitle",
    "spdx license identifier gpl 2 0 only": "GPL2spdx",
    "spdx license identifier gpl 2 0 or later": "GPL2plusSpdx",
    "spdx license identifier gpl 3 0 only": "GPL3spdx",
    "spdx license identifier gpl 3 0 or later": "GPL3plusSpdx",
    "spdx license identifier lgpl 2 1 or later": "LGPL21spdx",
    "spdx license identifier agpl 3 0 or later": "AGPL3spdx",
    "spdx license identifier mpl 2 0": "MPL2spdx",
    "spdx license identifier bsd 2 clause": "BSD2spdx",
    "spdx license identifier bsd 3 clause": "BSD3spdx",
    "spdx license identifier isc": "ISCspdx",
    "spdx license identifier unlicense": "UnlicenseSpdx",
    "spdx license identifier cc0 1 0": "CC0spdx",
}
#: In this order: identifiers that follow each other (A|B: either; A?: may be missing), and the
#: licence. Every rule that matches takes its identifiers out of the sequence; later rules see the rest.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("MITgrant", "MITnotice", "MITwarranty"), "MIT"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("GPL3plus", "GPLwarranty", "GPLcopy?"), "GPL-3.0-or-later"),
    (("GPL2plus", "GPLwarranty", "GPLcopy?"), "GPL-2.0-or-later"),
    (("ApacheRef2", "ApacheCompliance", "ApacheWarranty?"), "Apache-2.0"),
    (("ApacheRef2|ApacheSpdx",), "Apache-2.0"),
    (("MITref|MITspdx|MITgrant",), "MIT"),
    (("GPL3ref",), "GPL-3.0"),
    (("GPL3plus",), "GPL-3.0-or-later"),
    (("GPL2plus",), "GPL-2.0-or-later"),
    (("CCBYNC4",), "CC-BY-NC-4.0"),
    (("CCBYSA4",), "CC-BY-SA-4.0"),
    (("CCBY4",), "CC-BY-4.0"),
    (("BSDref",), "BSD"),
    (("ApacheTitle2|ApacheGrant2",), "Apache-2.0"),
    (("AGPL3title", "GNUverbatim?"), "AGPL-3.0"),
    (("LGPL3title", "GNUverbatim?"), "LGPL-3.0"),
    (("LGPL21title", "GNUverbatim?"), "LGPL-2.1"),
    (("GPL3title", "GNUverbatim?"), "GPL-3.0"),
    (("GPL2title", "GNUverbatim?"), "GPL-2.0"),
    (("AGPL3plus", "GPLwarranty?", "AGPLcopy?"), "AGPL-3.0-or-later"),
    (("LGPL3plus", "GPLwarranty?", "LGPLcopy?"), "LGPL-3.0-or-later"),
    (("LGPL21plus", "GPLwarranty?", "LGPLcopy?"), "LGPL-2.1-or-later"),
    (("MPL2notice", "MPL2copy?"), "MPL-2.0"),
    (("MPL2title|MPL2spdx",), "MPL-2.0"),
    (("ISCgrant", "ISCwarranty?"), "ISC"),
    (("0BSDgrant", "ISCwarranty?"), "0BSD"),
    (("UnlicenseDedication", "UnlicenseGrant?"), "Unlicense"),
    (("CC0title|CC0dedication|CC0spdx",), "CC0-1.0"),
    (("ZlibGrant",), "Zlib"),
    (("BoostTitle", "BoostGrant?"), "BSL-1.0"),
    (("BoostGrant",), "BSL-1.0"),
    (("GPL2spdx",), "GPL-2.0"),
    (("GPL2plusSpdx",), "GPL-2.0-or-later"),
    (("GPL3spdx",), "GPL-3.0"),
    (("GPL3plusSpdx",), "GPL-3.0-or-later"),
    (("LGPL21spdx",), "LGPL-2.1-or-later"),
    (("AGPL3spdx",), "AGPL-3.0-or-later"),
    (("BSD2spdx",), "BSD-2-Clause"),
    (("BSD3spdx",), "BSD-3-Clause"),
    (("ISCspdx",), "ISC"),
    (("UnlicenseSpdx",), "Unlicense"),
    (("AllRights",), "Proprietary"),
]
#: Where a sentence may begin or end: . ! ? ; : before white space, a list mark in parentheses at a line's beginning, a line break.
STOP, ITEM = r"[.!?;:]+\s+", r"(\n\s*\(?[a-z0-9]{1,3})\)\s+"
#: Every known sentence holds one of these words, so a text without any has none.
WORDS = ("license", "permission", "permitted", "copyright", "redistribution", "warranty", "warranties", "reserved", "domain", "mpl 2 0", "source code form", "cc0")
if lost := [x for x in SENTENCES if not any(w in x for w in WORDS)]:
    raise ValueError(f"sentences without any of WORDS: {lost}")
#: The SQL's choice of sentences.
HINT = "(?i)licen[sc]e|permi(ssion|tted)|copyright|provided|redistribut|general public|all rights|domain|\\bmpl\\b|cc0|source code"


def pattern(rule: tuple[str, ...]) -> str:
    """A rule as a regular expression over identifiers that each stand as ;identifier;."""
    return "".join(f"(;{x[:-1]};)?" if x.endswith("?") else f";({x});" if "|" in x else f";{x};" for x in rule)


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in its order. A known sentence begins and ends where a sentence
    may; in between it may be wrapped over lines and hold any stop."""
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    # one line for each part between stops, in normal form; a known sentence is one or several of them
    parts = F.regexp_replace(F.regexp_replace(F.lower(text), ITEM, "$1\n"), STOP, "\n")
    parts = F.trim(F.regexp_replace(F.regexp_replace(parts, r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "\n"))
    every = "|".join(x.replace(" ", r"[ \n]") for x in sorted(SENTENCES, key=len, reverse=True))
    return F.transform(F.regexp_extract_all(parts, F.lit(rf"(?m)^(?:{every})$"), F.lit(0)), lambda x: F.element_at(known, F.translate(x, "\n", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, licenses) for each row of docs (doc_id, text).

    sentences: identifiers of known licence sentences, joined by ';', in the text's order;
    licenses: what the ordered rules make of that sequence, joined by ';', in the rules' order;
    'unknown' where known sentences fit no rule. Both empty for texts without known sentences, null and empty
    texts included. Whole texts are read; other columns are ignored; repeated rows and null ids
    stay. One scan, no shuffle, nothing but built-in expressions: sentences are looked
    for only in texts that hold one of WORDS.
    """
    ids = F.when(F.col("text").rlike("(?i)" + "|".join(w.replace(" ", r"[^a-zA-Z0-9]+") for w in WORDS)), identifiers(F.col("text")))
    out = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.coalesce(F.array_join(ids, ";"), F.lit("")).alias("sentences"))
    rest = F.when(F.col("sentences") != "", F.concat(F.lit(";"), F.replace("sentences", F.lit(";"), F.lit(";;")), F.lit(";")))
    out, names = out.withColumn("_rest", F.coalesce(rest, F.lit(""))), []
    for k, (rule, name) in enumerate(RULES):
        hit = F.when(F.col("_rest") != "", F.col("_rest").rlike(pattern(rule))).otherwise(False)
        out = out.withColumn(f"_r{k}", F.when(hit, F.lit(name))).withColumn("_rest", F.when(hit, F.regexp_replace("_rest", pattern(rule), "#")).otherwise(F.col("_rest")))
        names.append(F.col(f"_r{k}"))
    found = F.array_join(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull())), ";")
    return out.select("doc_id", "sentences", F.when((F.col("sentences") != "") & (found == ""), F.lit("unknown")).otherwise(found).alias("licenses"))


def sql() -> str:
    """The same in DuckDB's SQL over the table documents."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
    step = "SELECT doc_id, sentences, CASE WHEN sentences = '' THEN '' ELSE ';' || replace(sentences, ';', ';;') || ';' END AS rest, []::VARCHAR[] AS found FROM s"
    for rule, name in RULES:
        p = pattern(rule)
        step = f"SELECT doc_id, sentences, regexp_replace(rest, '{p}', '#', 'g') AS rest, CASE WHEN regexp_matches(rest, '{p}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM ({step})"
    return f"""
WITH k AS (SELECT MAP {{{known}}} AS m),
h AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[.!?;]+\\s+'), lambda x: regexp_matches(x, '{HINT}')) AS x FROM documents),
i AS (SELECT doc_id, flatten(list_transform(x, lambda s: CASE WHEN m[{norm('s')}] IS NOT NULL THEN [m[{norm('s')}]]
  ELSE list_filter(list_transform(string_split(s, chr(10)), lambda y: m[{norm('y')}]), lambda z: z IS NOT NULL) END)) AS ids FROM h, k),
s AS (SELECT doc_id, coalesce(array_to_string(ids, ';'), '') AS sentences FROM i)
SELECT doc_id, sentences, CASE WHEN sentences <> '' AND len(found) = 0 THEN 'unknown' ELSE array_to_string(found, ';') END AS licenses FROM ({step})
"""
