"""The operators that have SQL or a simple brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.llm import ann, components, decontam, licenses, registry, sharding, urls
from tests.oracle import database, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], database(SF))


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 10
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 9)
    assert moved < 0.25 * 1009
    for bad in ([], names):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1000)


def test_sharding_odd(spark, odd, none):
    got = sharding.place(odd, "doc_id", ["a", "b", "c"], 101, prefix="to_")
    assert got.count() == odd.count() and got.where("to_shard is null").isEmpty()
    assert len({r.to_shard for r in got.where("doc_id = 6").collect()}) == 1
    assert sharding.place(none, "doc_id", ["a"], 101).isEmpty()
    there = sharding.place(odd.withColumn("SLOT", F.lit(1)), "doc_id", ["a"], 101)
    assert there.columns == [*odd.columns, "SLOT", "slot_", "shard"] and there.where("SLOT <> 1 or slot_ is null").isEmpty()


def test_licences(spark, odd, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions. The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    rows = [(1, mit), (2, "x |\nLicensed under CC BY 4.0."), (3, "You may not use this file except in compliance with the License."), (4, "no known sentence about a license")]
    got = {r.doc_id: (r.sentences, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MITgrant;MITnotice;MITwarranty", "MIT"), 2: ("CCBY4", "CC-BY-4.0"), 3: ("ApacheCompliance", "unknown"), 4: ("", "")}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).isEmpty()
    assert {r.licenses for r in licenses.scan(odd).where("doc_id = 6").collect()} == {"MIT"}


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
BSD2 = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
GPL3 = GPL3[: GPL3.index("; if not")] + ".  If not, see <https://www.gnu.org/licenses/>.\n"


def test_licences_as_they_are_published(spark):
    texts = [MIT, BSD2 + DISCLAIMER, BSD3 + DISCLAIMER, GPL2, GPL3, BSD3.replace("1. ", "(1) ").replace("2. ", "(2) ").replace("3. ", "c) "), "# " + GPL2.replace("\n", "\n# "), "License: all\nrights reserved"]
    rows = [*enumerate(texts), *((100 + k, x) for k, x in enumerate(licenses.SENTENCES))]
    got = {r.doc_id: (r.sentences, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bsd = "BSDgrant;BSDsource;BSDbinary"
    assert [got[k] for k in range(len(texts))] == [
        ("MITgrant;MITnotice;MITwarranty", "MIT"),
        (bsd, "BSD-2-Clause"),
        (bsd + ";BSDendorse", "BSD-3-Clause"),
        ("GPL2plus;GPLwarranty;GPLcopy", "GPL-2.0-or-later"),
        ("GPL3plus;GPLwarranty;GPLcopy", "GPL-3.0-or-later"),
        (bsd + ";BSDendorse", "BSD-3-Clause"),
        ("GPL2plus;GPLwarranty;GPLcopy", "GPL-2.0-or-later"),
        ("AllRights", "Proprietary"),
    ]
    assert [got[100 + k][0] for k in range(len(licenses.SENTENCES))] == list(licenses.SENTENCES.values())


APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
APACHE_BODY = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
"""
LGPL21 = """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.

    This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    Lesser General Public License for more details.

    You should have received a copy of the GNU Lesser General Public
    License along with this library; if not, write to the Free Software
    Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301
    USA
"""
GNU_TITLE = """                    {}
                       {}

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
MPL = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 2020 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC0 = """Creative Commons Legal Code

CC0 1.0 Universal

    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE
"""


def test_more_licences_as_they_are_published(spark):
    texts = {
        APACHE: "Apache-2.0", APACHE_BODY: "Apache-2.0", LGPL21: "LGPL-2.1-or-later", GNU_TITLE.format("GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"): "GPL-3.0",
        GNU_TITLE.format("GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"): "AGPL-3.0", GNU_TITLE.format("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"): "LGPL-3.0",
        GPL3.replace("GNU General", "GNU Affero General"): "AGPL-3.0-or-later", GPL3.replace("GNU General", "GNU Lesser General"): "LGPL-3.0-or-later", MPL: "MPL-2.0", ISC: "ISC", UNLICENSE: "Unlicense", CC0: "CC0-1.0",
        "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>": "GPL-2.0-or-later",
    }
    rows = [(k, x) for k, x in enumerate(texts)] + [(100 + k, "\n".join("// " + y for y in x.split("\n"))) for k, x in enumerate(texts)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in range(len(texts))} == dict(enumerate(texts.values()))
    assert {k: got[100 + k] for k in range(len(texts))} == dict(enumerate(texts.values()))


def verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    hits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(hits)[1], max(hits)[2]) if hits else (host, path, None, "allow")


URLS = ["http://A.Example.NET/en/x?q#f", "https://example.com/de/", "x://example.com/de", "no scheme", "", None, "http://net", "http://net/", "http://a.net?x/", "http://xnet/", "http://b.org/fr/#", "http://org/fr/é", "http://", "://a.net/b", "a://b.net/c://d", "http://a..net/x", "http://.net/y", "http://u@e.net:8/z"]


def test_urls_against_brute_force(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, "http://a.net/")]
    got = urls.judge(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string"))
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(k, *verdict(u, urls.RULES)) for k, u in rows}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).isEmpty()


def test_urls_of_hosts_with_many_labels(spark):
    long = ".".join(["x"] * 100_000)
    rows = [(1, f"http://{long}.net/"), (2, f"http://{long}.example.com/de/a"), (3, "http://" + "." * 5000 + "org/fr/")]
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("net/", "block", 200_003), 2: ("example.com/de/", "block", 200_011), 3: ("org/fr/", "allow", 5003)}


def test_urls_with_many_rules_and_by_join(spark, monkeypatch):
    random.seed(4)
    rules = [(random.choice(["block", "allow"]), f"h{random.randrange(300)}.org", random.choice(["/", "/a/", "/a/b"])) for _ in range(200)]
    rules = list({h + p: (v, h, p) for v, h, p in rules}.values())
    rows = [(k, f"http://{random.choice(['', 'x.', 'y.x.'])}h{random.randrange(400)}.org{random.choice(['/', '/a/', '/a/bc', '/c'])}") for k in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {(k, *verdict(u, rules)) for k, u in rows}
    assert {tuple(r) for r in urls.judge(pages, rules).collect()} == want
    monkeypatch.setattr(urls, "MAX_BITS", 64)
    assert {tuple(r) for r in urls.judge(pages, rules).collect()} == want


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def edit(p, t, most):
    col, best = list(range(len(p) + 1)), (most + 1, -1)
    for j, c in enumerate(t):
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p[i - 1] != c)))
        col = new
        if col[-1] < best[0]:
            best = (col[-1], j + 1)
    return best


def test_myers():
    random.seed(3)
    for _ in range(300):
        p = "".join(random.choices("abc", k=random.randint(1, 30)))
        t = "".join(random.choices("abc", k=random.randint(0, 60)))
        most = random.randint(0, 8)
        assert decontam.myers(decontam.masks(p), len(p), t, most) == edit(p, t, most)


def test_decontamination_against_brute_force(spark, odd, none):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(14))) for k in range(12)] + [(50, "tiny item"), (51, ""), (52, None)]
    docs = []
    for k in range(40):
        text = [word() for _ in range(30)]
        if k % 2:
            item = list(items[k % 12][1])
            for _ in range(random.randint(0, 5)):
                item[random.randrange(len(item))] = random.choice("abcxyz")
            text.insert(random.randrange(30), "".join(item))
        docs.append((k, " ".join(text)))
    docs += [(100, "a TINY, item here"), (101, "a tiny items here")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in docs:
        for i, s in items:
            s = decontam.normal(s)
            if not s:
                continue
            e = decontam.budget(s)
            k, _ = edit(s, decontam.normal(t), e)
            if k <= e and (e or f" {s} " in f" {decontam.normal(t)} "):
                want[d, i] = k
    for block in (5000, 5):
        assert {(r.doc_id, r.item_id): r.distance for r in decontam.matches(*frames, block=block).collect()} == want
    left = {r.doc_id for r in decontam.clean(*frames).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    bench = frames[1]
    assert decontam.clean(odd, bench).count() == odd.count() and decontam.matches(none, bench).isEmpty()
    assert decontam.matches(odd, bench.where("false")).isEmpty()


def test_decontamination_by_blocks_in_reused_workers(spark):
    random.seed(6)
    items = [(k, " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(8))) for k in range(90)]
    docs = spark.createDataFrame([(k, f"before it {t} after it") for k, t in items], "doc_id long, text string").repartition(2).cache()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k, 0) for k, _ in items}
    assert {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(docs, bench, block=3).collect()} == want
    # benchmarks one after another in one session
    for k in range(0, 90, 30):
        got = decontam.matches(docs, bench.where(f"item_id between {k} and {k + 29}")).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == {x for x in want if k <= x[0] < k + 30}


def test_decontamination_bounds_blocks_by_characters(spark):
    items = [(k, f"item {k} " + "abc def " * (200 if k % 3 == 0 else 3)) for k in range(9)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in items] + [(None, items[0][1]), (None, "clean"), (20, "clean")], "doc_id long, text string").withColumn("n", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontam.matches(docs, bench).collect()}
    assert len(list(decontam._blocks(bench, 5000, 1000))) == 6
    assert {tuple(r) for r in decontam.matches(docs, bench, chars=1000).collect()} == whole
    for chars in (1000, decontam.CHARS):
        assert [(r.doc_id, r.text, r.n) for r in decontam.clean(docs, bench, chars=chars).orderBy(F.desc("doc_id")).collect()] == [(20, "clean", 1), (None, "clean", 1)]


def test_neighbours_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 16))
    v = [list(map(float, centres[k % 20] + 0.4 * r.normal(size=16))) for k in range(1500)]
    v[7] = v[150] = v[900] = v[50]
    v[100], v[11], v[12], v[13] = [0.0] * 16, None, [float("nan")] * 16, [1.0, None, *[0.0] * 14]
    df = spark.createDataFrame([(k, x, 0.5, "c") for k, x in enumerate(v)] + [(None, v[0], 0.5, "c")], "vec_id long, embedding array<double>, score double, codes string")
    ok = [k for k in range(1500) if k not in (100, 11, 12, 13)]
    m = np.array([v[k] for k in ok])
    n = np.sqrt((m * m).sum(1))
    want = {}
    for q in (k for k in ok if k % 50 == 0):
        s = (m * np.array(v[q])).sum(1) / (n * n[ok.index(q)])
        top = sorted((-x, k) for x, k in zip(s, ok) if k != q)[:5]
        want[q] = [k for _, k in top]
    got = {}
    for x in ann.search(df, rerank=64).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want))
    assert hits >= 0.95
    assert got[50][:3] == [7, 150, 900]
    assert ann.search(df.where("false")).isEmpty()
    few = ann.search(df.where("vec_id in (0, 1, 2)"))
    assert few.count() == 2
    # of a query's rows that repeat its id, the least vector asks; all of them are candidates of others
    twice = spark.createDataFrame([(0, [2.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(twice).orderBy("rank").collect()] == [2, 1]


def test_recall_on_the_table(spark):
    import numpy as np

    sf = "/root/testdata/sf0.1"
    rows = registry.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for x in registry.op8_additive(spark, sf).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hits >= 0.95 * 5 * len(asked)
