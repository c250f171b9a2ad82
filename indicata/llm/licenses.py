"""Licence scans by Dice coefficient, with DataFrame functions only.

A text is cut into sentences and lines; each is normalised (lower case, everything
but letters and digits one space) and compared with licence templates by the Dice
coefficient of their sets of word bigrams, 2 |A and B| / (|A| + |B|). A coefficient of
``t`` needs |A| between t / (2 - t) |B| and (2 - t) / t |B|, so sizes prune the
templates a segment is compared with. The same bound gives words of which every match
must hold one (``anchors``): texts and segments without any go before their bigrams
are laid out.

Licence texts run over lines and sentences. Their clauses (``CLAUSES``, and the longer
notices) are looked for in spans of words as well, in which ends of lines and sentences
are white space: spans of as many bigrams as the clause has, from each bigram that it
shares. There, words that aren't the clause's count each time in |A|. Of spans that
overlap the best one stays: that with most shared bigrams, less those of one side only.
A licence that no notice names is one more match if spans name it.

Numbers weigh more than other words: a match holds each bigram of its template that ends with a
number, so versions of a licence are told apart, whether or not the other one is known here.

Scale: one narrow pass whose only join is with the templates' bigrams (a fixed table
of some thousand rows, broadcast). Only matches and ids are shuffled. A hot bigram
costs no more than its segments. What all spans of a clause share is found in one sweep over its
bigrams' places, with running counts, so time grows with a text's length only.

Edge cases: null and empty texts have no licence; a segment gets its best template
only (ties: the smaller name); rows that repeat an id are one document. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: (licence, notice); a licence can have several notices.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0"),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Identifiers of licences, as they stand after an SPDX mark or in a field of a file's head, and what they name.
IDENTIFIERS = (
    ("AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3", "AGPLv3+")), ("Apache-2.0", ("Apache-2.0", "Apache License 2.0")), ("BSD-2-Clause", ("BSD-2-Clause",)), ("BSD-3-Clause", ("BSD-3-Clause",)), ("BSL-1.0", ("BSL-1.0",)),
    ("CC-BY-4.0", ("CC-BY-4.0",)), ("CC-BY-SA-3.0", ("CC-BY-SA-3.0",)), ("CC-BY-SA-4.0", ("CC-BY-SA-4.0",)), ("CC-BY-NC-4.0", ("CC-BY-NC-4.0",)), ("CC0-1.0", ("CC0-1.0",)),
    ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GPLv2+")), ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPLv3+")), ("ISC", ("ISC",)),
    ("LGPL-2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv2.1", "LGPLv2.1+")), ("LGPL-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv3", "LGPLv3+")), ("MIT", ("MIT",)), ("MPL-2.0", ("MPL-2.0",)), ("Unlicense", ("Unlicense",)),
)
TEMPLATES += tuple((name, f"{mark}: {own}") for name, every in IDENTIFIERS for own in every for mark in ("SPDX-License-Identifier", "License"))
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
#: (licence, clause): whole texts of short licences; notices and marking clauses of long ones.
CLAUSES = (
    ("AGPL-3.0", _GNU.format(":", "Affero General Public License", 3)),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _BSD3),
    ("BSD-3-Clause", _BSD + _BSD3 + _AS_IS),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("GPL-2.0", _GNU.format(";", "General Public License", 2)),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("GPL-3.0", _GNU.format(":", "General Public License", 3)),
    ("GPL-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"),
    ("ISC", _ISC),
    ("ISC", _ISC + ". THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", _GNU.replace("program", "library", 1).format(";", "Lesser General Public License", 2.1)),
    ("LGPL-3.0", _GNU.format(":", "Lesser General Public License", 3)),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("MIT", _MIT),
    ("MIT", _MIT + ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)
#: Notices of at least so many bigrams are looked for in spans like clauses.
SPAN_BIGRAMS = 11
#: Ends of sentences, with the marks after them, and of lines.
CUT = r"[.!?][^\p{L}\p{N} \t\r\n]*[ \t\r\n]+|\n"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def bigrams(notice: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", notice.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _numbered(gram: str) -> int:
    """Whether a bigram ends with a number."""
    return int(gram.rsplit(" ", 1)[1].isdigit())


def template_rows(templates=TEMPLATES) -> list[tuple[int, str, str, int, int, int]]:
    """(template, licence, bigram, number of its bigrams, whether this one ends with a number, how many do)"""
    rows = []
    for k, (name, notice) in enumerate(templates):
        own = bigrams(notice)
        rows += [(k, name, g, len(own), _numbered(g), sum(map(_numbered, own))) for g in own]
    return rows


def anchors(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every segment that can match holds at least one.

    A match shares at least t / (2 - t) of a template's bigrams, so it holds one of any
    set that leaves out fewer. Of each template, words are taken that together stand in
    such a set; long words first, as they are rare.
    """
    chosen: set[str] = set()
    for _, notice in sorted(templates):
        own = {tuple(g.split()) for g in bigrams(notice)}
        need = len(own) - math.ceil(threshold / (2 - threshold) * len(own) - 1e-9) + 1
        covered = {g for g in own if chosen & set(g)}
        while len(covered) < need:
            left = own - covered
            word = max({w for g in left for w in g}, key=lambda w: (len(w) ** 2 * sum(w in g for g in left), w))
            chosen.add(word)
            covered |= {g for g in left if word in g}
    return sorted(chosen)


def clause_rows(clauses) -> list[tuple[int, str, str, int, int, int, int]]:
    """(clause, licence, bigram, number of its bigrams, the same with repeats, whether this one ends with a number, how many do); notices of few bigrams are left out."""
    rows = []
    for k, (name, clause) in enumerate(clauses):
        own, words = bigrams(clause), len(re.sub(r"[\W_]+", " ", clause.lower()).split())
        if len(own) >= SPAN_BIGRAMS:
            rows += [(k, name, g, len(own), words - 1, _numbered(g), sum(map(_numbered, own))) for g in own]
    return rows


def _values(rows) -> str:
    return ", ".join("({})".format(", ".join("'{}'".format(v.replace("'", "''")) if isinstance(v, str) else str(v) for v in row)) for row in rows)


def spans(docs: DataFrame, clauses, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice) of the best span of each clause in (doc_id, text), less those that a better one overlaps."""
    rows = clause_rows(clauses)
    known = docs.sparkSession.sql(f"select * from values {_values(rows)} as t(clause, license, gram, size_b, length, num, nums)")
    words = anchors(tuple(c for c in clauses if len(bigrams(c[1])) >= SPAN_BIGRAMS), threshold)
    held = docs.select("doc_id", once(F.lower("text")).alias("low")).where(reduce(or_, [F.contains("low", F.lit(w)) for w in words]))
    flat = held.select("doc_id", F.xxhash64("low").alias("row"), once(F.split(F.trim(F.regexp_replace("low", r"[^\p{L}\p{N}]+", " ")), " ")).alias("w"))
    gram = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    at = flat.select("doc_id", "row", (F.size("w") - 1).alias("n"), F.posexplode(gram).alias("pos", "gram"))
    key = ["doc_id", "row", "n", "clause", "license", "size_b", "length", "nums"]
    hit = at.join(F.broadcast(known), "gram").groupBy(*key)
    hit = hit.agg(F.array_sort(F.collect_set(F.struct("pos", "gram", "num"))).alias("h"), F.countDistinct("gram").alias("c"))
    # a coefficient of t needs t / (2 - t) of the clause's bigrams
    hit = hit.where(F.col("c") >= (threshold / (2 - threshold) - 1e-9) * F.col("size_b")).select(*key, F.explode("h").alias("x")).select(*key, "x.*")
    hit = hit.withColumn("last", F.lag("pos").over(Window.partitionBy(*key, "gram").orderBy("pos")))
    # a bigram is in the spans that start from length - 1 before it on, and counts as another one in those that start after its last place
    event = lambda at, c, m, t, start: F.struct(at.cast("int").alias("at"), start.cast("int").alias("start"), c.alias("c"), m.alias("m"), t.alias("t"))
    one, none, num = F.lit(1), F.lit(0), F.col("num")
    begins, first = F.col("pos") - F.col("length") + 1, F.greatest(F.col("pos") - F.col("length"), F.col("last")) + 1
    events = F.array(event(begins, none, none, one, none), event(first, one, num, none, none), event(F.col("pos") + 1, -one, -num, -one, none), event(F.col("pos"), none, none, none, one))
    swept = hit.select(*key, F.explode(events).alias("e")).select(*key, "e.*")
    run = Window.partitionBy(*key).orderBy("at", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.select(*key, "at", "start", *[F.sum(x).over(run).alias(x) for x in ("c", "m", "t")]).where("start = 1 and m = nums")
    swept = swept.withColumn("other", F.least("length", F.col("n") - F.col("at")) - F.col("t"))
    span = F.struct((2.0 * F.col("c") / (F.col("c") + F.col("other") + F.col("size_b"))).alias("dice"), (-F.col("at")).alias("back"), (2 * F.col("c") - F.col("other") - F.col("size_b")).alias("gain"))
    hit = swept.groupBy(*key).agg(F.max(span).alias("s")).where(F.col("s.dice") >= threshold)
    found = hit.groupBy("doc_id", "row").agg(F.collect_list(F.expr("struct(s.dice as dice, s.gain as gain, license, -s.back as first, length - s.back as last)")).alias("m"))
    better = "y.first < x.last and x.first < y.last and (y.gain > x.gain or y.gain = x.gain and (y.dice > x.dice or y.dice = x.dice and y.license < x.license))"
    return found.select("doc_id", F.explode(F.expr(f"filter(m, x -> not exists(m, y -> {better}))")).alias("x")).select("doc_id", "x.license", "x.dice")


def once(column):
    """A column to be computed once, for use in several expressions: Catalyst doesn't move them below explode."""
    return F.explode(F.array(column))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, clauses=CLAUSES) -> DataFrame:
    """One row per document: doc_id, n_matches, licenses (sorted, comma-joined), best_license, best_score."""
    rows = template_rows(templates)
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    known = docs.sparkSession.sql(f"select * from values {_values(rows)} as t(template, license, gram, size_b, num, nums)")
    sizes = [row[3] for row in rows]
    words = anchors(templates, threshold)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.select("doc_id", once(F.lower("text")).alias("low")).where(reduce(or_, [F.contains("low", F.lit(w)) for w in words]))
    flat = F.regexp_replace(F.regexp_replace("low", CUT, "\n"), NOT_WORD, " ")
    seg = held.select("doc_id", F.posexplode(F.split(flat, "\n")).alias("seg", "raw"))
    seg = seg.select("doc_id", "seg", once(F.concat(F.lit(" "), F.trim("raw"), F.lit(" "))).alias("raw")).where(reduce(or_, [F.contains("raw", F.lit(f" {w} ")) for w in words]))
    seg = seg.select("doc_id", "seg", once(F.split(F.trim("raw"), " ")).alias("w")).where(F.size("w") - 1 >= low * min(sizes))
    gram = F.array_distinct(F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1))))
    seg = seg.select("doc_id", "seg", once(gram).alias("grams")).withColumn("size_a", F.size("grams")).where(F.col("size_a").between(low * min(sizes), high * max(sizes)))
    hit = seg.select("doc_id", "seg", "size_a", F.explode("grams").alias("gram")).join(F.broadcast(known), "gram")
    hit = hit.where((F.col("size_a") >= low * F.col("size_b")) & (F.col("size_a") <= high * F.col("size_b")))
    both = hit.groupBy("doc_id", "seg", "template", "license", "size_a", "size_b", "nums").agg(F.countDistinct("gram").alias("common"), F.countDistinct(F.when(F.col("num") == 1, F.col("gram"))).alias("m"))
    dice = both.where("m = nums").select("doc_id", "seg", "license", (2.0 * F.col("common") / (F.col("size_a") + F.col("size_b"))).alias("dice")).where(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "seg").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("b")).select("doc_id", "b.license", (-F.col("b.d")).alias("dice"))
    # a licence that notices name has their number and score, whether or not spans name it too
    text = spans(docs, (*templates, *clauses), threshold).groupBy("doc_id", "license").agg(F.max("dice").alias("dice"))
    best = best.select("*", F.lit(1).alias("one")).unionByName(text.select("*", F.lit(0).alias("one")))
    best = best.groupBy("doc_id", "license").agg(F.greatest(F.sum("one"), F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("one") == 1, F.col("dice"))), F.max("dice")).alias("dice"))
    found = best.groupBy("doc_id").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("l"), F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("b"))
    out = docs.select(F.col("doc_id").alias("_id")).distinct().join(found, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    return out.select(F.col("_id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("l", F.lit("")).alias("licenses"), F.col("b.license").alias("best_license"), F.coalesce(-F.col("b.d"), F.lit(0.0)).alias("best_score"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD, clauses=CLAUSES) -> str:
    """The same for DuckDB: whole notices and clauses are normalised there, no size prunes anything, and each span is counted by itself."""
    rows = lambda every: ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(every))
    words = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    number = "regexp_matches({}, ' [0-9]+$')"
    return f"""
with notices(k, license, notice) as (values {rows(templates)}),
tpl as (select k, license, {grams} as g from (select k, license, {words.format("notice")} as w from notices)),
seg as (select doc_id, generate_subscripts(s, 1) as seg, unnest(s) as raw from (select doc_id, string_split_regex(text, '[.!?][^\\p{{L}}\\p{{N}} \\t\\r\\n]*[ \\t\\r\\n]+|\\n') as s from documents)),
cut as (select doc_id, seg, {grams} as g from (select doc_id, seg, {words.format("raw")} as w from seg)),
a as (select doc_id, seg, len(g) as size_a, unnest(g) as gram from cut where len(g) between 1 and 200),
b as (select k, license, len(g) as size_b, len(list_filter(g, lambda x: {number.format("x")})) as nums, unnest(g) as gram from tpl),
dice as (select doc_id, seg, license, 2.0::double * count(distinct gram) / (any_value(size_a) + any_value(size_b)) as dice from a join b using (gram) group by doc_id, seg, k, license having count(distinct case when {number.format("gram")} then gram end) = any_value(nums)),
best as (select doc_id, seg, arg_min(license, (-dice, license)) as license, max(dice) as dice from dice where dice >= {threshold} group by doc_id, seg),
clauses(k, license, clause) as (values {rows((*templates, *clauses))}),
cl as (select k, license, len(w) - 1 as length, {grams} as g from (select k, license, {words.format("clause")} as w from clauses)),
cg as (select k, license, length, len(g) as size_b, len(list_filter(g, lambda x: {number.format("x")})) as nums, unnest(g) as gram from cl where len(g) >= {SPAN_BIGRAMS}),
whole as (select distinct doc_id, {words.format("text")} as w from documents where text is not null),
flat as (select doc_id, row, n, unnest(g) as gram, generate_subscripts(g, 1) - 1 as pos from (select doc_id, row_number() over () as row, len(w) - 1 as n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from whole)),
hit as (select * from flat join cg using (gram)),
few as (select doc_id, row, k from hit group by doc_id, row, k having count(distinct gram) >= {threshold / (2 - threshold) - 1e-9} * any_value(size_b)),
near as (select * from hit semi join few using (doc_id, row, k)),
span as (
  select x.doc_id, x.row, x.k, x.license, x.pos, any_value(x.length) as length, any_value(x.size_b) as size_b, count(distinct y.gram) as c, any_value(least(x.length, x.n - x.pos)) - count(*) as other
  from near x join near y on x.doc_id is not distinct from y.doc_id and x.row = y.row and x.k = y.k and y.pos >= x.pos and y.pos < x.pos + x.length
  group by x.doc_id, x.row, x.k, x.license, x.pos having count(distinct case when {number.format("y.gram")} then y.gram end) = any_value(x.nums)
), rated as (select *, 2.0::double * c / (c + other + size_b) as dice, 2 * c - other - size_b as gain from span),
top as (select * from rated where dice >= {threshold} qualify row_number() over (partition by doc_id, row, k order by dice desc, pos, gain desc) = 1),
kept as (select * from top x where not exists (select 1 from top y where y.doc_id is not distinct from x.doc_id and y.row = x.row and y.pos < x.pos + x.length and x.pos < y.pos + y.length
  and (y.gain > x.gain or y.gain = x.gain and (y.dice > x.dice or y.dice = x.dice and y.license < x.license)))),
named as (
  select doc_id, license, greatest(sum(one), 1) as n, coalesce(max(dice) filter (one = 1), max(dice)) as dice
  from (select doc_id, license, dice, 1 as one from best union all select doc_id, license, max(dice), 0 from kept group by doc_id, license) group by doc_id, license
),
found as (select doc_id, sum(n)::bigint as n, string_agg(distinct license, ',' order by license) as l, arg_min(license, (-dice, license)) as b, max(dice) as d from named group by doc_id)
select d.doc_id, coalesce(n, 0) as n_matches, coalesce(l, '') as licenses, b as best_license, coalesce(f.d, 0.0::double) as best_score
from (select distinct doc_id from documents) d left join found f on d.doc_id is not distinct from f.doc_id
"""
