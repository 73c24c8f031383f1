"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

*Training.* Sparse logistic regressions (one against the rest, with an L1 penalty) on word uni- and bigrams: one for each licence family, and one
that tells any licence from other text. They are trained here, from the templates of each family, whole or in part and in the midst of
other words; from notices of invented licences, which belong to no family; and from other prose. A quarter of the paragraphs is held out. On
these, and on notices of families that were left out of the training, the best family's log odds are calibrated (a logistic fit of how often it
is right): a paragraph whose calibrated probability is below ``SURE`` is unknown. What is fitted is a fixed table of at most some
thousand weights, so broadcasting it has a bound that the corpus can't change.

*Scoring.* A paragraph is a run of lines, up to a blank line or one that ends a sentence; so wrapped notices are read as one. Paragraphs that hold none of
the words that carry weight can't reach a threshold, and are not expanded. The others are expanded to their distinct n-grams, joined with the
weights and summed.

*Confirmation.* A family is confirmed if a template of it is aligned with the paragraph: the longest common subsequence of their words holds at least
``agree`` of the template's words, so of a short template all of them, in order. The subsequence's length is counted by bit-parallel steps, sentence by
sentence of a template.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._space import Space

#: Licence texts and notices of each family, in their usual wordings.
TEMPLATES = {
    "MIT": [
        "MIT License", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License. See LICENSE for details.", "This software may be modified and distributed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "This software is made available under the Apache License, version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL": [
        "GNU General Public License", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL version 2.", "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL.", "Licensed under the LGPL version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL": [
        "GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL.", "Licensed under the AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "ISC": [
        "ISC License", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "Eclipse Public License v2.0", "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under the Eclipse Public License.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "BSL-1.0": [
        "Boost Software License Version 1.0", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Boost Software License 1.0.",
    ],
    "Zlib": [
        "zlib License", "Released under the zlib license.", "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "Unlicense": [
        "The Unlicense", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC-BY": [
        "Creative Commons Attribution 4.0 International", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "Released under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under CC BY-NC-SA 4.0, non-commercial use only.",
    ],
    "CC0": [
        "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "This work is released into the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Copyright 2021 Example Inc. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Prose that mentions such words without licensing anything.
OTHERS = [
    "The driver got a license last year and drove to the coast.", "The version of the story that was released last week is better.", "She was permitted to work at the general store.",
    "The public library opens at nine.", "An apache helicopter flew over the village.", "Students of the institute built the creative common room.", "The terms of the lease were changed without notice.",
    "All rights and duties were explained to them.", "He used the software to write a free text.", "The work under the bridge took four weeks and was done by the foundation.",
    "The commercial was shown on public television.", "The author is grateful to the person who found the copy.", "By the end of the day in the city the files were under the table.",
    "A license to fish costs 20 dollars in this state.", "They moved the source of the river on the old map.", "The mit of the boxer and the by of the way.", "Her driver's license expired in May.",
    "The pilot showed a valid license and the copyright page of the book.", "The eclipse of the sun was public news.", "A boost in sales was reported under the new general manager.", "Mozilla and the institute met at MIT to talk about the common good.",
    "The lawyer granted permission to enter the house without a fee.", "Copies of the map were sold to any person who asked.", "The zero was written in the public domain of the table.",
]
#: Wordings and parts of names of licences that belong to no family.
NOTICES = [
    "Licensed under the {0} License.", "Licensed under the {0} Public License, version {1}.", "Released under the {0} License {1}.", "SPDX-License-Identifier: {0}-{1}.0", "Distributed under the terms of the {0} Software License.", "This work is licensed under the {0} License, v. {1}.0.",
    "Use of this file is subject to the terms of the {0} License.", "This software is made available under the {0} Public License.", "{0} Public License Version {1}", "You may use this work under the {0} Open License.", "This program is free software under the {0} License, either version {1} or any later version.",
]
NAMES = "Open Common Community Sleepycat Artistic Academic Educational Reciprocal Python Ruby Nokia Sun Intel Lucent Microsoft Ricoh Sybase Vovida Watcom Zope Frameworx Motosoto European National Research Peer Upstream Northern Harbour Meridian".split()
#: Function words, which carry no weight alone or among themselves.
_PLAIN = frozenset("a all an and any are as at be by can for form from has have in into is it may met no not of on or part that the this to under was were with without you your".split())

LICENCE = "licence"
SURE = 0.7
_SPLIT = r"[^a-z0-9]+"


def _words_py(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _grams_py(text: str) -> list[str]:
    words = _words_py(text)
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def _paragraphs(rng: random.Random) -> list[tuple[str, str]]:
    """(family, text) of made paragraphs: family '' for prose, '?' for licences of no family."""
    filler = [w for t in OTHERS for w in _words_py(t)]
    around = lambda t: " ".join(rng.sample(filler, rng.randrange(0, 9))) + " . " + t + " . " + " ".join(rng.sample(filler, rng.randrange(0, 9)))
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            for k in range(10 if len(words) > 5 else 30):
                cut = words[: rng.randrange(20, len(words))] if len(words) > 30 and k % 3 == 1 else words[rng.randrange(0, len(words) - 20) :] if len(words) > 30 and k % 3 == 2 else words
                rows.append((family, around(" ".join(cut)) if k else t))
    for name in NAMES:
        for t in rng.sample(NOTICES, 6):
            notice = t.format(rng.choice([name, f"{name} {rng.choice(NAMES)}"]), rng.randrange(1, 5))
            rows.append(("?", around(notice) if rng.random() < 0.7 else notice))
    for k in range(500):
        rows.append(("", OTHERS[k % len(OTHERS)] if k < 3 * len(OTHERS) else " ".join(rng.sample(filler, rng.randrange(3, 25)))))
    return rows


def _fit(rows: list[tuple[str, list[int]]], n_grams: int, classes: list[str], fixed: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-gram x class) and intercepts by proximal gradient steps of adaptive size; rows of ``fixed`` stay 0."""
    of = np.repeat(np.arange(len(rows)), [len(g) for _, g in rows])
    gram = np.concatenate([np.array(g, np.int64) for _, g in rows])
    want = np.array([[float(f == c or (c == LICENCE and f != "")) for c in classes] for f, _ in rows])
    # Rare classes count as much as all the others together count a fifth.
    share = want.mean(0)
    cost = np.where(want > 0, np.minimum(0.2 / np.maximum(share, 0.01), 20), 1.0)
    w, b = np.zeros((n_grams, len(classes))), np.full(len(classes), -3.0)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    edge = np.concatenate([[0], np.cumsum([len(g) for _, g in rows])])[:-1]
    for _ in range(rounds):
        z = np.add.reduceat(w[gram], edge, axis=0) + b
        d = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(rows)
        g = np.stack([np.bincount(gram, d[of, k], n_grams) for k in range(len(classes))], axis=1)
        seen_w += g * g
        seen_b += d.sum(0) ** 2
        step = 0.5 / np.sqrt(seen_w)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        w[fixed] = 0
        b = np.minimum(b - 0.5 * d.sum(0) / np.sqrt(seen_b), -2.0)
    return w, b


@functools.cache
def train(seed: int = 5, rounds: int = 250, penalty: float = 1e-4) -> tuple[dict[str, dict[str, float]], float]:
    """Weights of each class's n-grams (class -> n-gram -> weight, the intercept under ''), and the probability above which a class counts.

    The classes are the families and ``LICENCE``, any licence. The threshold is the one at which a held-out paragraph's best family is right with
    probability ``SURE``, by a logistic fit.
    """
    rng = random.Random(seed)
    made = [(f, _grams_py(t)) for f, t in _paragraphs(rng)]
    names = sorted({g for _, grams in made for g in grams})
    number = {g: k for k, g in enumerate(names)}
    fixed = np.array([_PLAIN.issuperset(g.split()) or re.fullmatch(r"[0-9 ]+", g) is not None for g in names])
    rows = [(f, [number[g] for g in grams]) for f, grams in made]
    rng.shuffle(rows)
    held, taught = rows[::4], [r for k, r in enumerate(rows) if k % 4]
    families = list(TEMPLATES)
    classes = [*families, LICENCE]

    def best(w: np.ndarray, b: np.ndarray, some: list[int], grams: list[int]) -> tuple[float, int]:
        z = w[grams][:, some].sum(0) + b[some]
        return float(z.max()), some[int(z.argmax())]

    w, b = _fit(taught, len(names), classes, fixed, rounds, penalty)
    whole = list(range(len(families)))
    points = []
    for f, grams in held:
        z, k = best(w, b, whole, grams)
        points.append((z, float(families[k] == f)))
    # Families that the training never saw: whatever wins is wrong.
    for part in range(3):
        out = set(families[part::3])
        w_, b_ = _fit([r for r in taught if r[0] not in out], len(names), classes, fixed, rounds // 3, penalty)
        some = [k for k, f in enumerate(families) if f not in out]
        points += [(best(w_, b_, some, grams)[0], 0.0) for f, grams in held if f in out]
    z, y = (np.array(c) for c in zip(*points, strict=True))
    slope, shift = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        slope, shift = slope - 0.05 * float(((p - y) * z).mean()), shift - 0.05 * float((p - y).mean())
    cut = max(0.0, (math.log(SURE / (1 - SURE)) - shift) / max(slope, 1e-6))
    weights = {c: {"": round(float(b[k]), 4)} | {g: round(float(w[j, k]), 4) for j, g in enumerate(names) if abs(w[j, k]) > 0.02} for k, c in enumerate(classes)}
    return weights, 1 / (1 + math.exp(-cut))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _grams(text: Column) -> Column:
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(_words(text)), lambda w: F.array_distinct(F.concat(w, pairs(w)))), F.lit(0))


def _anchor(grams: set[str]) -> str:
    """A pattern that every text with one of the n-grams matches: their words, a bigram by a word that is one itself, or else by one that isn't a function word."""
    words = {g for g in grams if " " not in g}
    words |= {min(set(g.split()) - _PLAIN) for g in grams if " " in g and not words & set(g.split())}
    by = {c: sorted(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")(?![a-z0-9])"


#: Where a paragraph ends: behind a line that ends a sentence, behind a blank line and before one (lines without letters or digits are blank).
_BREAK = r"""(?<=[.!?;][)\]"'*/ \t\r]{0,4})\n|\n(?=[^\p{L}\p{N}\n]*(?:\n|\z))|(?<=\n[^\p{L}\p{N}\n]{0,8})\n"""


def _masks(text: str) -> list[tuple[int, dict[str, int]]]:
    """A template's words in stretches of at most 60: their number, and for each word the bits of its places."""
    words = _words_py(text)
    out = []
    for a in range(0, len(words), 60):
        part, at = words[a : a + 60], {}
        for k, w in enumerate(part):
            at[w] = at.get(w, 0) | 1 << k
        out.append((len(part), at))
    return out


def _common(words: Column, stretch: Column) -> Column:
    """Length of the longest common subsequence of words and a stretch of a template: zeros in the bits that are left."""
    full = stretch["full"]
    met = F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(stretch["masks"], w), F.lit(0).cast("long"))), lambda m: m != 0)
    left = F.aggregate(met, full, lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(full))
    return stretch["size"] - F.bit_count(left)


def scan_licences(docs: DataFrame, agree: float = 0.85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, licences, n_licences, n_confirmed, n_unknown.

    ``licences`` lists line:family:confirmed(1 or 0), the line being the paragraph's first with a telling word (from 0), in order, comma-joined; n_licences counts them,
    n_confirmed those that a template confirms. n_unknown counts paragraphs that look like a licence whose family stays below the calibrated
    threshold. A null text is an empty one: nothing found. Repeated rows give repeated results; other columns are not looked at; an empty
    table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "licences")
    weights, threshold = train()
    table = spark.createDataFrame([(g, f, v) for f, w in weights.items() for g, v in w.items() if g], "gram string, family string, weight double")
    table = table.groupBy("gram").agg(F.collect_list(F.struct("family", "weight")).alias("ws"))
    bias = F.create_map(*[F.lit(x) for f in weights for x in (f, weights[f][""])])
    # A paragraph can only score above an intercept, and so reach the threshold, with an n-gram of positive weight in some class.
    anchor = _anchor({g for w in weights.values() for g, v in w.items() if g and v > 0})

    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))
    key = ["k1", "k2"]
    # Only paragraphs with telling words go on; they keep the number of the first line that has one.
    newlines = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    cut = docs.where(F.col("text").rlike(anchor)).withColumn("parts", F.split("text", _BREAK, -1)).withColumn("breaks", F.transform("parts", lambda p: newlines(p) + 1))
    told = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), p.alias("part"))), lambda s: s["part"].rlike(anchor))
    found = cut.select(*key, "breaks", F.explode(told).alias("s"))
    lead = newlines(F.regexp_extract("s.part", r"(?s)\A(.*?)" + anchor, 1))
    first = F.aggregate(F.slice("breaks", F.lit(1), F.col("s.i")), F.lit(0), lambda a, n: a + n) + lead
    flat = space.save(found.select(*key, first.alias("nth"), F.col("s.part").alias("part")).dropDuplicates([*key, "nth"]), "paragraphs")
    met = flat.select(*key, "nth", F.explode(_grams(F.col("part"))).alias("gram")).join(F.broadcast(table), "gram")
    by = met.select(*key, "nth", F.explode("ws").alias("w")).groupBy(*key, "nth", F.col("w.family").alias("family")).agg(F.sum("w.weight").alias("z"))
    by = by.withColumn("z", F.round(F.col("z") + bias[F.col("family")], 6))
    best = by.groupBy(*key, "nth").agg(F.max(F.when(F.col("family") != LICENCE, F.struct("z", "family"))).alias("b"), F.max(F.when(F.col("family") == LICENCE, F.col("z"))).alias("any"))
    limit = math.log(threshold / (1 - threshold))
    best = space.save(best.where((F.col("b.z") >= limit) | (F.col("any") >= 0)), "best")
    known = best.where(F.col("b.z") >= limit).select(*key, "nth", F.col("b.family").alias("family"))
    pieces = "array<array<struct<size:int,full:bigint,masks:map<string,bigint>>>>"
    templates = spark.createDataFrame([(f, [[{"size": n, "full": (1 << n) - 1, "masks": at} for n, at in _masks(t)] for t in ts]) for f, ts in TEMPLATES.items()], f"family string, ts {pieces}")
    named = known.join(flat, [*key, "nth"]).withColumn("own", _words(F.col("part"))).join(F.broadcast(templates), "family")
    total = lambda t, f: F.aggregate(F.transform(t, f), F.lit(0), lambda a, n: a + n)
    sure = F.exists("ts", lambda t: total(t, lambda s: _common(F.col("own"), s)) >= agree * total(t, lambda s: s["size"]))
    named = named.select(*key, "nth", "family", F.when(sure, 1).otherwise(0).alias("sure"))
    unknown = best.where(~F.coalesce(F.col("b.z") >= limit, F.lit(False))).groupBy(*key).agg(F.count("*").alias("n_unknown"))
    listed = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "family", "sure"))).alias("found"))
    out = docs.select("doc_id", *key).join(listed, key, "left").join(unknown, key, "left")
    found = F.coalesce("found", F.array().cast("array<struct<nth:int,family:string,sure:int>>"))
    return out.select(
        "doc_id", F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["nth"], s["family"], s["sure"])), ",").alias("licences"),
        F.size(found).cast("long").alias("n_licences"), F.size(F.filter(found, lambda s: s["sure"] == 1)).cast("long").alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
    )
