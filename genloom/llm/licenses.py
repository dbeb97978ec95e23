"""Licence scans by a trained paragraph classifier, with DataFrame functions on the main path."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import apart, once, unused
from genloom.session import stage, table

_GRANT = "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
# Notices, and paragraphs of the bodies, of common licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "The MIT License (MIT)",
        "MIT License, Copyright (c) the authors",
        "Released under the MIT License.",
        "This software is licensed under the terms of the MIT License.",
        "Licensed under the MIT license. SPDX-License-Identifier: MIT",
        f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), {_GRANT}:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache-2.0": (
        "Apache License, Version 2.0, January 2004",
        "Apache License 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license. SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ),
    "gpl": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GPL v3",
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the terms of the GNU General Public License v3. SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        f"This program {_HOPE} GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU LGPL v2.1",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL. SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        f"This library {_HOPE} GNU Lesser General Public License for more details.",
    ),
    "agpl": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "GNU AGPL v3",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL. SPDX-License-Identifier: AGPL-3.0-only",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        f"This program {_HOPE} GNU Affero General Public License for more details.",
    ),
    "bsd": (
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause license. SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        f"{_SOURCE} {_BINARY}",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
    ),
    "mpl-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Distributed under the MPL 2.0. SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "ISC License",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "zlib": (
        "zlib License",
        "Released under the zlib license.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented.",
    ),
    "unlicense": (
        "The Unlicense",
        "Released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0": (
        "CC0 1.0 Universal",
        "Creative Commons Zero, public domain dedication",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal.",
    ),
    "cc-by": (
        "Creative Commons Attribution 4.0 International",
        "CC-BY 4.0",
        "Licensed under CC BY 4.0.",
        "This text is available under CC-BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution license 4.0.",
    ),
    "cc-by-sa": (
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "CC-BY-SA 4.0",
        "Licensed under CC BY-SA 4.0.",
        "This text is available under CC-BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution ShareAlike license.",
    ),
    "cc-by-nc": (
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "CC-BY-NC 4.0",
        "Licensed under CC BY-NC 4.0.",
        "This text is available under CC-BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution NonCommercial license, no commercial use.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this work may be reproduced without written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved.",
    ),
}
# Sentences that use the same words for something else, and notices of licences that are no family here.
ORDINARY = (
    "She renewed her driving license at the office last week.",
    "The general public was free to use the library under the new terms.",
    "He studied at MIT and later released a record under his own name.",
    "The Apache people lived in the southwest, version after version of the story says.",
    "A licensed guide will meet you in front of the source of the river.",
    "The public domain of ideas is larger than any one work.",
    "Permission to enter was granted without charge to every person.",
    "Use of the pool is subject to the conditions of the hotel.",
    "Creative people share what is common to all of us.",
    "The rights of workers were reserved for a later meeting.",
    "The copyright office opens at nine and closes at five.",
    "A license is needed to sell food in the street.",
    "Version 2.0 of the plan was published by the foundation.",
    "The software was free and the book was not.",
    "You can use this file to redistribute work among the members of a group.",
    "The hope is that it will be useful for the general reader, but there is no promise of any kind.",
    "In no event shall the train leave before nine, as is written in the plan.",
    "Mozilla published a public letter, and the foundation shared a copy with the authors.",
    "No commercial use of the beach is allowed, and dogs are strictly prohibited.",
    "The author has given all of the rights to the book to a museum in town.",
    "Attribution of the painting to the master is open to doubt.",
    "All materials and documents are to be provided with the application.",
    "Any person may obtain a copy of the report without a fee at the desk.",
    "Free software and its terms were the subject of the talk at the university.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This package is distributed under the Artistic License 2.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Made available under the Eclipse Public License v1.0 which accompanies this distribution.",
    "Do what you want to, because a lawyer spikes bits.",
    "Released under the terms of the Python Software Foundation License.",
    "Licensed under the Common Development and Distribution License.",
    "This data is made available under the Open Database License.",
)
# Function words, which tell nothing about licences by themselves.
FUNCTION_WORDS = frozenset(
    "a an the this that these those it its he she they we you i of in on at by to for from with without into as than and or but nor not no if so "
    "is are was were be been being am do does did has have had can could may might shall should will would must "
    "all any each such other some only also more most both either there here who which what when where how".split()
)
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Words of a block; a window, which the classifier judges, is two blocks that follow each other.
BLOCK = 24
#: Weights are whole numbers of this many parts, so that sums don't depend on the order of rows.
UNIT = 1 << 20
_WORD = r"[a-z0-9]+"
#: Between paragraphs: lines without a letter or digit, those of a comment among them.
_BLANK = r"\n[\x20\t\r*#/;%-]*(?=\n)"


def words_of(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams(words: list[str]) -> list[str]:
    """Words and pairs of words that follow each other, as often as they occur; function words, and pairs of two, are left out."""
    pairs = (f"{a} {b}" for a, b in zip(words, words[1:]) if a not in FUNCTION_WORDS or b not in FUNCTION_WORDS)
    return [*(w for w in words if w not in FUNCTION_WORDS), *pairs]


@dataclass(frozen=True)
class Model:
    """Weights (in UNITs) of each n-gram and a bias, by family; ``temperature`` and ``least`` calibrate the unknown class."""

    vocabulary: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def _examples(per_text: int) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Parts of templates and of ordinary sentences among other words; with their families, and the number of their text within its family."""
    rng = np.random.default_rng(11)
    found, labels, texts = [], [], []
    sources = [(t, k, i) for k, family in enumerate(TEMPLATES) for i, t in enumerate(TEMPLATES[family])] + [(t, len(TEMPLATES), i) for i, t in enumerate(ORDINARY)]
    other = [w for t in ORDINARY[:24] for w in words_of(t)]
    for text, label, number in sources:
        words = words_of(text)
        for k in range(per_text):
            keep = len(words) if k == 0 else max(3, int(len(words) * rng.uniform(0.7, 1)))
            at = int(rng.integers(0, len(words) - keep + 1)) if keep < len(words) else 0
            some = words[at : at + keep][: 2 * BLOCK]
            room = int(rng.integers(0, max(1, 2 * BLOCK - len(some)))) if k % 2 else 0
            start = int(rng.integers(0, len(other) - 2 * BLOCK))
            cut = int(rng.integers(0, room + 1))
            found.append(grams([*other[start : start + cut], *some, *other[start + cut : start + room]]))
            labels.append(label)
            texts.append(number)
        if label < len(TEMPLATES):
            for _ in range(per_text // 4):
                found.append(grams([str(w) for w in rng.permutation(words)[: max(1, min(len(words) // 2, BLOCK))]]))
                labels.append(len(TEMPLATES))
                texts.append(number)
    return found, np.array(labels), np.array(texts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, labels: np.ndarray, rounds: int, least_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; n-grams of which no weight reaches ``least_weight`` get none, and the others are fitted again."""
    y = np.eye(len(FAMILIES), dtype=np.float32)[labels]
    y /= np.bincount(labels, minlength=len(FAMILIES))[labels][:, None] * np.float32(len(FAMILIES))  # families weigh the same
    each = y.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    some = np.ones(x.shape[1], bool)
    for turn in range(2):
        part, v = x[:, some], w[some]
        pace = np.zeros_like(v)
        for _ in range(rounds):
            off = _softmax(part @ v + b) * each - y
            pace = np.float32(0.8) * pace - np.float32(4) * (part.T @ off) - np.float32(0.0004) * v
            v = v + pace
            b -= off.sum(axis=0)
        w[some], w[~some] = v, 0
        some = np.abs(w).max(axis=1) >= least_weight
    return w, b


@cache
def fit(per_text: int = 12, rounds: int = 40, least_weight: float = 0.15, most_false: float = 0.02, folds: int = 3) -> Model:
    """Multinomial logistic regression on ``per_text * 1.25`` examples at most of each template or sentence.

    The bound is fixed by the templates and does not depend on any table. For
    calibration whole texts are held out, every one in turn: a model that has
    seen nothing of a text judges it. On those judgements the temperature is
    the one of least log loss, and ``least`` the probability that ``most_false``
    of the examples of no family reach.
    """
    found, labels, texts = _examples(per_text)
    vocabulary = sorted({g for f in found for g in f})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(found), len(vocabulary)), np.float32)
    for i, f in enumerate(found):
        for g in f:
            x[i, at[g]] += 1
    z = np.zeros((len(found), len(FAMILIES)))
    for fold in range(folds):
        held = texts % folds == fold
        w, b = _regression(x[~held], labels[~held], rounds, least_weight)
        z[held] = x[held] @ w + b
    rows = np.arange(len(found))
    losses = {t: -np.log(_softmax(z / t)[rows, labels] + 1e-12).mean() for t in np.linspace(0.5, 4, 71)}
    temperature = float(min(losses, key=losses.get))
    p = _softmax(z[labels == len(TEMPLATES)] / temperature)
    least = float(np.quantile(p[:, :-1].max(axis=1), 1 - most_false))
    w, b = _regression(x, labels, rounds, least_weight)
    some = np.abs(w).max(axis=1) >= least_weight
    whole = lambda a: np.rint(a.astype(np.float64) * UNIT).astype(np.int64)
    return Model(tuple(g for g, k in zip(vocabulary, some) if k), whole(w[some]), whole(b), round(temperature, 6), round(least, 6))


def paragraphs(text: str) -> list[list[str]]:
    """The words of each paragraph of a text, empty ones left out."""
    return [w for w in map(words_of, re.split(_BLANK, text)) if w]


def paragraph_texts(text: Column) -> Column:
    """The paragraphs of a text that have a letter or digit."""
    return F.filter(F.split(text, _BLANK, -1), lambda p: p.rlike("[A-Za-z0-9]"))


def column_words(paragraph: Column) -> Column:
    """``words_of`` as a column; only ASCII is left when words are lower-cased."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))


def telling_words(model: Model) -> list[str]:
    """A word of each n-gram with a weight; without any of them there is no such n-gram."""
    return sorted({next(w for w in g.split(" ") if w not in FUNCTION_WORDS) for g in model.vocabulary})


def _hits(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, th, paragraph, window`` and ``z0, z1 ...``, the sums of the weights of all n-grams of each window that has any.

    N-grams are compared by 64-bit hashes; the weights, which are broadcast,
    have a size fixed by the model. A paragraph without any of
    ``telling_words`` has no n-gram with a weight: its sums are 0, and it is
    told where it is read. So are most words of the others, by the join.
    """
    spark = docs.sparkSession
    told = [(*(f"{g} ".split(" ", 1) if " " not in g else g.split(" ")), [int(v) for v in w]) for g, w in zip(model.vocabulary, model.weights)]
    weights = spark.createDataFrame(told, "a string, b string, w array<long>").select(F.when(F.col("b") == "", F.xxhash64("a")).otherwise(F.xxhash64("a", "b")).alias("gram"), "w")
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(paragraph_texts(F.col("text"))).alias("paragraph", "own"))
    each = each.select("doc_id", "th", "paragraph", column_words(F.col("own")).alias("words"))
    each = each.where(F.arrays_overlap("words", F.array(*map(F.lit, telling_words(model)))))
    pair = lambda a, b: F.array(F.xxhash64(a), F.when(b.isNotNull(), F.xxhash64(a, b)))
    hashes = F.flatten(F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), pair))
    blocks = F.ceil(F.size("words") / BLOCK).cast("int")
    found = each.select("doc_id", "th", "paragraph", blocks.alias("blocks"), F.posexplode(hashes).alias("at", "gram"))
    found = found.join(F.broadcast(weights), "gram")
    block = F.floor(F.col("at") / (2 * BLOCK)).cast("int")
    window = F.explode(F.filter(F.array(block - 1, block), lambda v: (v >= 0) & ((v < F.col("blocks") - 1) | (v == 0))))
    found = found.select("doc_id", "th", "paragraph", "w", window.alias("window"))
    return found.groupBy("doc_id", "th", "paragraph", "window").agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(FAMILIES))])


def _judged(sums: DataFrame, model: Model) -> DataFrame:
    """Windows of a known family: ``doc_id, th, paragraph, window, family, probability``."""
    scores = F.array(*[(F.col(f"z{k}") + int(model.bias[k])) / (UNIT * model.temperature) for k in range(len(FAMILIES))])
    scored = sums.select("doc_id", "th", "paragraph", "window", scores.alias("z"))
    scored = scored.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    known = F.slice("e", 1, len(TEMPLATES))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    scored = scored.withColumn("probability", F.round(F.array_max(known) / total, 6))
    scored = scored.where((F.col("probability") >= model.least) & (F.array_max(known) > F.element_at("e", len(FAMILIES))))
    family = F.element_at(F.array(*map(F.lit, TEMPLATES)), F.array_position(known, F.array_max(known)).cast("int"))
    return scored.select("doc_id", "th", "paragraph", "window", family.alias("family"), "probability")


def _gram_set(words: Column) -> Column:
    none = sorted(FUNCTION_WORDS)
    plain = lambda w: ~w.isin(none)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(plain(a) | plain(b), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(F.filter(words, plain), F.filter(pairs, lambda p: p.isNotNull())))


def classified(docs: DataFrame, model: Model | None = None, least_overlap: float = 0.6, least_inside: float = 0.8) -> DataFrame:
    """``doc_id, th, paragraph, family, probability, confirmed`` of the paragraphs of ``doc_id, text`` that are of a known family.

    A paragraph is judged by its windows of ``2 * BLOCK`` words, one every
    BLOCK words, and has the family of the most probable; ties go to the first
    window. The family counts from the calibrated probability on, if it is
    likelier than none. It is confirmed if of the words and pairs of one of its
    templates ``least_overlap`` are in that window, or ``least_inside`` of the
    window's in the template, as in the middle of a long one.
    """
    spark, model = docs.sparkSession, model or fit()
    best = F.min_by(F.struct("family", "probability", "window"), F.struct(-F.col("probability"), "window"))
    judged = _judged(_hits(docs, model), model).groupBy("doc_id", "th", "paragraph").agg(best.alias("best"))
    judged = stage(judged.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "paragraph", "best.*"), "judged")
    last = F.lit((1 << 63) - 1)
    _, some = apart(docs, F.coalesce(docs["doc_id"], last), judged.select(F.coalesce("_d", last)))
    some = some.select("doc_id", "text", F.xxhash64("text").alias("th"))
    joined = some.join(judged, some["doc_id"].eqNullSafe(judged["_d"]) & (some["th"] == judged["_h"]))
    words = column_words(F.get(paragraph_texts(F.col("text")), F.col("paragraph")))
    own = joined.select("doc_id", "th", "paragraph", "family", "probability", _gram_set(F.slice(words, F.col("window") * BLOCK + 1, F.lit(2 * BLOCK))).alias("own"))
    rows = [(k, [sorted(set(grams(words_of(t)))) for t in texts]) for k, texts in TEMPLATES.items()]
    templates = spark.createDataFrame(rows, "family string, templates array<array<string>>")
    shared = lambda t: F.size(F.array_intersect(t, F.col("own")))
    found = F.exists("templates", lambda t: (shared(t) >= least_overlap * F.size(t)) | (shared(t) >= least_inside * F.size("own")))
    return own.join(F.broadcast(templates), "family").select("doc_id", "th", "paragraph", "family", "probability", found.alias("confirmed"))


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: ``families`` (confirmed, sorted, comma-joined), ``n_paragraphs``, ``n_unknown`` and ``paragraphs``.

    Paragraphs are parted by lines without a letter or digit and counted from
    0; all those of the whole text are judged, and ``n_unknown`` of them are of
    no family. ``paragraphs`` lists ``paragraph:family:confirmed`` of the
    others in order. Null and empty texts have none. Rows that repeat an id
    and its text are one document with equal results, texts that share an id
    are told apart. Other columns are not read. No rows in, none out.
    """
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = classified(once(mine), model)
    d, h, found = unused("d"), unused("h"), unused("found")
    per_doc = each.groupBy(F.col("doc_id").alias(d), F.col("th").alias(h)).agg(F.sort_array(F.collect_list(F.struct("paragraph", "family", "confirmed"))).alias(found))
    per_doc = stage(per_doc, "licences")
    slim = mine.select("doc_id", F.xxhash64("text").alias("th"), F.size(paragraph_texts(F.col("text"))).cast("long").alias("n_paragraphs"))
    joined = slim.join(per_doc, slim["doc_id"].eqNullSafe(per_doc[d]) & (slim["th"] == per_doc[h]), "left")
    every = F.coalesce(F.col(f"`{found}`"), F.array().cast("array<struct<paragraph:int,family:string,confirmed:boolean>>"))
    sure = F.filter(every, lambda p: p["confirmed"])
    return joined.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("families"),
        "n_paragraphs",
        (F.col("n_paragraphs") - F.size(every)).alias("n_unknown"),
        F.array_join(F.transform(every, lambda p: F.concat_ws(":", p["paragraph"], p["family"], p["confirmed"].cast("string"))), ",").alias("paragraphs"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
