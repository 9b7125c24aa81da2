"""Licence notices by a trained paragraph classifier: sparse n-gram logistic regression, a calibrated unknown class, and
template comparison. Scoring is column expressions and joins only, over every paragraph and every line; the model is fitted
on the driver from templates, ordinary sentences and a bounded sample of lines that are no notice."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notices by family, the material of both the fit and the comparison (fixed values).
TEMPLATES = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT license. See LICENSE in the project root.", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.", "SPDX-License-Identifier: MIT"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under GPL v3."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.", "SPDX-License-Identifier: GPL-2.0-only", "Released under GPL v2."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under LGPL v2.1.", "Licensed under the LGPL, version 3."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under AGPL v3.", "Distributed under the AGPL, version 3."),
    "bsd": ("Distributed under the BSD 3-Clause License.", "Released under the BSD license.", "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause"),
    "isc": ("Released under the ISC License.", "Licensed under the terms of the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "eupl": ("Licensed under the EUPL, Version 1.2.", "Released under the terms of the European Union Public Licence.", "This work is made available under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "This document is proprietary and confidential. Unauthorized copying is prohibited."),
}
#: Ordinary uses of the words, which must stay unknown.
ORDINARY = ("He renewed his driving licence at the office.", "The license plate was covered in mud.", "A fishing license costs ten dollars in this state.", "The company licensed its patents to a rival.", "Poetic license allows for such turns.", "The apache helicopter landed near the village.", "Public schools are free of charge.", "The general spoke in public about the third version of the plan.", "A researcher at mit gave a talk.", "The copyright dispute went to court.", "She lost her nursing license after the trial.", "Permission was granted to enter the building.", "They reserved all rooms at the hotel.", "The foundation published free books.", "Version 2.0 of the game is out.", "His pilot licence was issued in version 3 of the form.", "The library is open to the public under new rules.", "No part of the bridge was closed without permission.", "The author of this work has lived in the city for years.", "You may use the gym free of charge.", "The source of the river is a file of small lakes.", "Software is sold with a license to print money.", "The terms of the contract were confidential.", "Creative people of the commons met in public.", "The domain of the lord was dedicated to hunting.", "All documents can be found at the office of the general.", "The car is sold as is.", "The watch comes with a warranty of two years.", "A university in California sold licences to its fans.", "Fans of BSD systems met at the university.", "The union issued a public statement on European law.", "He gave permission to use the hall for any purpose.", "The names of all contributors were read out.", "The holder of the record must retain the title.")
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Common words; a gram of these alone has no weight.
COMMON = frozenset("a all an and any are but either found no only or should than there an as at be by can code copy file for form free from get have if in is it its may no not of on one or other out part see that the this to under use which with work you your".split())
#: Lines that teach the unknown class, at most, those of least hash of SAMPLE documents at most; the share of a template's
#: grams from which on a line is a notice of it.
SAMPLE, LINES, CONFIRM, SEED = 300, 1500, 0.5, 3
#: The share of held-out texts that are no notice which may pass for one.
FALSE = 0.01
#: Weight of the penalty that makes the model sparse, and steps of the fit.
SPARSE, STEPS = 5e-6, 300


def grams(text: str) -> list[str]:
    """Distinct words and word pairs, as the column form below makes them."""
    w = re.findall(WORD, text.lower())
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))


def known_grams() -> list[str]:
    """The grams that have weights: those of the templates and the ordinary sentences, but for common words alone."""
    return sorted({g for ts in (*TEMPLATES.values(), ORDINARY) for t in ts for g in grams(t) if not COMMON.issuperset(g.split(" "))})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams_of(w: Column) -> Column:
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(w, pairs))


def among(w: Column, words: list[str]) -> Column:
    return F.arrays_overlap(w, F.array(*map(F.lit, words)))


class Model:
    """Weights of grams by class, none for the unknown one; the temperature, the least probability of an accepted family,
    and ``cues``: words without any of which no text can be accepted, whatever else it holds."""

    def __init__(self, plain: list, seed: int = SEED, sparse: float = SPARSE):
        """plain: texts that are no notice, or their known grams."""
        rng = random.Random(seed)
        self.classes, self.grams = [*TEMPLATES, UNKNOWN], known_grams()
        at = self.weighted = {g: k for k, g in enumerate(self.grams)}
        filler = sorted({w for t in ORDINARY for w in re.findall(WORD, t.lower())})

        def varied(text: str) -> list[str]:
            w = text.split()
            if len(w) > 6:
                w = [x for x in w if rng.random() > 0.08]
            lead, tail = (rng.choices(filler, k=rng.choice((0, 0, 2, 8))) for _ in range(2))
            return grams(" ".join([*lead, *w, *tail]))

        # rows come with a third of theirs: a template and all its variants are in one
        notices = [(varied(t), f, k % 3) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for _ in range(24)]
        others = [(varied(t), UNKNOWN, k % 3) for k, t in enumerate(ORDINARY) for _ in range(24)]
        mixed = [grams(" ".join(rng.choices(filler, k=rng.choice((3, 10, 30))))) for _ in range(400)]
        mixed += [grams(p) if isinstance(p, str) else p for p in plain]
        rows = notices + others + [(g, UNKNOWN, k % 3) for k, g in enumerate(mixed)]

        def matrix(rows):
            x = np.zeros((len(rows), len(at) + 1))
            for k, (gs, f, _) in enumerate(rows):
                x[k, [at[g] for g in gs if g in at]] = 1
                x[k, -1] = self.classes.index(f)
            rows, n = np.unique(x, axis=0, return_counts=True)  # equal rows, as those without a known gram, count as one
            return rows[:, :-1], rows[:, -1].astype(int), n / n.sum()

        # calibrated on what models of the other thirds make of each third, so on templates that they have never seen
        parts = []
        for part in range(3):
            x, y, share = matrix([r for r in rows if r[2] != part])
            w, b = self._fitted(x, np.eye(len(self.classes))[y], share, sparse)
            x, y, share = matrix([r for r in rows if r[2] == part])
            parts.append((x @ w + b, y, share / 3))
        z, y, share = (np.concatenate(p) for p in zip(*parts))
        # the temperature of least loss, and the least probability that lets few unknowns through
        loss = lambda t: -(share * np.log(self._softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum()
        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        p = self._softmax(z / self.temperature)
        out = y == len(self.classes) - 1
        best, of = p[out, :-1].max(1), share[out]
        order = np.argsort(-best)
        passed = np.cumsum(of[order]) > FALSE * of.sum()
        self.least = float(np.clip(best[order][passed][0], 0.5, 0.95)) if passed.any() else 0.5
        known = ~out
        #: Share of notices of templates left out that are told right.
        self.unseen = float((share[known] * (p[known].argmax(1) == y[known])).sum() / share[known].sum())
        x, y, share = matrix(rows)
        self.w, self.b = self._fitted(x, np.eye(len(self.classes))[y], share, sparse)
        #: The same of new variants of all templates and sentences.
        x, y, share = matrix([(varied(t), f, 0) for f, ts in (*TEMPLATES.items(), (UNKNOWN, ORDINARY)) for t in ts for _ in range(6)])
        self.held_out = float((share * ((x @ self.w + self.b).argmax(1) == y)).sum())
        self.cues = self._cues()

    def _fitted(self, x, aim, share, sparse) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal steps: the log-loss falls, then each weight moves towards 0 by the penalty."""
        w, b = np.zeros((x.shape[1], aim.shape[1])), np.zeros(aim.shape[1])
        b[-1] = 2.0  # a text without any known gram is unknown
        ahead, rate = w, 4.0 / max(1.0, float((share * (x * x).sum(1)).sum()) / 4)
        for step in range(STEPS):
            e = share[:, None] * (self._softmax(x @ ahead + b) - aim)
            move = ahead - rate * (x.T @ e)
            new = np.sign(move) * np.maximum(np.abs(move) - rate * sparse, 0)
            new[:, -1] = 0
            b[:-1] = np.minimum(b[:-1] - rate * e.sum(0)[:-1], 0)
            ahead, w = new + step / (step + 3) * (new - w), new
        return w, b

    def _cues(self) -> list[str] | None:
        """A family is accepted only if it beats unknown by the least odds. The positive weights of all grams without a
        cue together don't reach that, for any family, so a text without a cue is never accepted."""
        need = self.temperature * np.log(self.least / (1 - self.least)) + self.b[-1] - self.b[:-1] - 1e-6
        if (need <= 0).any():
            return None
        gain = np.maximum(self.w[:, :-1], 0)
        left = {g: gain[k] for k, g in enumerate(self.grams) if gain[k].any()}
        out: list[str] = []
        while True:
            over = sum(left.values(), np.zeros(len(need))) - need
            if (over < 0).all():
                return sorted(out)
            worth: dict[str, float] = {}
            for g, v in left.items():
                for word in set(g.split(" ")) - COMMON:
                    worth[word] = worth.get(word, 0.0) + float(v[over >= 0].sum())
            word = max(sorted(worth), key=worth.__getitem__)
            out.append(word)
            left = {g: v for g, v in left.items() if word not in g.split(" ")}

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _share(held: Column, of: Column) -> Column:
    """The largest share of a template's grams among the grams held."""
    return F.array_max(F.transform(of, lambda t: F.size(F.array_intersect(held, t)) / F.size(t)))


def train(docs: DataFrame, sample: int = SAMPLE, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The unknown class is taught by ``lines`` lines at most that are like no template, from ``sample`` documents at most,
    those of least hash, besides the ordinary sentences above; of a line, only its known grams come to the driver. An
    empty table leaves the sentences."""
    some = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    every = docs.join(F.broadcast(some), F.col(id_col) == F.col("id"), "left_semi").select(F.explode(F.split(text_col, "\n")).alias("p"))
    picked = every.orderBy(F.xxhash64("p"), "p").limit(lines).select(F.array_intersect(grams_of(words_of(F.col("p"))), F.array(*map(F.lit, known_grams()))).alias("g"))
    held = [r["g"] for r in picked.collect()]
    templates = [set(grams(t)).intersection(known_grams()) for ts in TEMPLATES.values() for t in ts]
    return Model([g for g in held if all(len(t.intersection(g)) < 0.3 * len(t) for t in templates)])


#: Each line is marked with its number, so that what is split off tells where it stood; paragraphs end at blank lines.
MARK, MARKS, BLANK = "\x01", "(^|\n)[0-9]+\x01", "\n(?:[0-9]+\x01[ \t\r]*\n)+"


def units(docs: DataFrame, text_col: str, cues: list[str] | None) -> DataFrame:
    """Rows (_row, _par, paragraph, whole, w) of docs (with ``text_col``): each paragraph, its lines joined, and each line
    of a paragraph of several, with their words; paragraph is the number of the unit's first line, from 0, and _par that of
    its paragraph. Units that hold no cue are left out. A text is split once, and its parts go on without it, so a text of very many
    paragraphs costs what it is long."""
    held = (lambda w: among(w, cues)) if cues is not None else (lambda w: F.lit(True))
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).where(held(words_of(F.col(text_col))))
    marked = F.array_join(F.transform(F.split(text_col, "\n"), lambda t, i: F.concat(i.cast("string"), F.lit(MARK), t)), "\n")
    par = rows.select(*[c for c in docs.columns if c != text_col], "_row", F.explode(F.split(marked, BLANK)).alias("_p"))
    par = par.withColumn("_w", words_of(F.regexp_replace("_p", MARKS, "$1"))).where(held(F.col("_w")))
    number = lambda t: F.substring_index(t, MARK, 1).cast("int")
    lines = F.split("_p", "\n")
    none = F.expr("cast(array() as array<struct<line:int,whole:boolean,w:array<string>>>)")
    each = F.when(F.size(lines) > 1, F.transform(lines, lambda t: F.struct(number(t).alias("line"), F.lit(False).alias("whole"), words_of(F.substr(t, F.instr(t, MARK) + 1)).alias("w")))).otherwise(none)
    each = F.concat(F.array(F.struct(number(F.col("_p")).alias("line"), F.lit(True).alias("whole"), F.col("_w").alias("w"))), F.filter(each, lambda u: held(u["w"])))
    out = par.withColumn("_par", number(F.col("_p"))).withColumn("u", F.explode(each))
    return out.select(*[c for c in par.columns if c not in ("_p", "_w")], "_par", F.col("u.line").alias("paragraph"), F.col("u.whole").alias("whole"), F.col("u.w").alias("w"))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of each notice.

    Paragraphs, parted by blank lines, are judged as a whole, their lines joined, and line by line. A
    paragraph is reported once, as a whole, if that is more like a template than any of its lines is, else for each line
    that has a family. paragraph: the number of the notice's first line in the document, from 0. similarity: the largest
    share of a template's weighted grams, of that family, that stand in it; confirmed from CONFIRM on. A null or empty text has
    no notice, an empty table no row; texts of any length and number of paragraphs are judged whole; repeated rows give repeated results; null ids come back null; extra columns are ignored.
    """
    spark = docs.sparkSession
    n = len(model.classes)
    # two small tables of fixed size: the templates' grams with a weight for each class, and the templates
    weights = spark.createDataFrame([(g, [float(v) for v in row]) for g, row in zip(model.grams, model.w)], "g string, v array<double>")
    templates = spark.createDataFrame([(f, [[g for g in grams(t) if g in model.weighted] for t in ts]) for f, ts in TEMPLATES.items()], "f string, templates array<array<string>>")
    every = units(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", model.cues)
    flat = every.select("_row", "_par", "paragraph", "whole", "doc_id", F.explode(grams_of(F.col("w"))).alias("g")).join(F.broadcast(weights), "g")
    # what a unit holds of the known grams is all that both the model and the templates ask for
    summed = flat.groupBy("_row", "_par", "paragraph", "whole").agg(F.first("doc_id").alias("doc_id"), F.collect_list("g").alias("held"), *[F.sum(F.col("v")[k]).alias(f"z{k}") for k in range(n)])
    z = F.array(*[((F.col(f"z{k}") + F.lit(float(model.b[k]))) / F.lit(model.temperature)) for k in range(n)])
    top = summed.withColumn("z", z).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    best = F.array_max(F.array(*[F.struct((F.col("e")[k] / F.col("total")).alias("p"), F.lit(c).alias("family")) for k, c in enumerate(model.classes)]))
    told = top.withColumn("best", best).where((F.col("best.family") != UNKNOWN) & (F.col("best.p") >= model.least)).join(F.broadcast(templates), F.col("best.family") == F.col("f"))
    told = told.select("_row", "_par", "doc_id", "paragraph", "whole", F.col("best.family").alias("family"), F.col("best.p").alias("p"), _share(F.col("held"), F.col("templates")).alias("share"))
    of = Window.partitionBy("_row", "_par")
    by_line = F.coalesce(F.max(F.when(~F.col("whole"), F.col("share"))).over(of), F.lit(-1.0))
    by_whole = F.coalesce(F.max(F.when(F.col("whole"), F.col("share"))).over(of), F.lit(-1.0))
    told = told.withColumn("by_line", by_line).withColumn("by_whole", by_whole).where(F.col("whole") == (F.col("by_whole") > F.col("by_line")))
    return told.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("p", 4).alias("probability"), F.round("share", 4).alias("similarity"), (F.col("share") >= CONFIRM).alias("confirmed"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
