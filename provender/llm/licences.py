"""Licence scan: a trained paragraph classifier on sparse word n-grams with a calibrated unknown class; only what a
comparison with templates confirms comes out. DataFrame functions only where documents are read; the fitting sees fixed
templates, sentences and notices."""

from __future__ import annotations

import functools
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What licence notices of each family say. {n} stands for a version, {x} for a holder or year.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version {n}.",
        "Licensed under the Apache License, Version {n} (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-{n}",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD {n}-Clause License.",
        "SPDX-License-Identifier: BSD-{n}-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version {n}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {n} as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-{n}-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version {n}.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-{n}-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version {n}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-{n}-or-later",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License {n}",
        "Licensed under the Eclipse Public License, version {n}.",
        "SPDX-License-Identifier: EPL-{n}",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. {n}.",
        "Licensed under the Mozilla Public License, version {n}.",
        "SPDX-License-Identifier: MPL-{n}",
    ],
    "cc-by": ["Licensed under CC BY {n}.", "This work is licensed under a Creative Commons Attribution {n} International License."],
    "cc-by-sa": ["Licensed under CC BY-SA {n}.", "This work is licensed under a Creative Commons Attribution-ShareAlike {n} International License."],
    "cc-by-nc": ["Licensed under CC BY-NC {n}.", "This work is licensed under a Creative Commons Attribution-NonCommercial {n} International License."],
    "cc-by-nd": ["Licensed under CC BY-ND {n}.", "This work is licensed under a Creative Commons Attribution-NoDerivatives {n} International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA {n}.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike {n} International License."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND {n}.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives {n} International License."],
    "cc0": ["Dedicated to the public domain under CC0 {n}.", "To the extent possible under law, the author has waived all copyright and related rights to this work. SPDX-License-Identifier: CC0-{n}"],
    "proprietary": ["All rights reserved.", "Copyright {x}. All rights reserved.", "This document is confidential and proprietary; no part may be reproduced without prior written permission."],
}
# How each family is called, and its SPDX identifiers.
NAMES = {
    "apache": ["Apache", "Apache {n}", "Apache License {n}", "Apache License, Version {n}", "Apache Software License", "ASL {n}"],
    "mit": ["MIT", "MIT/X11", "Expat"],
    "bsd": ["BSD", "BSD {n}-Clause", "{n}-Clause BSD", "New BSD", "Simplified BSD", "Modified BSD", "BSD-style"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL v{n}", "GPL, version {n}", "GNU GPL", "GNU GPLv2", "GNU GPLv3", "GNU GPL version {n}", "GNU General Public License", "GNU General Public License v{n}", "GNU General Public License, version {n}"],
    "lgpl": ["LGPL", "LGPLv2", "LGPLv3", "LGPL version {n}", "GNU LGPL", "GNU LGPL version {n}", "GNU Lesser General Public License", "GNU Lesser General Public License, version {n}", "GNU Library General Public License"],
    "agpl": ["AGPL", "AGPLv3", "AGPL version {n}", "GNU AGPL", "GNU AGPLv3", "GNU Affero General Public License", "GNU Affero General Public License, version {n}"],
    "epl": ["EPL", "EPL {n}", "Eclipse Public License", "Eclipse Public License {n}", "Eclipse Public License, version {n}"],
    "isc": ["ISC"],
    "mpl": ["MPL", "MPL {n}", "MPLv2", "Mozilla Public License", "Mozilla Public License {n}", "Mozilla Public License, version {n}"],
    "cc-by": ["CC BY {n}", "Creative Commons Attribution {n}", "Creative Commons Attribution {n} International License"],
    "cc-by-sa": ["CC BY-SA {n}", "Creative Commons Attribution-ShareAlike {n}", "Creative Commons Attribution Share Alike {n}"],
    "cc-by-nc": ["CC BY-NC {n}", "Creative Commons Attribution-NonCommercial {n}", "Creative Commons Attribution Non Commercial {n}"],
    "cc-by-nd": ["CC BY-ND {n}", "Creative Commons Attribution-NoDerivatives {n}", "Creative Commons Attribution-NoDerivs {n}"],
    "cc-by-nc-sa": ["CC BY-NC-SA {n}", "Creative Commons Attribution-NonCommercial-ShareAlike {n}"],
    "cc-by-nc-nd": ["CC BY-NC-ND {n}", "Creative Commons Attribution-NonCommercial-NoDerivatives {n}", "Creative Commons Attribution-NonCommercial-NoDerivs {n}"],
    "cc0": ["CC0", "CC0 {n}", "Creative Commons Zero {n}", "CC0 {n} Universal"],
}
SPDX = {
    "apache": ["Apache-{n}"], "mit": ["MIT"], "bsd": ["BSD-{n}-Clause"], "gpl": ["GPL-{n}", "GPL-{n}-only", "GPL-{n}-or-later"], "lgpl": ["LGPL-{n}", "LGPL-{n}-only", "LGPL-{n}-or-later"], "agpl": ["AGPL-{n}", "AGPL-{n}-only", "AGPL-{n}-or-later"],
    "epl": ["EPL-{n}"], "isc": ["ISC"], "mpl": ["MPL-{n}"], "cc-by": ["CC-BY-{n}"], "cc-by-sa": ["CC-BY-SA-{n}"], "cc-by-nc": ["CC-BY-NC-{n}"], "cc-by-nd": ["CC-BY-ND-{n}"], "cc-by-nc-sa": ["CC-BY-NC-SA-{n}"], "cc-by-nc-nd": ["CC-BY-NC-ND-{n}"], "cc0": ["CC0-{n}"],
}


def short_forms(family: str) -> list[str]:
    """What a short notice of a family can't do without, whatever verb it begins with."""
    out = []
    for name in NAMES.get(family, []):
        out += [f"under the {name}" if "license" in name.lower() else f"under the {name} license", f"licensed under {name}", f"License: {name}"]
        if len(name) < 9:
            out.append(f"{name} licensed")
    return out + [f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, [])]


#: Sentences that speak of such matters without being a notice; they and shuffled words teach the unknown class.
OTHERS = [
    "You need a driving licence to rent a car in this country.",
    "The general public was invited to the free concert in the park.",
    "Please read the terms and conditions of the public library.",
    "The version of the story that he told was free of any charge.",
    "The school has a licence to serve food and the permission of the council.",
    "Copyright law has changed over the years.",
    "The software was distributed to all members of the foundation.",
    "Apache helicopters flew over the public square.",
    "Students of MIT wrote the source code for the project.",
    "All rights and duties are set out in the following section.",
    "This work is about the history of the common people.",
]
# Notices of licences that no template has; they are unknown as well.
STRANGERS = [
    "Distributed under the Boost Software License, Version 1.0.",
    "This library is free software and may be used under the terms of the Artistic License.",
    "Licensed under the zlib License.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "You may use this program under the terms of the Example Community Agreement, version 2.",
    "This software is provided under the Microsoft Public License.",
    "Licensed under the Academic License.",
    "Available under the Open Database License.",
    "License: Beerware",
    "Released under the Unlicense.",
    "Licensed under the Example License, version 3.0.",
    "SPDX-License-Identifier: Zlib",
    "Provided under the terms of the CeCILL License.",
    "The images are offered under the Free Art License 1.3.",
    "Use of this file is governed by the Python Software Foundation License.",
]
_WORD = r"[a-z0-9]+"
UNKNOWN = "unknown"
# What the temperature is fitted on. No template, sentence or rule of the training is used for these.
CALIBRATION = [
    ("This module is distributed under the Apache License 2.0, see the file LICENSE for the terms.", "apache"),
    ("You may use these files under the Apache License, Version 2.0.", "apache"),
    ("The code is available under the terms of the MIT License.", "mit"),
    ("MIT licensed, see the file named licence.", "mit"),
    ("You may copy and use the software free of charge under the MIT licence, with this permission notice.", "mit"),
    ("Use of this source code is governed by a BSD 3-Clause License.", "bsd"),
    ("Redistributions of source code must retain the conditions; redistribution in binary forms with modification is permitted.", "bsd"),
    ("You can copy it under the GNU General Public License version 2 as the Free Software Foundation publishes it.", "gpl"),
    ("Free software under the GNU General Public License, version 3 or later.", "gpl"),
    ("The library may be linked under the GNU Lesser General Public License.", "lgpl"),
    ("The server is covered by the GNU Affero General Public License.", "agpl"),
    ("Mozilla Public License version 2 applies to this source file.", "mpl"),
    ("Made available under the Eclipse Public License v1.0.", "epl"),
    ("ISC License applies: use, copy, modify and distribute with or without fee.", "isc"),
    ("Text under CC BY 3.0.", "cc-by"),
    ("The photographs are under CC BY-SA 3.0.", "cc-by-sa"),
    ("Text and figures: CC BY-NC 3.0.", "cc-by-nc"),
    ("The data are CC0 1.0, public domain.", "cc0"),
    ("Copyright 1999 the publisher. No part may be reproduced; all rights reserved.", "proprietary"),
    ("Confidential and proprietary, not to be reproduced without permission.", "proprietary"),
    ("The general was a free man under the public eye.", UNKNOWN),
    ("She holds a fishing licence and the permission to use the boat.", UNKNOWN),
    ("All members have the right to vote, and seats are reserved.", UNKNOWN),
    ("Under the terms of the treaty the foundation may distribute food.", UNKNOWN),
    ("The public library is free and open at any time.", UNKNOWN),
    ("This version of the program was written by students.", UNKNOWN),
    ("The European Union Public Licence applies to this work.", UNKNOWN),
    ("Licensed under the Academic Free License version 3.0.", UNKNOWN),
    ("You may redistribute it under the terms of the Ruby License.", UNKNOWN),
    ("See the accompanying file for the PostgreSQL License.", UNKNOWN),
    ("A copy of the book is available at the shop without charge.", UNKNOWN),
    ("Source and binary stars are of either kind, or of any other.", UNKNOWN),
]
# Words that are common in any text; no filter relies on them where it can rely on another.
COMMON = frozenset("a all and any are as at be by can for from have if in is it may no not of on or part that the their this to under use used with without you your".split())


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    least: float
    templates: tuple[tuple[str, frozenset[str]], ...]


def spelled(text: str) -> str:
    """One spelling of the word that all notices have."""
    return text.replace("licence", "license")


def grams(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours; numbers are one word, as versions and years say nothing of the family."""
    w = ["0" if x.isdigit() else x for x in words]
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def _examples(seed: int) -> list[tuple[str, str]]:
    rnd, out = random.Random(seed), []
    fill = lambda t: t.replace("{n}", rnd.choice(["1", "1.1", "2", "2.0", "3", "3.0", "4.0", ""])).replace("{x}", rnd.choice(["2019 A. Holder", "(c) 2024 Example Ltd", "the authors"]))
    noise = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 9)))
    pool = [w for ts in TEMPLATES.values() for t in ts for w in re.findall(_WORD, t.lower())]
    for k in range(12):
        for family, ts in TEMPLATES.items():
            for t in ts + (short_forms(family) if k % 3 == 0 else []):
                text = fill(t)
                around = [noise() for _ in range(rnd.choice([0, 0, 4, 30]))]
                cut = rnd.randrange(len(around) + 1)
                out.append((" ".join([*around[:cut], text, *around[cut:]]), family))
        for t in OTHERS + STRANGERS:
            out += [(" ".join([*(noise() for _ in range(rnd.randrange(6))), t]), UNKNOWN)] * 2
        for _ in range(30):
            out.append((" ".join(rnd.choice([rnd.choice(pool), noise()]) for _ in range(rnd.randrange(1, 30))), UNKNOWN))
    return out


def template_grams(template: str) -> frozenset[str]:
    """The n-grams of a template; none goes over a gap for a holder."""
    parts = spelled(template.lower()).replace("{n}", "2").split("{x}")
    return frozenset(g for part in parts for g in grams(re.findall(_WORD, part)))


@functools.lru_cache(maxsize=4)
def train(*, seed: int = 7, least: float = 0.5, penalty: float = 1e-3, steps: int = 250) -> Model:
    """Multinomial logistic regression on examples made of the templates (a fixed, bounded set), L1-pruned to few n-grams.

    The temperature is fitted on CALIBRATION, notices and sentences in other words, so that the probabilities, the unknown
    class's among them, are calibrated on what the training hasn't made. Deterministic; a driver trains once.
    """
    families = (*sorted(TEMPLATES), UNKNOWN)
    made = [(grams(re.findall(_WORD, spelled(t.lower()))), families.index(f)) for t, f in _examples(seed)]
    templates = tuple(dict.fromkeys((f, template_grams(t)) for f in sorted(TEMPLATES) for t in TEMPLATES[f] + short_forms(f)))
    known = [g for _, g in templates] + [grams(re.findall(_WORD, spelled(t.lower()))) for t in STRANGERS]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*known)))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)))
        for i, (gs, _) in enumerate(rows):
            for g in gs:
                if g in vocabulary:
                    x[i, vocabulary[g]] = 1
        return x

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(made), np.eye(len(families))[[f for _, f in made]]
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    vw, vb, t = w.copy(), b.copy(), 1.0
    v = np.ones(x.shape[1])
    for _ in range(40):  # the largest singular value
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    top = 1.05 * np.linalg.norm(x @ v) ** 2 / (2 * len(x)) + 0.5
    for _ in range(steps):  # FISTA
        r = (soft(x @ vw + vb) - y) / len(x)
        nw = vw - x.T @ r / top
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / top / 10, 0)
        nb = vb - r.sum(0) / top
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    fresh = [(grams(re.findall(_WORD, spelled(t.lower()))), families.index(f)) for t, f in CALIBRATION]
    z, true = matrix(fresh) @ w + b, [f for _, f in fresh]
    losses = {s: -np.log(soft(z / s)[np.arange(len(true)), true] + 1e-12).mean() for s in np.linspace(0.3, 3, 28).tolist()}
    kept = {g: tuple(w[i].tolist()) for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-6}
    return Model(families, kept, tuple(b.tolist()), min(losses, key=losses.get), least, templates)


def _column_grams(words: Column) -> Column:
    """grams() as an expression."""
    w = F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), "0").otherwise(x))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("\n"))))
    return F.array_distinct(F.concat(w, pairs))


def _needed(templates, confirm: float) -> str:
    """A pattern that every text with ``confirm`` of some template's n-grams matches: it can't lack all of the words taken
    here, for they are more than a text may lack. The longest uncommon words of each template are taken."""
    words: set[str] = set()
    for _, gs in templates:
        own = sorted((w for w in gs if " " not in w), key=lambda w: (w == "0", w in COMMON, -len(w), w))
        words.update("[0-9]+" if w == "0" else w for w in own[: len(gs) - math.ceil(confirm * len(gs) - 1e-9) + 1])
    return rf"(?<![a-z0-9])(?:{'|'.join(sorted(words))})(?![a-z0-9])".replace("license", "licen[cs]e")


#: The end of a line that goes on in the next: not the end of a sentence, and no blank line after it.
WRAP = r"(?<=[^\s.!?:;])[ \t\r]*\n(?=[ \t]*\S)"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, confirm: float = 0.8) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity): the licence notices of each text.

    A paragraph is a run of lines that go on in the next (no sentence ends there and no blank line follows), counted from
    0. It is judged as a whole and, if it has several lines, each line by itself as well, so a notice may be wrapped or
    stand among other lines. A score adds up the weights of distinct n-grams; ``probability`` is the calibrated one, rounded
    to 6 places. Notices whose likeliest class is unknown, or below model.least, are left out, and so are those that aren't
    confirmed: ``similarity``, the largest share of a template of that family whose n-grams are there, must be ``confirm``.
    A row for each paragraph and family, the likeliest reading of it.

    Texts, paragraphs and lines without any of the words that a confirmed notice can't lack are passed over before they are
    cut up, so little is exploded and next to nothing shuffled, whatever the length of the texts. The weights, some hundred
    n-grams, are a table bound by the fixed templates, so it may be broadcast. Null and empty texts have no paragraphs;
    repeated rows count again; an empty table gives none; other columns are not looked at.
    """
    model = model or train()
    spark = docs.sparkSession
    needed = _needed(model.templates, confirm)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).where(F.col("text").rlike(needed))
    blocks = texts.select("row", "doc_id", F.posexplode(F.split(F.regexp_replace("text", WRAP, "\u0001"), "\n")).alias("paragraph", "block")).where(F.col("block").rlike(needed))
    units = F.when(F.contains("block", F.lit("\u0001")), F.concat(F.array("block"), F.split("block", "\u0001"))).otherwise(F.array("block"))
    lines = blocks.select("row", "doc_id", "paragraph", F.posexplode(units).alias("unit", "line")).where(F.col("line").rlike(needed))
    words = F.regexp_extract_all(F.replace("line", F.lit("licence"), F.lit("license")), F.lit(_WORD), F.lit(0))
    exploded = lines.select("row", "doc_id", "paragraph", "unit", F.explode(_column_grams(words)).alias("gram"))
    n = len(model.families)
    index: dict[str, list[int]] = {}
    for i, (_, gs) in enumerate(model.templates):
        for g in gs:
            index.setdefault(g, []).append(i)
    micro = lambda g: [round(w * 1_000_000) for w in model.weights.get(g, (0.0,) * n)]
    table = [(g, micro(g), index.get(g, [])) for g in sorted({*model.weights, *index})]
    weights = spark.createDataFrame(table, "gram string, w array<long>, templates array<int>")
    # a unit's n-grams are distinct, so its list is no longer than the table
    hit = exploded.join(F.broadcast(weights), "gram").groupBy("row", "doc_id", "paragraph", "unit").agg(F.collect_list(F.struct("w", "templates")).alias("hs"))
    fixed = lambda values: F.array(*map(F.lit, values))
    places = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    z = F.transform(places(n), lambda k: (F.aggregate("hs", F.lit(0).cast("long"), lambda total, h: total + h["w"][k]) / 1e6 + fixed(model.bias)[k]) / model.temperature)
    out = hit.withColumn("z", z).withColumn("most", F.array_max("z"))
    out = out.withColumn("family", F.element_at(fixed(model.families), F.array_position("z", F.col("most")).cast("int")))
    out = out.withColumn("probability", F.round(1.0 / F.aggregate("z", F.lit(0.0), lambda total, v: total + F.exp(v - F.col("most"))), 6))
    out = out.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.least))
    # the templates of a family lie side by side
    order, sizes = [f for f, _ in model.templates], fixed([len(gs) for _, gs in model.templates])
    first, last = (F.element_at(fixed([ends(i for i, f in enumerate(order) if f == g) if g in order else 0 for g in model.families]), F.array_position(fixed(model.families), F.col("family")).cast("int")) for ends in (min, max))
    share = F.transform(F.sequence(first, last), lambda i: F.size(F.filter("hs", lambda h: F.array_contains(h["templates"], i))) / sizes[i])
    out = out.withColumn("similarity", F.round(F.array_max(share), 6))
    sure = out.where(F.col("similarity") >= confirm).select("row", "doc_id", "paragraph", "family", F.struct("probability", "similarity").alias("m"))
    return sure.groupBy("row", "doc_id", "paragraph", "family").agg(F.max("m").alias("m")).select("doc_id", "paragraph", "family", "m.*")
