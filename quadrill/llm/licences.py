"""Licence scan with a trained paragraph classifier; the main path is DataFrame functions only.

Paragraphs are the parts of a text between blank lines, their lines joined; they are read in windows of ``SPAN`` words, one every
``STEP`` words, so that a notice within a long paragraph is seen whole. A window is a sparse set of word 1- and 2-grams: those of the
notices below that hold a word other than a function word. Multinomial logistic regression over them names a family, ``unknown``
(licence language of no known family) or ``none``; a family whose logit is not above that of ``unknown`` by the calibrated threshold is ``unknown`` too. It is confirmed if
the window holds enough of the grams of one of the family's notices (template comparison).

The model is fitted on the driver from notices and prose made by rule from a seed, so it never grows with the data. What is learnt as
``unknown`` are notices whose own words (those of one family only) are replaced by made-up ones; the threshold is
set on whole families that are never learnt (``HELD_OUT``): the least at which at most ``ERROR`` of their notices get a known name.

A window without any gram of the notices is ``none`` by the model itself (all its features are 0), so only windows with a gram are
scored; nothing is left out before that. Null and empty texts have no paragraph. Texts and paragraphs of any length are read whole.
Rows of one document id are one document, null ids too: a paragraph counts once for each distinct text it stands in and each place. A paragraph
counts once for a family; its best window gives probability and share. Equal probabilities go to the class first in ``CLASSES``. An
empty table gives no rows. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import table, written

#: Notices by which licences are usually named in texts; each is shorter than a window's step.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0", "Apache-2.0",
        "License: Apache 2.0", "Apache License 2.0", "Apache-Lizenz 2.0", "Licencia Apache 2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
        "License: MIT", "MIT License", "MIT-Lizenz", "Licence MIT", "Publicado bajo la Licencia MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under GPLv3.", "GPLv3", "GPL-3.0-or-later", "GPL-2.0",
        "License: GPL", "GNU GPL", "Licence GPL",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1", "LGPLv3",
        "License: LGPL", "GNU LGPL",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0", "AGPLv3",
        "License: AGPL",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "License: BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "BSD-Lizenz", "BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0", "MPL-2.0",
        "License: MPL",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "Licensed under the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0", "EPL-2.0",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or later.",
        "This work is released under the European Union Public Licence.",
        "SPDX-License-Identifier: EUPL-1.2", "EUPL v1.2",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "License: ISC",
    ),
    "hpnd": (
        "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appears in all copies",
        "and that both that copyright notice and this permission notice appear in supporting documentation",
        "SPDX-License-Identifier: HPND",
    ),
    "zlib": (
        "Released under the zlib License.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "artistic": (
        "Licensed under the Artistic License 2.0.",
        "This is free software; you can redistribute it under the terms of the Artistic License.",
    ),
    "ofl": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "CC-BY-4.0",
        "Creative Commons Namensnennung 4.0 International", "Creative Commons Reconocimiento 4.0 Internacional",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC-BY-SA-4.0",
        "Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0", "Creative Commons Attribution - Partage dans les mêmes conditions 4.0", "Creative Commons Reconocimiento-CompartirIgual 4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "CC-BY-NC-4.0",
        "Creative Commons Namensnennung - Nicht kommerziell 4.0", "Creative Commons Attribution - Pas d’utilisation commerciale 4.0", "Creative Commons Reconocimiento-NoComercial 4.0",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "CC-BY-ND-4.0", "Creative Commons Namensnennung - Keine Bearbeitungen 4.0", "Creative Commons Attribution - Pas de modification 4.0", "Creative Commons Reconocimiento-SinObraDerivada 4.0",
    ),
    "public-domain": (
        "This work is released into the public domain under CC0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "This document is confidential and proprietary; unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Notices of families that are never learnt; the threshold of ``unknown`` is set on them. Many share words with a known family's.
HELD_OUT = (
    "Licensed under the Common Development and Distribution License, Version 1.0.", "This file is released under the CDDL.",
    "Licensed under the Microsoft Public License.", "Governed by the CeCILL license under French law.", "Licensed under the CeCILL version 2.1.",
    "Licensed under the Academic Free License version 3.0.", "This code is distributed under the Q Public License.",
    "Released under the Python Software Foundation License.", "Licensed under the IBM Public License version 1.0.",
    "This software is licensed under the PostgreSQL License.", "Released under the Beerware license.", "Distributed under the terms of the Ruby license.",
    "Licensed under the Open Software License 3.0.", "SPDX-License-Identifier: NCSA", "SPDX-License-Identifier: Unicode-3.0",
    "Licensed under the Server Side Public License.", "Made available under the Business Source License 1.1.", "Licensed under the Elastic License 2.0.",
    "Licensed under the Mulan Public License, Version 2.0.", "Licensed under the Educational Community License, Version 2.0.", "Licensed under the Sun Public License, Version 1.0.",
    "Redistribution of this data base in any form is permitted provided that the source is named", "Permission is granted to anyone to use this file for any purpose, subject to the conditions of the author",
    "This Font is licensed under the Ubuntu Font Licence, Version 1.0.", "made available under the terms of the Common Public License v1.0", "License: WTFPL", "License: Sleepycat",
    "you can redistribute it under the terms of the Open Software Foundation Motif License", "This work is licensed under the Free Art License 1.3.", "Licensed under the Open Data Commons Attribution License 1.0.",
    "This Source Code Form is subject to the terms of the Nokia Public License, v. 1.0.", "Creative Commons Sampling Plus 1.0", "Creative Commons NonCommercial Sampling Plus 1.0", "Creative Commons Developing Nations 2.0",
)
CLASSES = (*NOTICES, "unknown", "none")
UNKNOWN, NONE = len(NOTICES), len(NOTICES) + 1
#: Words whose grams say nothing by themselves.
FUNCTION_WORDS = frozenset(
    "a an and any are as at be but by can for from in including into is it its kind may no not of on or part that the this to under use v will with without work you "
    # the same of the other languages of the notices
    "bajo d dans de der des die du gleichen keine la le les m mes nicht pas und unter".split()
)
#: Made-up prose that holds words of licences but names none.
LOOK_ALIKES = (
    "he showed his driving licence to the officer", "the licence plate of the car was dirty", "a fishing license is sold at the harbour office", "copyright law is taught in the second year",
    "she asked for permission is it granted he wondered", "wealth was redistributed among the villages", "all human rights reserved a place in the debate", "the restaurant lost its liquor license last week",
    "a public domain is a field of study", "licensing fees rose again this spring", "the gnu ran over the plain", "television licence fees are paid every year",
    "the apache fought in the mountains", "the european union published a report", "a software company released a new version", "the foundation was published in three volumes", "the files were kept in the public library",
    "mozilla and eclipse are programs", "the general was free to use the source of the river", "no copy of the documentation was available", "the artistic director resigned", "the following conditions are met with in the north",
    "he holds a master of science from mit", "damages were paid for the loss", "the boost in sales was limited to spring", "international terms of trade", "reserved seats are in the front", "a warranty of two years is provided with the car",
    "the bar was granted a new licence under the old law", "the licence to practise was reserved to members", "the terms of the public contract", "version 2 of the story was never released", "permission to land was hereby refused",
)
SPAN, STEP, ERROR = 64, 32, 0.01
_WORD = r"[^a-z0-9]+"


def grams_of(line: str) -> set[str]:
    """1- and 2-grams that hold a word other than a function word."""
    w = [x for x in re.split(_WORD, line.lower()) if x]
    return {x for x in w if x not in FUNCTION_WORDS} | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a not in FUNCTION_WORDS or b not in FUNCTION_WORDS}


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@functools.cache
def model(seed: int = 3, copies: int = 60, rounds: int = 800) -> tuple[list[str], np.ndarray, float]:
    """(grams, weights [grams + 1, classes], threshold of a family's logit over that of unknown)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiostrnlhdm") for _ in range(r.randint(2, 8)))
    filler = [w for x in LOOK_ALIKES for w in x.split()] + [word() for _ in range(600)]
    vocabulary = sorted({g for notices in NOTICES.values() for n in notices for g in grams_of(n)})
    at = {g: i for i, g in enumerate(vocabulary)}
    known = [x for notices in NOTICES.values() for n in notices for x in re.split(_WORD, n.lower()) if x]
    families = {w: {f for f, notices in NOTICES.items() if any(w in re.split(_WORD, n.lower()) for n in notices)} for w in set(known)}

    def around(words: list[str]) -> str:
        before, after = ([r.choice(filler) for _ in range(r.choice([0, 0, 3, 12, 28]))] for _ in range(2))
        return " ".join([*before, *words, *after])

    lines, target = [], []
    for k, notices in enumerate(NOTICES.values()):
        for i in range(copies):
            words = notices[i % len(notices)].split()
            # words may be missing in long notices; in short ones each counts
            lines.append(around([w for w in words if len(words) < 9 or r.random() > 0.08]))
            target.append(k)
            if i % 2 == 0:
                # the same with other names: licence language of no known family
                names = [len(families.get(x, ())) == 1 and not x.isdigit() for w in words for x in [re.sub(_WORD, " ", w.lower()).strip().split(" ")[0]]]
                if any(names) and len(words) < 24:
                    lines.append(around([word().title() if own else w for w, own in zip(words, names, strict=True)]))
                    target.append(UNKNOWN)
    for form in ("Licensed under the {} License.", "Released under the {} Public License, version {}.", "This work is licensed under the {} Community License.", "Distributed under the terms of the {} license.", "License: {}", "Open {} License", "SPDX-License-Identifier: {}-{}", "Licensed under the {}.", "under the terms of the {} Free License", "This software is governed by the {} licence."):
        for _ in range(copies):
            lines.append(around(form.replace("{}", word().title(), 1).replace("{}", f"{r.randint(1, 4)}.{r.randint(0, 2)}").split()))
            target.append(UNKNOWN)
    every = [w for notices in NOTICES.values() for n in notices for w in n.split()]
    for i in range(copies * 24):
        words = LOOK_ALIKES[i % len(LOOK_ALIKES)].split()
        if i % 3 == 1:  # words of notices out of order, as in other prose
            words = r.sample(words, len(words)) + r.sample(every, r.randint(0, 4))
            r.shuffle(words)
        elif i % 3 == 2:
            words = [r.choice(filler) for _ in range(r.randint(1, 20))]
        lines.append(around(words))
        target.append(NONE)
    x = np.zeros((len(lines), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for i, line in enumerate(lines):
        x[i, [at[g] for g in grams_of(line) if g in at]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[target]
    w = np.zeros((x.shape[1], len(CLASSES)), np.float32)
    w[-1, NONE] = 3.0
    speed = np.zeros_like(w)
    for _ in range(rounds):
        speed = 0.9 * speed + (x.T @ (y - softmax(x @ w)) / len(x) - 1e-4 * w)
        speed[-1] = 0  # the constant stays, so a window without any gram is none
        w += 1.5 * speed
    held = np.zeros((len(HELD_OUT) * 8, x.shape[1]), np.float32)
    held[:, -1] = 1
    for i in range(len(held)):
        held[i, [at[g] for g in grams_of(HELD_OUT[i // 8] if i % 2 else around(HELD_OUT[i // 8].split())) if g in at]] = 1
    z = held @ w
    over = np.where(z.argmax(1) == NONE, 0.0, z[:, :UNKNOWN].max(1) - z[:, UNKNOWN])  # what is none gets no name
    threshold = max(0.0, float(np.sort(over)[int(np.ceil((1 - ERROR) * len(over))) - 1])) + 1e-6
    return vocabulary, w.astype(float), threshold


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, place, words) of every paragraph that has a word."""
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.lower(F.col(text_col)).alias("low"))
    rows = rows.select("doc_id", "version", F.posexplode(F.split("low", r"\n[ \t\r\f\x0B]*\n\s*")).alias("place", "paragraph"))
    return rows.select("doc_id", "version", "place", F.explode(F.array(F.filter(F.split("paragraph", _WORD), lambda w: w != ""))).alias("words")).where(F.size("words") > 0)


def found_grams(parts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, version, place, at, gram) of every gram of the vocabulary in every paragraph; ``at`` is its first word's place."""
    single = [g for g in vocabulary if " " not in g]
    inside = sorted({w for g in vocabulary for w in g.split()})
    # only words of the vocabulary are brought together with their neighbours, and only grams of it leave the array
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(inside))
    rows = parts.select("doc_id", "version", "place", "words", F.explode(F.array(places)).alias("places")).where(F.size("places") > 0)
    one = F.transform("places", lambda i: F.struct(i.alias("at"), F.get("words", i).alias("gram")))
    two = F.transform("places", lambda i: F.struct(i.alias("at"), F.concat(F.get("words", i), F.lit(" "), F.coalesce(F.get("words", i + 1), F.lit(""))).alias("gram")))
    pairs = [g for g in vocabulary if " " in g]
    both = F.concat(F.filter(one, lambda g: g["gram"].isin(single)), F.filter(two, lambda g: g["gram"].isin(pairs)))
    return rows.select("doc_id", "version", "place", F.explode(both).alias("g")).select("doc_id", "version", "place", "g.at", "g.gram")


def in_windows(grams: DataFrame) -> DataFrame:
    """Each gram in the two windows that hold its place (in the first ``STEP`` words, in the one)."""
    last = F.floor(F.col("at") / STEP).cast("int")
    starts = F.array_distinct(F.array(F.greatest(last - 1, F.lit(0)), last))
    inside = (F.col("at") < F.col("window") * STEP + SPAN) & (~F.contains("gram", F.lit(" ")) | (F.col("at") + 1 < F.col("window") * STEP + SPAN))
    return grams.select("doc_id", "version", "place", "at", "gram", F.explode(starts).alias("window")).where(inside).select("doc_id", "version", "place", "window", "gram").distinct()


def _values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A literal table; grams hold letters, digits and spaces only."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({', '.join(names)})")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.6) -> DataFrame:
    """One row per document and family found: paragraphs, best probability, best share of a notice's grams, whether confirmed."""
    spark = docs.sparkSession
    vocabulary, weights, threshold = model()
    key = ["doc_id", "version", "place", "window"]
    grams = written(in_windows(found_grams(paragraphs(docs, id_col, text_col), vocabulary)), "grams")
    # both tables are as large as the notices above
    names = [f"w{k}" for k in range(len(CLASSES))]
    table_w = _values(spark, [(g, *map(float, w)) for g, w in zip(vocabulary, weights[:-1], strict=True)], ["gram", *names])
    notices = [(k, i, g, len(own)) for k, f in enumerate(NOTICES) for i, n in enumerate(NOTICES[f]) for own in [grams_of(n)] for g in sorted(own)]
    table_n = _values(spark, notices, ["best", "notice", "gram", "size"])
    sums = grams.join(F.broadcast(table_w), "gram").groupBy(*key).agg(*(F.sum(n).alias(n) for n in names))
    z = [F.col(n) + float(weights[-1, k]) for k, n in enumerate(names)]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    best = F.lit(NONE)
    for k in range(NONE - 1, -1, -1):
        best = F.when(z[k] == top, k).otherwise(best)
    graded = written(sums.select(*key, best.alias("best"), (1 / total).alias("probability"), (top - z[UNKNOWN]).alias("over")).where(F.col("best") < NONE), "graded")
    # null ids are compared as values: a null is a document too
    g, d = grams.alias("g"), graded.where(F.col("best") < UNKNOWN).alias("d")
    shares = g.join(d, [F.col(f"g.{c}").eqNullSafe(F.col(f"d.{c}")) for c in key]).select("d.*", "g.gram")
    shares = shares.join(F.broadcast(table_n), ["best", "gram"]).groupBy(*key, "best", "probability", "over", "notice").agg((F.count("*") / F.max("size")).alias("share"))
    shares = shares.groupBy(*key, "best", "probability", "over").agg(F.max("share").alias("share"))
    named = shares.unionByName(graded.where(F.col("best") == UNKNOWN).withColumn("share", F.lit(0.0)))
    ok = (F.col("best") < UNKNOWN) & (F.col("over") >= threshold)
    named = named.select("doc_id", "version", "place", F.when(ok, F.get(F.array(*map(F.lit, NOTICES)), F.col("best"))).otherwise("unknown").alias("family"), "probability", F.when(ok, F.col("share")).otherwise(0.0).alias("share"))
    one = named.groupBy("doc_id", "version", "place", "family").agg(F.max("probability").alias("probability"), F.max("share").alias("share"))
    return one.groupBy("doc_id", "family").agg(
        F.count("*").alias("paragraphs"), F.max("probability").alias("probability"), F.max("share").alias("share"),
        ((F.col("family") != "unknown") & (F.max("share") >= confirm)).alias("confirmed"),
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
