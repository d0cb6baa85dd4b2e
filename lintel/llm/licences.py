"""Licence notices found by a trained paragraph classifier.

A text is taken apart into paragraphs (runs of lines that are not blank, joined by a space once marks
of comments are off) and into single lines. Both become sets of word 1- and 2-grams; a sparse
multinomial logistic regression, trained on notice wordings, versions of them with words missing, and
lines about licences that are no known notice, gives each a family or the class ``unknown``. A family
stands if its probability reaches a threshold calibrated on versions that were held out of training, and
if the paragraph holds enough of the 2-grams of one of the family's templates. A paragraph counts
where none of its own lines stands for the same family already.

What BSD licences share is one class; a text that holds the third condition too has BSD-3-Clause, any
other BSD-2-Clause, by comparison with the templates over the whole text. A line with an SPDX tag becomes
one unit for each identifier that its expression names (without ``-only``, ``-or-later`` and exceptions);
the model has a wording for each family's tag, and a tag is confirmed by all of its words alone. The
unknown class has lines about licences and the wordings that name a licence, with names of none; the
threshold lies above nearly all held-out ones of those, if nearly all known ones still pass.

Only paragraphs that can be confirmed are scored: whoever holds ``CONFIRM`` of a template's 2-grams
lacks no more of them than the rest, so it holds one of the template's longest 2-grams, which are
rare in other texts, if enough of those are asked for (``screen``). Training uses the DataFrame-based machine
learning API over the templates alone; scoring joins n-grams with the table of weights, whose size the
templates bound. DataFrame functions only.

Defined results: null or empty text has no notice; a null id is kept, rows that repeat an id each have
the notices of their own text; a notice that recurs in a text counts each time; families with equal
probability go by name; an empty table gives an empty result; other columns are ignored whatever
their names.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.llm.common import cut, frequent_keys

UNKNOWN = "unknown"
#: Share of a template's 2-grams that a confirmed paragraph holds.
CONFIRM = 0.75
#: Share of rightly classified held-out versions that the calibrated threshold accepts.
ACCEPT = 0.99
#: Of the versions of a line that lack a word, one in so many calibrates and does not train.
HELD_OUT = 4
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Marks of comments and quotes at the start of a line, and at its end.
MARKS = r"^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|>+|\|)(?=\s|$))?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"

# Notice wordings as their licences publish them.
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Artistic-2.0", "This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License, version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the authors have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MS-PL", "Licensed under the Microsoft Public License."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("NCSA", "Released under the University of Illinois Open Source License."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PostgreSQL", "Released under the PostgreSQL License."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Python-2.0", "This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software in source or binary form and its associated documentation."),
    ("Python-2.0", "Licensed under the Python Software Foundation License Version 2."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("Zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("Zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("Zlib", "Released under the zlib License."),
)
#: What BSD wordings share does not tell whether a text has two clauses or three: the third condition does.
BSD, BSD_THIRD = "BSD", "Neither the name of the copyright holder"
#: A tag, and what it says.
TAG, TAG_LINE = "SPDX-License-Identifier: ", r"(?i)\bSPDX-License-Identifier:[ \t]*(.*)"
#: The wordings, and the tag of each family whose name is an identifier.
WORDINGS = (*TEMPLATES, *[(f, TAG + f) for f in sorted({f for f, _ in TEMPLATES if f != BSD})])
#: Names of licences that do not exist: with them, the wordings that name a licence are no known notice.
NO_LICENCES = ("Example", "Acme Community", "Blue Lantern", "Corporate Internal", "Nova Shared", "Quarry")
#: Lines about licences that are no known notice.
OTHER_LINES = (
    "All rights reserved.",
    "Copyright by the authors, all rights reserved.",
    "A valid driving licence is required.",
    "Licensed under the terms of a commercial agreement.",
    "Released under the Example Source License.",
    "Licensed under the Example License, Version 2.0.",
    "This work is licensed under the Example Community License, version 9.",
    "See the license for the specific terms.",
    "You need permission to use this file.",
    "The product comes without any warranty.",
    "The license fee is due every year.",
    "Redistribution is not permitted without permission.",
    "She lost her fishing licence in the public park.",
    "The software is free for a month.",
    *[f"{start} {name} {end}" for name in NO_LICENCES for start, end in (
        ("Released under the", "License."), ("This work is licensed under the", "License, version 3."), ("Licensed under the", "License, Version 2.0."),
        ("This project is licensed under the terms of the", "license."), ("Distributed under the", "Software License, Version 1.0."),
        ("SPDX-License-Identifier: LicenseRef", ""),
    )],
)


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def pairs(words: Column) -> Column:
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    )


def grams(text: Column) -> Column:
    """Distinct word 1- and 2-grams."""
    return F.array_distinct(F.concat(words_in(text), pairs(words_in(text))))


def training_lines(spark: SparkSession) -> DataFrame:
    """family, grams and held_out of every template, of its versions with one word missing, and of the other lines."""
    lines = spark.createDataFrame([*WORDINGS, *[(UNKNOWN, t) for t in OTHER_LINES]], "family string, line string")
    # a tag keeps its identifier
    last = F.when(F.startswith("line", F.lit(TAG)), F.lit(2)).otherwise(F.size("words") - 1)
    words = lines.withColumn("words", words_in(F.col("line"))).select("family", "words", last.alias("last"))
    cuts = F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.col("last")))
    some = words.select("family", "words", F.explode(cuts).alias("cut"))
    left = F.filter(F.transform("words", lambda w, i: F.when(i != F.col("cut"), w)), lambda w: w.isNotNull())
    held_out = F.pmod(F.col("cut"), F.lit(HELD_OUT)) == 1
    versions = some.select("family", held_out.alias("held_out"), F.concat_ws(" ", left).alias("line"))
    # without its one word a wording can be another family's: then it is not a version of this one
    whole = words.select(F.col("family").alias("owner"), F.concat_ws(" ", "words").alias("owned"))
    versions = versions.join(whole, (F.col("line") == F.col("owned")) & (F.col("family") != F.col("owner")), "left_anti")
    return versions.select("family", "held_out", grams(F.col("line")).alias("grams"))


class Classifier:
    """Weights of each family by gram, intercepts, and the calibrated threshold."""

    def __init__(self, spark: SparkSession):
        self.families = sorted({f for f, _ in TEMPLATES} | {UNKNOWN})
        number = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")) - 1
        lines = training_lines(spark).withColumn("label", number.cast("double")).coalesce(1).cache()  # two thousand inline rows
        trained = lines.where("NOT held_out")
        words = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(trained)
        model = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial").fit(words.transform(trained))
        matrix = model.coefficientMatrix.toArray()
        self.weights = {gram: [float(x) for x in matrix[:, j]] for j, gram in enumerate(words.vocabulary)}
        self.intercepts = [float(x) for x in model.interceptVector]
        held = self.classify(lines.where("held_out").withColumn("key", F.monotonically_increasing_id()), ["family"])
        known = F.col("family") != UNKNOWN
        right = F.when((F.col("predicted") == F.col("family")) & known, F.col("probability"))
        wrong = F.when((F.col("predicted") != UNKNOWN) & ~known, F.col("probability"))
        accepts, takes_for_known = held.agg(F.percentile(right, 1 - ACCEPT), F.percentile(wrong, ACCEPT)).first()
        # above nearly all unknown lines that pass for a family, if nearly all known ones still pass
        self.threshold = float(min(accepts, max(takes_for_known or 0.0, 0.5)))
        lines.unpersist()

    def classify(self, lines: DataFrame, carried: list[str]) -> DataFrame:
        """Predicted family and its probability for rows of key and grams; every gram takes the carried columns with it."""
        families, intercepts = self.families, self.intercepts
        weights = lines.sparkSession.createDataFrame(list(self.weights.items()), "gram string, weights array<double>")
        hits = lines.select("key", *carried, F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
        sums = [F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)).alias(f"m{k}") for k in range(len(families))]
        firsts = [F.first(c).alias(c) for c in carried]
        margins = hits.groupBy("key").agg(*firsts, *sums)
        margins = margins.withColumn("margins", F.array(*[F.col(f"m{k}") + F.lit(b) for k, b in enumerate(intercepts)]))
        top = F.array_max("margins")
        mass = F.aggregate("margins", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        at = F.array_position("margins", top)
        return margins.select(
            "key",
            *carried,
            F.element_at(F.array(*[F.lit(f) for f in families]), at.cast("int")).alias("predicted"),
            (F.lit(1.0) / mass).alias("probability"),
        )

    def screen(self) -> tuple[list[str], list[str]]:
        """2-grams of which every paragraph that holds CONFIRM of a template's 2-grams has one, and the longer word of each.

        Such a paragraph lacks (1 - CONFIRM) of the template's 2-grams at most; of each template one more than that is taken, the longest.
        """
        out: set[tuple[str, str]] = set()
        for _, template in WORDINGS:
            words = re.findall(TOKEN, template.lower())
            held = set(zip(words, words[1:], strict=False))
            out.update(sorted(held, key=lambda g: (-len(g[0]) - len(g[1]), g))[: int((1 - CONFIRM) * len(held)) + 1])
        return sorted({max(g, key=len) for g in out}), sorted(" ".join(g) for g in out)


_FITTED: dict[str, Classifier] = {}


def classifier(spark: SparkSession) -> Classifier:
    """Fitted once in a Spark application: the templates do not change."""
    key = spark.sparkContext.applicationId
    if key not in _FITTED:
        _FITTED[key] = Classifier(spark)
    return _FITTED[key]


def licence_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: bool = False) -> DataFrame:
    """doc_id, paragraph, line (null: the paragraph as a whole), text, family and probability of every notice.

    With ``carried`` also the rows that have none, with null for all but the first, and ``place``, which tells rows apart.
    """
    spark = docs.sparkSession
    model = classifier(spark)
    screen_words, screen_pairs = model.screen()

    def may_hold(words: Column) -> Column:
        return F.exists(words, lambda w: w.isin(screen_words)) & F.exists(pairs(words), lambda g: g.isin(screen_pairs))

    def lines_of(block: Column, k: Column) -> Column:
        """A unit for each line; for a tag, one for each identifier that it names."""
        none = F.lit(None).cast("int")

        def of_line(line: Column, i: Column) -> Column:
            said = F.regexp_replace(F.regexp_extract(line, TAG_LINE, 1), r"(?i)\bWITH[ \t]+\S+", "")
            names = F.filter(F.regexp_extract_all(said, F.lit(r"([A-Za-z0-9][A-Za-z0-9.+-]*)")), lambda n: ~F.upper(n).isin("AND", "OR"))
            bare = F.array_distinct(F.transform(names, lambda n: F.regexp_replace(n, r"(-only|-or-later|\+)$", "")))
            tags = F.transform(bare, lambda n: F.struct(k.alias("paragraph"), i.alias("line"), F.concat(F.lit(TAG), n).alias("text")))
            return F.when(line.rlike(TAG_LINE), tags).otherwise(F.array(F.struct(k.alias("paragraph"), i.alias("line"), line.alias("text"))))

        split = F.split(block, "\n")
        whole = F.struct(k.alias("paragraph"), none.alias("line"), F.regexp_replace(block, r"\s+", " ").alias("text"))
        lines = F.flatten(F.transform(split, of_line))
        return F.when(F.size(split) == 1, lines).otherwise(F.concat(F.array(whole), lines))  # a block of one line is that line

    plain = F.regexp_replace(F.col("text"), f"(?m){MARKS}", "")
    units = F.filter(F.flatten(F.transform(F.split(plain, r"\n\n+"), lines_of)), lambda u: may_hold(words_in(u["text"])))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # marks of comments are no words: what a paragraph holds its text holds too
    held = texts.withColumn("words", words_in(F.col("text"))).select("doc_id", F.when(may_hold(F.col("words")), units).alias("units"))
    rows = cut(held).withColumn("place", F.monotonically_increasing_id())  # of a cut table: the same whenever it is read

    found = rows.select("place", "doc_id", F.explode("units").alias("u")).select("place", "doc_id", "u.*", F.sha2("u.text", 256).alias("key"))
    # a paragraph that many documents share is classified once
    shared = cut(found.groupBy("key").agg(F.min("text").alias("text")).select("key", grams(F.col("text")).alias("grams")))
    known = model.classify(shared, []).where((F.col("predicted") != UNKNOWN) & (F.col("probability") >= model.threshold)).join(shared, "key")
    wording = F.col("wording")
    templates = spark.createDataFrame([*WORDINGS], "family string, wording string").select(
        "family",
        F.array_distinct(pairs(words_in(wording))).alias("wanted"),
        F.when(F.startswith(wording, F.lit(TAG)), grams(wording)).alias("tag"),
        F.startswith(wording, F.lit(BSD_THIRD)).alias("third"),
    )
    share = F.size(F.array_intersect("grams", "wanted")) / F.size("wanted")
    # of a tag every word counts
    same = F.col("tag").isNull() | ((F.size(F.array_except("grams", "tag")) == 0) & (F.size(F.array_except("tag", "grams")) == 0))
    confirmed = cut(
        known.join(F.broadcast(templates), known["predicted"] == templates["family"])
        .where((share >= CONFIRM) & same)
        .groupBy("key")
        .agg(F.min("family").alias("family"), F.max("probability").alias("probability"), F.max("third").alias("third"))
    )
    counted = cut(confirmed.join(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"))
    often, seldom = frequent_keys(counted, "n")
    met = found.join(F.broadcast(often.drop("n")), "key").unionByName(found.join(seldom.drop("n"), "key"))
    clauses = F.when(F.max("third").over(Window.partitionBy("place")), "BSD-3-Clause").otherwise("BSD-2-Clause")
    met = met.withColumn("family", F.when(F.col("family") == BSD, clauses).otherwise(F.col("family")))
    by_line = Window.partitionBy("place", "paragraph", "family")
    notices = met.withColumn("lines", F.count("line").over(by_line)).where("line IS NOT NULL OR lines = 0")
    notices = notices.select("place", "paragraph", "line", "text", "family", "probability")
    out = rows.select("place", "doc_id").join(notices, "place", "left" if carried else "inner")
    return out if carried else out.drop("place")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_notices and families (sorted); one row per input row."""
    notices = licence_notices(docs, id_col, text_col, carried=True)
    by_row = notices.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.count("family").alias("n_notices"), F.array_sort(F.collect_set("family")).alias("families"))
    return by_row.select("doc_id", "n_notices", "families")
