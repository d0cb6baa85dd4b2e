import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import language_id, licences, quality_rules, toxicity


def _brute_statistics(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated))


@pytest.mark.parametrize("text", [None, "", "a b c a b c", "a a a a", "x y\nx y\n\n\nx y", "#a $b\n|c|", "é\x1cü a\x0bb", "a b c d a b c e a b"])
def test_rule_statistics(text):
    assert quality_rules.text_statistics(text)[:5] == _brute_statistics(text)


def test_quality_of_synthetic_documents(small):
    docs, labels, pdf, marks = small
    out = quality_rules.judge_quality(docs, labels).toPandas().set_index("doc_id")
    assert len(out) == len(pdf)
    for i, text in zip(pdf["doc_id"][:200], pdf["text"][:200], strict=True):
        assert tuple(out.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == _brute_statistics(text)
    base = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    assert (out["base_failed"] == base).all() and not out["kept"][base].any()
    marks = marks.drop_duplicates("doc_id").set_index("doc_id")
    seen = out.join(marks, how="inner")[lambda d: ~d["base_failed"]]
    assert seen["kept"][seen["quality"] == 1].mean() > 0.97
    assert seen["kept"][seen["quality"] == 0].mean() < 0.2


def test_quality_of_odd_rows(odd_docs, no_docs, labels):
    out = quality_rules.judge_quality(odd_docs, labels).collect()
    assert len(out) == odd_docs.count()
    assert not any(r["kept"] for r in out if r["n_words"] < 50)
    assert quality_rules.judge_quality(no_docs, labels).count() == 0
    assert quality_rules.judge_quality(odd_docs, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0


def _walk(tree, row):
    """Splits from the root to the row's leaf, counted one by one, and the rest that the leaf expects."""
    feature, cuts, left, path = tree
    at = steps = 0
    while feature[at] >= 0:
        at = left[at] + (row[feature[at]] >= cuts[at])
        steps += 1
    return steps, path[at] - steps


def test_path_lengths_against_a_walk():
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (300, 3))
    forest = quality_rules.IsolationForest(rows, rows.min(0), rows.max(0), trees=9, sample=64)
    probes = np.concatenate([rows[:40], rng.normal(0, 3, (40, 3))])
    lengths = forest.path_lengths(probes)
    for row, length in zip(probes, lengths, strict=True):
        walked = [_walk(tree, row) for tree in forest.trees]
        assert abs(length - np.mean([steps + rest for steps, rest in walked])) < 1e-9
        assert all(steps <= forest.depth and rest >= 0 for steps, rest in walked)
    # a leaf's rest is what a random tree over its rows takes: count the rows that end there
    for tree in forest.trees[:3]:
        assert all(rest < 1e-9 or steps == forest.depth for steps, rest in (_walk(tree, r) for r in probes))


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    scores = quality_rules.IsolationForest(rows, rows.min(0), rows.max(0)).score(rows)
    assert scores.argmax() == 500


def test_forest_is_no_single_cut():
    """Rows whose rates are each usual but whose combination is rare have short paths, too."""
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, 3000)
    rows = np.stack([x, x + rng.normal(0, 0.02, 3000)], 1)
    forest = quality_rules.IsolationForest(rows, rows.min(0), rows.max(0), trees=200)
    assert forest.score(np.array([[0.2, 0.8]]))[0] > np.percentile(forest.score(rows), 99)


def test_every_label_counts(small, spark):
    """The table's forest holds all accepted labelled rows in every tree, and is the one over the same rows in memory."""
    docs, labels, _, _ = small
    found = quality_rules.judge_quality(docs, labels).where("NOT base_failed").join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id")
    seen = found.select((F.col("q") == 1).alias("accepted"), F.struct(*quality_rules.FEATURES).alias("stats")).repartition(5)
    forest, threshold = quality_rules.fit(seen)
    rates = seen.select("accepted", "stats.*").toPandas()
    rows, good = quality_rules.log_rates(rates[list(quality_rules.FEATURES)].to_numpy(float)), rates["accepted"].to_numpy(bool)
    whole = quality_rules.IsolationForest(rows[good], rows.min(0), rows.max(0))
    assert forest.rows == good.sum() and (whole.counts(rows[good]).sum(1) == good.sum()).all()
    assert (forest.score(rows) == whole.score(rows)).all()
    scores = np.unique(whole.score(rows))
    best = max(((whole.score(rows)[~good] > t).mean() - 3 * (whole.score(rows)[good] > t).mean(), -t) for t in (scores[:-1] + scores[1:]) / 2 if (whole.score(rows)[good] > t).mean() <= 0.01)
    assert threshold == pytest.approx(-best[1])


def test_good_rows_keep_their_columns(odd_docs, no_docs, labels, spark):
    kept = quality_rules.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.where("size(split(text, ' ')) < 50").count() == 0
    assert quality_rules.keep_good(no_docs, labels).columns == no_docs.columns
    long = "some words of a text that goes on for a while " * 9
    rows = spark.createDataFrame([(None, " ".join(f"{w}{i}" for i, w in enumerate(long.split()))), (None, "short"), (1, "short"), (1, " ".join(f"{w}{i}" for i, w in enumerate(long.split())))], "doc_id long, text string")
    assert [r["doc_id"] for r in quality_rules.keep_good(rows, labels).collect()] == [None, 1]


def test_toxicity_on_held_out_labels(small):
    docs, labels, _, marks = small
    out = toxicity.score_toxicity(docs, labels).toPandas().set_index("doc_id")
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    assert [bool(h) for h in out["held_out"]] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.index]
    marks = marks.drop_duplicates("doc_id").set_index("doc_id")
    seen = out.join(marks, how="inner")[lambda d: d["held_out"]]
    assert seen["predicted"][seen["toxic"] == 0].mean() <= 0.02
    assert seen["score"][seen["toxic"] == 1].mean() > seen["score"][seen["toxic"] == 0].mean() + 0.4


def test_pairs_of_terms_carry_weight():
    """Toxic only where two terms meet: linear weights cannot tell."""
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for _ in range(3000):
        a, b = (rng.random(2) < 0.4).tolist()
        texts.append(" ".join(["zyx"] * a + ["qwv"] * b + [f"w{rng.integers(200)}"]))
        marks.append(int(a and b))
    machine = toxicity.train(toxicity.hashed_terms(texts), np.array(marks))
    scores = toxicity.Scorer(machine).score(["zyx qwv", "zyx", "qwv", "", None])
    assert scores[0] > 0.7 and scores[1:].max() < 0.3


def test_margin_and_terms_against_brute_force(small):
    _, _, pdf, marks = small
    both = pdf.merge(marks.drop_duplicates("doc_id"), on="doc_id").head(300)
    labels = both["toxic"].to_numpy()
    documents = toxicity.hashed_terms(both["text"].tolist())
    machine = toxicity.train(documents, labels)
    # term choice, by counting each term's documents
    held = {}
    for hashes, label in zip(documents, labels, strict=True):
        for h in set(hashes.tolist()):
            held.setdefault(h, []).append(label)
    chosen = []
    for h, found in held.items():
        table = [[sum(found), len(found) - sum(found)], [labels.sum() - sum(found), len(labels) - labels.sum() - (len(found) - sum(found))]]
        whole = len(labels)
        ratio = 2 * sum(n * math.log(n * whole / (sum(row) * (table[0][k] + table[1][k]))) for row in table for k, n in enumerate(row) if n)
        if len(found) >= toxicity.LEAST_DOCUMENTS and ratio >= toxicity.SIGNIFICANT:
            chosen.append(h)
    assert machine.terms.tolist() == sorted(chosen) and chosen
    # margin, pair by pair
    scorer = toxicity.Scorer(machine)
    for text in both["text"][:60]:
        cols = scorer.columns(text)
        expected = machine.bias + sum(machine.linear[c] for c in cols)
        expected += sum(float(machine.factor[a] @ machine.factor[b]) for i, a in enumerate(cols) for b in cols[i + 1 :])
        assert abs(scorer.score([text])[0] - 1 / (1 + math.exp(-min(max(expected, -30), 30)))) < 1e-9


def test_toxicity_of_ties_and_repeats(spark):
    """Rows of one text score the same; labels that repeat an id count once, the largest of them."""
    docs = spark.createDataFrame([(i % 40, f"{'bad' if i % 40 < 20 else 'fine'} word{i % 5}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(i, 0) for i in range(40)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).toPandas()
    assert out.groupby("doc_id")["score"].nunique().max() == 1
    assert (out["predicted"] == (out["doc_id"] < 20)).all()
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(2 * list(range(20, 40)))


def test_toxicity_of_odd_rows(odd_docs, no_docs, labels):
    out = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}


def test_language_on_held_out_documents(small):
    docs, _, pdf, _ = small
    out = language_id.identify_language(docs).toPandas().set_index("doc_id").loc[pdf["doc_id"]]
    held = out["held_out"].to_numpy()
    assert (out["lang_pred"].to_numpy()[held] == pdf["lang"].to_numpy()[held]).mean() > 0.95
    assert out["score"].between(0, 1).all()


def test_language_of_odd_rows(odd_docs, no_docs):
    out = language_id.identify_language(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_id = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by_id[1] == by_id[2] == by_id[9] == "und" and by_id[7] == "en"
    assert language_id.identify_language(no_docs).count() == 0


def test_tables_equal_convolution():
    network = language_id.ByteConvolution(["a", "b"])
    rows = np.concatenate([language_id.windows_of("héllo wörld " * 60), language_id.windows_of("ab")])
    hidden, _ = network.features(rows)
    logits = hidden @ network.weights["out"] + network.weights["bias"]
    expected = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(network.log_probabilities(rows), expected, atol=1e-3)


MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a
 * copy of this software and associated documentation files (the "Software"),
 * to deal in the Software without restriction, including without limitation
 * the rights to use, copy, modify, merge, publish, distribute, sublicense,
 * and/or sell copies of the Software, and to permit persons to whom the
 * Software is furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 */
int main() {}"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os"""


def test_licences(spark, odd_docs, no_docs):
    lines = {
        1: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 1),
        2: ("text\nReleased under the MIT License.\nmore\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"], 2),
        3: ("Licensed under the Foo License, Version 2.0.", [], 0),
        4: ("Copyright 2020 Example. All rights reserved.", [], 0),
        5: ("this work is LICENSED under the gnu general public license version 3", ["GPL-3.0"], 1),
        6: ("She has a licence to drive.\n\nEr kommt mit der Bahn und mit dem Rad.", [], 0),
        7: (MIT, ["MIT"], 2),
        8: (APACHE, ["Apache-2.0"], 2),
        9: ("Released under the MIT License.\n\nwords\n\nReleased under the MIT License.", ["MIT"], 2),
        10: ("Released under\nthe MIT\nLicense.", ["MIT"], 1),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in lines.items()], "doc_id long, text string")
    out = {r["doc_id"]: (r["families"], r["n_notices"]) for r in licences.scan_licences(docs).collect()}
    assert out == {i: (f, n) for i, (_, f, n) in lines.items()}
    assert licences.scan_licences(odd_docs).where("n_notices = 0").count() == odd_docs.count()
    assert licences.scan_licences(no_docs).count() == 0
    again = docs.unionAll(docs.where("doc_id = 9")).unionAll(docs.where("doc_id = 1").selectExpr("doc_id", "'no notice' AS text"))
    rows = [(r["doc_id"], r["n_notices"]) for r in licences.scan_licences(again).where("doc_id IN (1, 9)").collect()]
    assert sorted(rows) == [(1, 0), (1, 1), (9, 2), (9, 2)]  # rows that repeat an id have their own


BSD_2 = """Copyright (c) 2020, Example

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
"""


def test_whole_licence_files_and_tags(spark):
    texts = {
        1: (BSD_2, ["BSD-2-Clause"]),
        2: (BSD_3, ["BSD-3-Clause"]),
        3: (re.sub(r"\n+", "\n", BSD_3), ["BSD-3-Clause"]),  # all conditions in one paragraph
        4: (re.sub(r"(?m)^", "# ", BSD_2).replace("\n", "\r\n"), ["BSD-2-Clause"]),
        5: (ZLIB, ["Zlib"]),
        6: ("Released under the BSD 3-Clause License.\n\n" + BSD_2, ["BSD-2-Clause", "BSD-3-Clause"]),
        7: ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
        8: ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0) AND BSD-3-Clause */", ["Apache-2.0", "BSD-3-Clause", "GPL-2.0"]),
        9: ("# SPDX-License-Identifier: MIT-0", []),
        10: ("# SPDX-License-Identifier: LicenseRef-Proprietary", []),
        11: ("# SPDX-License-Identifier: CC-BY-NC-SA-4.0", ["CC-BY-NC-SA-4.0"]),
        12: ("SPDX-License-Identifier:", []),
        13: ("Released under the Halcyon License.\n\nLicensed under the Meadow Public License, Version 2.0.", []),
        14: ("spdx-license-identifier: LGPL-3.0-only\n\n" + MIT, ["LGPL-3.0", "MIT"]),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    out = {r["doc_id"]: r["families"] for r in licences.scan_licences(docs).collect()}
    assert out == {i: families for i, (_, families) in texts.items()}


def test_every_wording_and_tag_is_its_own_family(spark):
    lines = list(enumerate(licences.WORDINGS))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in lines], "doc_id long, text string")
    out = {r["doc_id"]: r["families"] for r in licences.scan_licences(docs).collect()}
    wanted = {"BSD": ["BSD-2-Clause"]}
    expected = {i: ["BSD-3-Clause"] if t.startswith(licences.BSD_THIRD) else wanted.get(f, [f]) for i, (f, t) in lines}
    assert out == expected
    assert len({f for f, _ in licences.WORDINGS}) > 30


def test_licence_scores_against_brute_force(spark):
    """Probabilities from the weights gram by gram, and that the screen loses no paragraph that could be confirmed."""
    model = licences.classifier(spark)
    rng = np.random.default_rng(3)
    texts = [t for _, t in licences.WORDINGS] + list(licences.OTHER_LINES) + ["", "nothing of the kind"]
    for _, t in licences.WORDINGS:
        words = t.split()
        texts.append(" ".join(w for w in words if rng.random() > 0.1))
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").withColumn("grams", licences.grams(F.col("text")))
    out = {r["key"]: r for r in model.classify(rows, []).collect()}
    screen_words, screen_pairs = map(set, model.screen())
    for k, text in enumerate(texts):
        words = re.findall(licences.TOKEN, text.lower())
        found = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        margins = [b + sum(model.weights[g][i] for g in found if g in model.weights) for i, b in enumerate(model.intercepts)]
        top = max(margins)
        assert out[k]["predicted"] == model.families[margins.index(top)]
        assert abs(out[k]["probability"] - 1 / sum(math.exp(m - top) for m in margins)) < 1e-9
        held = set(zip(words, words[1:], strict=False))
        for _, template in licences.WORDINGS:
            wanted = re.findall(licences.TOKEN, template.lower())
            wanted = set(zip(wanted, wanted[1:], strict=False))
            assert len(wanted & held) < licences.CONFIRM * len(wanted) or (screen_words.intersection(words) and screen_pairs & {" ".join(g) for g in held})


def test_licences_of_synthetic_documents_against_brute_force(small):
    docs, _, pdf, _ = small
    out = licences.scan_licences(docs).toPandas().set_index("doc_id")
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
        found = [known[line.strip()] for line in (text or "").split("\n") if line.strip() in known]
        assert set(out.loc[i, "families"]) >= set(found) and out.loc[i, "n_notices"] >= len(found)
    assert out["n_notices"].sum() > 0


def test_ties_of_families_go_by_name(spark):
    model = licences.classifier(spark)
    rows = spark.createDataFrame([(1, [])], "key long, grams array<string>")
    even = object.__new__(licences.Classifier)
    even.families, even.intercepts, even.weights = model.families, [0.0] * len(model.families), model.weights
    assert even.classify(rows, []).first()["predicted"] == sorted(model.families)[0]
