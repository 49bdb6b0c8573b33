import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.helpers import ODD, empty, frame
from vellumine.llm import language_id, license_scan, quality
from vellumine.llm.common import Scratch, lower_ascii

HERE = os.path.isdir(DATA)


def test_tables_are_the_network():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (90, language_id.WINDOW)).astype(np.uint8)
    model = language_id.train(windows, ["a"] * 45 + ["b"] * 45, steps=3)
    got = model.window_probabilities(windows)
    embedded = model.embedding[windows]
    pooled = []
    for width, weights in model.filters.items():
        responses = [np.einsum("btd,df->btf", embedded[:, k : windows.shape[1] - width + 1 + k], weights[k]) for k in range(width)]
        pooled.append((sum(responses) + model.bias[width]).max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ model.dense + model.dense_bias
    want = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-4)
    long = bytes(windows.ravel()) * 30
    assert np.allclose(model.text_probabilities([b"", long, b"ab"])[1], got.mean(axis=0), atol=1e-4)


def test_language_edge_cases(spark):
    rows = [(i, t) for i, t in ODD if t is not None and len(t) < 9000] + [(100 + i, "der die und nicht ist das ein zu wir" if i % 2 else "the of and to in is that it was") for i in range(40)]
    docs = spark.createDataFrame([(i, t, None if i is None or i < 100 else "de" if i % 2 else "en") for i, t in rows], "doc_id long, text string, lang string")
    model = language_id.language_model(docs)
    found = {(r.doc_id, r.lang_pred): r for r in language_id.identify_languages(frame(spark), model).collect()}
    assert all((i, "und") in found and found[i, "und"].score == 0 for i in (3, 4, 5))
    assert all(0 < r.score <= 1 for (i, lang), r in found.items() if lang != "und")
    assert language_id.language_model(empty(spark)) is None
    assert {r.lang_pred for r in language_id.identify_languages(frame(spark), None).collect()} == {"und"}
    assert language_id.keep_identified(frame(spark), model, 0.3).columns == frame(spark).columns
    assert language_id.identify_languages(empty(spark), model).count() == 0


def test_letters_are_letters_by_category():
    assert not any(map(language_id.has_letter, ("", "12 ²", "½", "Ⅷ", "①", "_", "٣", "!?", "🙂")))
    assert all(map(language_id.has_letter, ("a", "² b", "ß", "日", "ª", "ʰ", "م")))


def test_stages_on_odd_rows(spark):
    rows = [*ODD, (20, "² ½ Ⅷ ①"), *((100 + i, "der die und nicht ist das ein zu wir " * 9 if i % 2 else "the of and to in is that it was " * 9) for i in range(60))]
    docs = frame(spark, rows).drop("lang").withColumn("lang", F.when(F.col("doc_id") >= 100, F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en")))
    key = lambda df: Counter(tuple(str(x) for x in r) for r in df.collect())
    model = language_id.language_model(docs)
    told = {(r.doc_id, r.lang_pred): r.score for r in language_id.identify_languages(docs, model).collect()}
    kept = language_id.keep_identified(docs, model, 0.4)
    assert kept.columns == docs.columns and not key(kept) - key(docs)
    want = Counter(str(i) for i, t in rows for lang in ("de", "en") if i is not None and told.get((i, lang), 0) >= 0.4)
    assert Counter(str(r.doc_id) for r in kept.collect() if r.doc_id is not None) == want and want["20"] == want["3"] == 0 and want["100"] == 1
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100, 160)], "doc_id long, quality int")
    forest = quality.quality_model(docs, labels)
    good = quality.keep_quality(docs, forest)
    scored = Counter(str(r.doc_id) for r in quality.score_quality(docs, labels).where("predicted = 1").collect())
    assert good.columns == docs.columns and not key(good) - key(docs) and Counter(str(r.doc_id) for r in good.collect()) == scored
    for stage in (lambda d: language_id.keep_identified(d, model, 0.4), lambda d: quality.keep_quality(d, forest)):
        assert stage(docs.limit(0)).count() == 0 and stage(docs.limit(0)).columns == docs.columns
    nothing = quality.quality_model(docs.limit(0), labels)
    assert key(quality.keep_quality(docs, nothing)) == key(docs) and key(language_id.keep_identified(docs, None, 0.4)) == key(docs)


def test_hot_labels_are_weighed(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAINING_ROWS", 50)
    docs = spark.createDataFrame([(i % 3, f"text {i % 40} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3, int(i % 3 == 1)) for i in range(90)], "doc_id long, quality int")
    scratch = Scratch(spark, "test")
    seen = []
    monkeypatch.setattr(quality, "grow", lambda rows, labels, times: seen.append((len(rows), times.sum())))
    quality.quality_model(docs, labels)
    assert seen[0][0] <= 100 and seen[0][1] > seen[0][0] and scratch.labels == set()


@pytest.mark.skipif(not HERE, reason="no test data")
def test_quality_is_a_plain_recomputation(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    texts, marks = {r.doc_id: (r.text or "").encode() for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    found = quality.score_quality(docs, labels).collect()
    learned = sorted((np.array(quality.statistics(texts[i])).tobytes(), q) for i, q in marks.items() if i in texts and q is not None and not held[i])
    distinct = sorted(Counter(learned).items())
    forest = quality.grow(np.stack([np.frombuffer(x) for (x, _), _ in distinct]), np.array([float(q) for (_, q), _ in distinct]), np.array([float(c) for _, c in distinct]))
    repeated = quality.grow(np.stack([np.frombuffer(x) for x, _ in learned]), np.array([float(q) for _, q in learned]))
    for r in found:
        row = np.array([quality.statistics(texts[r.doc_id])])
        total = forest.start
        for feature, split, value in zip(forest.feature, forest.split, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(np.searchsorted(forest.edges[feature[node]], row[0, feature[node]], side="left") > split[node])
            total += value[node - len(feature)]
        assert np.isclose(r.score, 1 / (1 + np.exp(-total))) and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.7)
    assert abs(repeated.start - forest.start) < 1e-12


@pytest.mark.skipif(not HERE, reason="no test data")
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id.identify_languages(docs, language_id.language_model(docs)).where("held_out").join(docs, "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95


def test_forest_learns_and_walks():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(800, 5))
    labels = ((rows[:, 1] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    forest = quality.grow(rows, labels)
    assert ((forest.scores(rows) > 0.5) == labels).mean() > 0.95
    one = rows[7]
    total = forest.start
    for feature, split, value in zip(forest.feature, forest.split, forest.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (1 if forest.bins(one[None])[0, feature[node]] <= split[node] else 2)
        total += value[node - len(feature)]
    assert np.isclose(forest.scores(one[None])[0], 1 / (1 + np.exp(-total)))
    assert forest.scores(rows[:0]).shape == (0,)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, id int")
    found = quality.score_quality(frame(spark), labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    nothing = quality.score_quality(frame(spark), labels.limit(0)).select("score").distinct().collect()
    assert len(nothing) == 1
    assert quality.score_quality(empty(spark), labels).count() == 0
    for text in (b"", b" ", b"\xff", b"a" * 10000):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.FEATURES)


@pytest.mark.skipif(not HERE, reason="no test data")
def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{x}.parquet") for x in ("documents", "labels"))
    found = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    rank, good = found.score.rank(), found.quality == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.97


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_every_template_is_found(name):
    for notice in license_scan.TEMPLATES[name]:
        for text in (notice, f"Some words before.\n{notice}\nAnd after it.", notice.upper(), "lorem ipsum " * 200 + notice):
            found = license_scan.find_licenses(text)
            assert [x[0] for x in found] == [name] and found[0][5] == [] and found[0][4] == 1.0


def test_wording_differences(spark):
    text = "This work is licenced under the GNU General Public License, version 3."
    (found,) = license_scan.find_licenses(text)
    assert found[0] == "GPL-3.0" and found[5] == ["-licensed", "+licenced"]
    assert license_scan.find_licenses("A driver's licence is needed for all of this, and nothing else.") == []
    rows = [*ODD, (50, text), (51, "Released under the MIT License.\nreleased under the mit license")]
    got = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.license, r.exact) for r in got) == [(50, "GPL-3.0", False), (51, "MIT", True)]
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_altered_notices_beside_exact_ones_are_kept():
    altered = "This work is licenced under the GNU General Public License, version 3."
    found = {x[0]: x for x in license_scan.find_licenses(f"{license_scan.TEMPLATES["Apache-2.0"][1]}\n{altered}")}
    assert set(found) == {"Apache-2.0", "GPL-3.0"} and found["Apache-2.0"][5] == [] and found["GPL-3.0"][5] == ["-licensed", "+licenced"]
    (one,) = license_scan.find_licenses(license_scan.TEMPLATES["GPL-2.0"][1].replace("hope", "").replace("modify", "change"))
    assert one[0] == "GPL-2.0"


def test_short_notices_beside_long_ones_are_compared():
    gpl, mit = license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["MIT"][2]
    nc, reserved = license_scan.TEMPLATES["CC-BY-NC-4.0"][0], "All rights reserved."
    for lines, names in (([gpl, reserved], {"GPL-3.0", "Proprietary"}), ([gpl, nc], {"GPL-3.0", "CC-BY-NC-4.0"}), ([mit, nc, reserved], {"MIT", "CC-BY-NC-4.0", "Proprietary"})):
        assert {x[0] for x in license_scan.find_licenses("\n".join(lines)) if x[5] == []} == names
    both = license_scan.find_licenses("Licensed under the MIT or Apache License, Version 2.0.")
    assert [(x[0], x[5]) for x in both] == [("Apache-2.0", ["+mit", "+or"]), ("MIT", ["+or", "+apache"])]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_notices_in_long_lines_are_found(name):
    rng = np.random.default_rng(5)
    prose = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 700)) for _ in range(4)]
    for notice in license_scan.TEMPLATES[name]:
        text = f"{prose[0]} copyright {prose[1]} {notice} {prose[2]} licensed {prose[3]}"
        (found,) = license_scan.find_licenses(text)
        assert found[0] == name and found[5] == [] and found[1] <= len(prose[0]) + len(prose[1]) + 12 and found[2] - found[1] < 2500
    assert len(license_scan.blocks(f"{prose[0]} license {prose[1]} license {prose[2]}")) == 2
    wrapped = license_scan.TEMPLATES["MIT"][2].replace(" ", "\n")
    assert [(x[0], x[5]) for x in license_scan.find_licenses(f"{prose[0]}\n{wrapped}\n{prose[1]}")] == [("MIT", [])]


def test_related_licenses_are_told_apart():
    gpl = license_scan.TEMPLATES["GPL-3.0"][1]
    bsd_2 = license_scan.TEMPLATES["BSD-2-Clause"][1]
    texts = {gpl.replace("General", "Lesser General"): "LGPL-3.0", gpl.replace("General", "Affero General"): "AGPL-3.0", license_scan.TEMPLATES["GPL-2.0"][1].replace("program", "library").replace("General", "Lesser General").replace("version 2 ", "version 2.1 "): "LGPL-2.1", bsd_2: "BSD-2-Clause", license_scan.TEMPLATES["BSD-3-Clause"][1].replace("the copyright holder nor", "Acme Inc. nor"): "BSD-3-Clause", "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0"}
    assert {text: [x[0] for x in license_scan.find_licenses(text)] for text in texts} == {text: [name] for text, name in texts.items()}
    assert [x[0] for x in license_scan.find_licenses("SPDX-License-Identifier: MIT OR Apache-2.0")] == ["Apache-2.0", "MIT"]
    assert license_scan.find_licenses("SPDX-License-Identifier: CC0-1.0\nMIT") == []


def common_words(template, words):
    """Most words of a template that can be had in order, by plain dynamic programming."""
    row = [0] * (len(words) + 1)
    for x in template:
        new = [0]
        for j, y in enumerate(words):
            new.append(max(row[j] + 1 if x == y else row[j + 1], new[j]))
        row = new
    return row[-1]


def test_every_template_against_every_block():
    """Several notices in one block and on one line: none is lost, none is made up."""
    rng = np.random.default_rng(11)
    names = [x for x in license_scan.TEMPLATES if x not in ("BSD", "0BSD", "ISC")]
    templates = license_scan._templates()
    for round_ in range(60):
        chosen = [names[k] for k in rng.choice(len(names), rng.integers(1, 5), replace=False)]
        notices = [license_scan.TEMPLATES[x][int(rng.integers(2)) % len(license_scan.TEMPLATES[x])] for x in chosen]
        changed = [x.replace("icensed", "icenced") if rng.random() < 0.3 and len(x.split()) > 9 else x for x in notices]
        filler = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, n)) for n in rng.integers(2, 9, rng.integers(1, 30))) for _ in notices]
        text = ("\n" if round_ % 2 else " ").join(f"{f}. {n}" for f, n in zip(filler, changed, strict=True))
        found = license_scan.find_licenses(text)
        assert set(chosen) <= {x[0] for x in found}, (chosen, text)
        words = license_scan._words(text)
        possible = {t.license for t in templates if common_words(t.words, words) >= license_scan.LEAST_SHARE * len(t.words)}
        assert {x[0] for x in found} <= possible
        for name, _, _, gain, share, differing in found:
            if name in chosen and changed[chosen.index(name)] == notices[chosen.index(name)]:
                assert share == 1.0 and differing == [] and gain > 0


def test_two_licenses_of_the_verdict():
    for text, names in (("Released under the MIT License.\nLicensed under the Apache Licence, Version 2.0.", {"MIT", "Apache-2.0"}), ("Licensed under the MIT License. Portions: This work is licensed under the GNU General Public Licence, version 3.", {"MIT", "GPL-3.0"})):
        assert {x[0] for x in license_scan.find_licenses(text)} == names


def test_templates_are_ranked_by_compression():
    templates = license_scan._templates()
    for i, t in enumerate(templates):
        best = license_scan.ranked(list(t.words), list(range(len(templates))))
        assert dict(best)[i] >= best[0][1] - 0.15 and best == sorted(best, key=lambda x: (-x[1], x[0]))


def test_lower_ascii():
    assert lower_ascii("ÀAZaz[".encode()) == "Àazaz[".encode()
