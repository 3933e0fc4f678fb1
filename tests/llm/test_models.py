"""Katz scores, quality rules, toxicity and licenses against plain versions."""

import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm import katz
from millrace.llm.license_scan import TEMPLATES, Index, blocks_of, scan
from millrace.llm.quality import Forest, base_failed, judged, quality, statistics
from millrace.llm.quality import fit as rules_fit
from millrace.llm.toxicity import Model, fit, hashed, sentences, toxicity, train


class Plain:
    """Katz backoff with dictionaries."""

    def __init__(self, texts, order, most=katz.GOOD_TURING):
        self.order = order
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<s>"] * (order - 1) + t + ["</s>"]
            for k in range(1, order + 1):
                for i in range(order - 1, len(seq)):
                    grams[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.grams = grams
        self.total = sum(grams[1].values())
        self.d = [None]
        for k in range(1, order + 1):
            stats = [0.0, 0.0, *(float(sum(v == c for v in grams[k].values())) for c in range(1, most + 2))]
            self.d.append([None, *katz.discounts(stats, most)] + [1.0])
        self.after = defaultdict(dict)
        for k in range(2, order + 1):
            for g, c in grams[k].items():
                self.after[g[:-1]][g[-1]] = c
        self.most = most
        left = 1 - sum(self.cut(1, c) / self.total for c in grams[1].values()) if self.total else 1.0
        self.scale = 1.0 if left > 1e-12 else self.total / (self.total + 1)
        self.unknown = left if left > 1e-12 else 1 / (self.total + 1)

    def cut(self, k, c):
        return self.d[k][min(c, self.most + 1)] * c

    def p(self, h, w):
        if not h:
            return self.cut(1, c) / self.total * self.scale if (c := self.grams[1].get((w,), 0)) else self.unknown
        if not (follow := self.after.get(h)):
            return self.p(h[1:], w)
        total, k = sum(follow.values()), len(h) + 1
        seen = sum(self.cut(k, c) / total for c in follow.values())
        scale = 1.0 if seen < 1 - 1e-12 else total / (total + 1)
        if w in follow:
            return scale * self.cut(k, follow[w]) / total
        return (1 - scale * seen) / (1 - sum(self.p(h[1:], x) for x in follow)) * self.p(h[1:], w)

    def score(self, t):
        seq = ["<s>"] * (self.order - 1) + t + ["</s>"]
        return sum(math.log10(self.p(tuple(seq[i - self.order + 1 : i]), seq[i])) for i in range(self.order - 1, len(seq)))


def lowered(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


@pytest.mark.parametrize(("order", "block"), [(1, 500), (2, 700), (2, 10**6), (3, 400)])
def test_scores_are_the_plain_models(spark, odd, corpus, order, block):
    docs = odd.select("doc_id", "text").unionByName(corpus.select("doc_id", "text").where("length(text) < 900").limit(60))
    rows = [(r.doc_id, lowered(r.text)) for r in docs.collect()]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    learnt = [t for i, t in rows if fold(i)]
    plain = Plain(learnt, order)
    count = plain.grams[1]
    n, v = plain.total, len(count)
    want = sorted((len(t) + 1, sum(count[(w,)] > 0 for w in [*t, "</s>"]), round(sum(math.log10((count[(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t, "</s>"]), 6), round(plain.score(t), 6), fold(i) == 0) for i, t in rows)
    found = katz.score(docs, order=order, block_tokens=block, shard_tokens=300).collect()
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6), r.held_out) for r in found)
    assert {r.train_tokens for r in found} == {n}
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-6)


def test_probabilities_sum_to_one(corpus):
    plain = Plain([lowered(r.text)[:60] for r in corpus.limit(20).collect()], 2)
    words = [w for (w,) in plain.grams[1]]
    for h in [("<s>",), *[(w,) for w in words[:20]]]:
        # all words outside the vocabulary share one probability
        assert sum(plain.p(h, w) for w in words) + plain.p(h, "\0unknown") == pytest.approx(1)


def test_kept_tables_hold_the_counts(spark, corpus, tmp_path):
    docs = corpus.select("doc_id", "text").limit(30)
    path = str(tmp_path / "model")
    katz.score(docs, block_tokens=2000, shard_tokens=3000, tables=path).collect()
    plain = Plain([lowered(r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10], 2)
    rows = spark.read.parquet(path).collect()
    for k in (1, 2):
        counts = sorted(c for r in rows if r.k == k for c in katz._unpacked(r.y, np.int64).tolist())
        begin = [sum(1 for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10)]
        assert counts == sorted([*plain.grams[k].values(), *begin])
    assert {r.k for r in rows} == {-1, 1, 2} and all(len(r.x) for r in rows)


def test_no_training_rows(spark, none):
    assert katz.score(none).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = katz.score(only).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


def plain_counts(text):
    found = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = defaultdict(list)
    for i in range(len(found) - 2):
        at[tuple(found[i : i + 3])].append(i)
    covered = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_rule_counts(odd, corpus, labels, none):
    docs = odd.select("doc_id", "text").unionByName(corpus.select("doc_id", "text").limit(200))
    body = sorted((plain_counts(r.text) for r in docs.collect()))
    found = quality(docs, labels).collect()
    assert sorted([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in found) == body
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in found)
    assert quality(none, labels).count() == 0 and quality(odd, labels.limit(0)).count() == odd.count()


def test_rules_keep_good_and_drop_bad(corpus, labels):
    found = quality(corpus, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in found if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5
    assert statistics("")[0] == [0] * 5
    assert judged(corpus.limit(0), None, ["doc_id"]).count() == 0


def test_toxicity_on_held_out_rows(corpus, labels, odd, none):
    found = toxicity(corpus, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.93
    assert {r.predicted for r in found} == {0, 1} and all(0 <= r.score <= 1 for r in found)
    assert all(bool(r.offending) <= (r.score >= 0.5) for r in found)
    assert toxicity(odd, labels).count() == odd.count() and toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity(odd, labels).where("doc_id in (1, 2, 3)").collect()} == {0.0}


def small_model(rows):
    weights, bias = train([(*hashed(text), label) for text, label in rows], least=1)
    named = {w: weights[h] for text, _ in rows for _, _, found in sentences(text) for w in found if (h := xxhash.xxh64_intdigest(w)) in weights}
    return Model(named, bias)


def test_offending_sentence_is_found():
    rows = [("all is fine. you fool. good day.", 1), ("all is fine. good day.", 0), ("what a fool. fine.", 1), ("a good day. fine.", 0)] * 10
    score, where = small_model(rows).score("good day. you fool. fine.")
    assert score > 0.5 and [x[:2] for x in where] == [(9, 18)]


def test_scores_are_noisy_or(corpus):
    """1 - prod(1 - p) over sentences, p a logistic function of a sentence's words and their beginnings."""
    rng = np.random.default_rng(1)
    texts = [r.text or "" for r in corpus.select("text").limit(200).collect()] + ["", " . ! ", "Ünfug über alles? ja"]
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())})
    weights = {w: float(rng.normal()) for w in words[::3]} | {w[:4] + "*": float(rng.normal()) for w in words[::5] if len(w) > 4} | {w[:5] + "*": 0.7 for w in words[::7] if len(w) > 5}
    model = Model(weights, -3.0)
    for text in texts:
        clear, offending = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text):
            found = set(re.findall(r"[^\W\d_]+", sentence.lower()))
            found |= {w[:n] + "*" for w in set(found) for n in (4, 5) if len(w) > n}
            if found:
                p = 1 / (1 + math.exp(-(-3.0 + sum(weights.get(w, 0.0) for w in found))))
                clear *= 1 - p
                offending += p >= 0.5
        score, where = model.score(text)
        assert score == pytest.approx(1 - clear, abs=1e-9) and len(where) == offending


def test_fit_takes_rows_while_their_features_fit(corpus, labels):
    few, whole, none = (fit(corpus, labels, features=n) for n in (60_000, 10**9, 0))
    assert few.weights and whole.weights and few.weights != whole.weights and none.weights == {}


def test_forest_scores_by_path_lengths():
    rng = np.random.default_rng(2)
    good, others = rng.normal(size=(600, 7)), rng.normal(6, 1, (40, 7))
    assert len(Forest(good, others, trees=30).unseen()) == 600
    forest = Forest(good, others, trees=20)
    rows = np.concatenate((good[:40], others, np.full((1, 7), 60.0)))

    def expected(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def length(tree, row, at=0, depth=0):
        feature, cut, left, right, path = (x[at] for x in tree)
        if feature < 0:
            assert path >= depth
            return path
        return length(tree, row, left if row[feature] < cut else right, depth + 1)

    want = [2 ** -(np.mean([length(t, r) for t in forest.trees]) / expected(forest.sample)) for r in rows]
    found = forest.scores(rows)
    assert np.allclose(found, want) and found[40:].min() > np.median(found[:40]) and found[-1] > found[:40].max()


def test_threshold_comes_from_rows_that_the_trees_have_not_seen(corpus, labels):
    forest, threshold = rules_fit(corpus, labels, loss=0.02)
    rows = corpus.join(labels, "doc_id").collect()
    seen = [(r.quality, statistics(r.text or "")) for r in rows]
    good = np.array([f for q, (c, f) in seen if q == 1 and not base_failed(c)])
    assert (forest.scores(good) > threshold).mean() < 0.04


#: Words that a notice must or must not hold for its label; besides the templates all that this version knows.
PLAIN_KEYS = {"mit": {"mit"}, "apache": {"apache"}, "gpl": {"gnu", "program"}, "mpl": {"mozilla"}, "cc-by": {"creative", "commons"}}
PLAIN_OTHERS = {"gpl": {"lesser", "library", "affero"}, "cc-by": {"sharealike", "noncommercial", "noderivatives", "noderivs"}}


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_labels(text):
    """Every run of one and a half times a template's length is looked at; no blocks, order or filters."""
    out, words = {}, plain_words(text)
    for label, t in TEMPLATES:
        ts = plain_words(t)
        want, n = set(ts), math.ceil(1.5 * len(ts))
        keys = want & PLAIN_KEYS.get(label, set())
        for i in range(len(words)):
            if words[i] not in want:
                continue
            run = words[i : i + n]
            stop = next((k for k, w in enumerate(run) if w in PLAIN_OTHERS.get(label, ())), len(run))
            held = want & set(run[:stop])
            if keys <= held and len(held) >= math.ceil(0.8 * len(want) - 1e-9):
                out[label] = max(out.get(label, 0), len(held) / len(want))
    return out


def plain_contained(words):
    """Labels of templates whose words reach the threshold in some block of 256 words, one every 128."""
    out = set()
    for at in range(0, max(len(words), 1), 128):
        block = set(words[at : at + 256])
        out |= {label for label, t in TEMPLATES if len(set(plain_words(t)) & block) >= 0.8 * len(set(plain_words(t))) - 1e-9}
        if at + 256 >= len(words):
            break
    return out


def test_labels_hold_base_labels(spark):
    """Written from the contract: a phrase's label is a base label and stays, whatever else the notice says."""
    texts = ["GNU Lesser General Public License", "GNU Affero General Public License, version 3", "GNU Library General Public License", "the MIT license", "General  PUBLIC\tlicense", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.base_labels, r.labels, r.score) for r in scan(docs).collect()}
    assert found == {0: ("gpl", "gpl,lgpl", 1.0), 1: ("gpl", "gpl", 1.0), 2: ("gpl", "gpl", 1.0), 3: ("mit", "mit", 1.0), 4: ("gpl", "gpl", 1.0), 5: ("", "", 0.0)}


def test_licenses(spark, odd, corpus, none):
    extra = [(20, "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"), (21, "mit\nlicense MIT License"), (22, TEMPLATES[4][1] + " " + "x " * 600 + TEMPLATES[7][1])]
    rng = np.random.default_rng(6)
    pool = sorted({w for _, t in TEMPLATES for w in plain_words(t)} | {"lesser", "library"}) + ["x"] * 30
    for n in range(60):  # templates with words lost, doubled and put in between
        ts = plain_words(TEMPLATES[n % len(TEMPLATES)][1])
        extra.append((100 + n, " ".join(w for x in ts for w in ([x] if rng.random() > 0.12 else []) + [str(rng.choice(pool))] * int(rng.integers(0, 2)))))
    docs = odd.select("doc_id", "text").unionByName(corpus.select("doc_id", "text")).unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    sought = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for r in docs.collect():
        words = plain_words(r.text)
        places = [(i, label) for p, label in sought.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        held = plain_labels(r.text)
        base = {label for _, label in places}
        want.append((len(words), len(places), min((i for i, _ in places), default=-1), max((i for i, _ in places), default=-1), ",".join(sorted(base)), ",".join(sorted(base | held.keys())), 1.0 if base else max(held.values(), default=0.0), ",".join(sorted(plain_contained(words)))))
    found = [(r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels, r.labels, r.score, r.contained) for r in scan(docs).collect()]
    assert sorted(found) == sorted(want) and any(w[4] != w[5] for w in want)
    assert scan(none).count() == 0


def test_each_filter_leaves_blocks_out(corpus):
    texts = [r.text or "" for r in corpus.select("text").collect()]
    held = Counter(w for t in texts for w in set(plain_words(t)))
    index = Index(TEMPLATES, held, 0.8)
    rng = np.random.default_rng(3)
    pool = sorted(w.decode() for w in index.words)
    texts += [" ".join(rng.choice(pool, rng.integers(2, 40))) for _ in range(400)]
    n = sum(len(index.best(b)) for t in texts for b in blocks_of(t))
    assert index.too_short > 20 and index.out_of_place > 20 and n <= index.verified < index.met - 40
    # what the filters leave out can't hold a template
    for t in texts[-500:]:
        for b in blocks_of(t):
            for i, s in enumerate(index.sets):
                assert i in index.candidates(b) or len(s & set(b)) < index.need[i]


def plain_spans(text, template):
    """The largest share of a template's words in any run of one and a half times its length; knows no blocks."""
    words, want = re.findall(r"[a-z0-9]+", text.lower()), re.findall(r"[a-z0-9]+", template.lower())
    n = math.ceil(1.5 * len(want))
    return max((len(set(want) & set(words[i : i + n])) / len(set(want)) for i in range(max(1, len(words) - n + 1))), default=0)


def test_licenses_that_are_wrapped_or_far_into_a_text(spark):
    texts = []
    for _, t in TEMPLATES:
        for width in (20, 40, 75):
            for before in (0, 100, 120, 250, 1000):
                texts.append("x y\n" * (before // 2) + "\n".join(" * " + line for line in textwrap.wrap(t, width)) + "\nint main()" + " z" * 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in scan(docs).collect()}
    for i, text in enumerate(texts):
        own = TEMPLATES[i // 15]
        assert plain_spans(text, own[1]) == 1 and own[0] in found[i]
    alone = spark.createDataFrame([(0, "Some text.\nAll rights\nreserved.")], "doc_id long, text string")
    assert [(r.labels, r.score) for r in scan(alone).collect()] == [("proprietary", 1.0)]


def test_licenses_get_their_own_label_only(spark):
    # the short LGPL template holds a base phrase of the GPL
    texts = [(t, "gpl,lgpl" if label == "lgpl" else label) for label, t in TEMPLATES] + [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("Released under the Apache License", "apache"),
        ("Licensed under the GNU General Public License, version 2.0", "gpl"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ""),
        ("rights " + "z " * 40 + "all " + "z " * 40 + "reserved", ""),
        ("cc " + "z " * 9 + "by " + "z " * 9 + "nc", ""),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
        (TEMPLATES[6][1] + ".\n" + TEMPLATES[4][1], "gpl,lgpl"),
    ]
    for wrapped in (False, True):
        docs = spark.createDataFrame([(i, "\n".join(textwrap.wrap(t, 30)) if wrapped else t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
        assert {r.doc_id: r.labels for r in scan(docs).collect()} == {i: label for i, (_, label) in enumerate(texts)}


def test_forest_draws_from_all_labelled_rows(corpus, labels, monkeypatch):
    """More labelled rows than any bound: all set the threshold, by order, and any may be drawn for a tree."""
    from pyspark.sql import functions as F

    import millrace.llm.quality as Q

    n = 25
    docs = corpus.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select((F.col("doc_id") + F.col("k") * 1_000_000).alias("doc_id"), "text")
    marks = labels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select((F.col("doc_id") + F.col("k") * 1_000_000).alias("doc_id"), "quality")
    sets = []
    whole = Q._nth_largest

    def held(rows, name, at):
        found = whole(rows, name, at)
        scores = sorted((r[0] for r in rows.select(name).collect()), reverse=True)
        sets.append((len(scores), at, scores[at] == found))
        return found

    monkeypatch.setattr(Q, "_nth_largest", held)
    monkeypatch.setattr(Q, "TREES", 10)
    forest, _ = rules_fit(docs, marks, loss=0.02)
    good = sum(not base_failed(statistics(r.text or "")[0]) for r in corpus.join(labels.where("quality = 1"), "doc_id").collect())
    assert n * good > 4000 and sets == [(n * good, int(0.02 * n * good), True)] and len(forest.trees) == 10 and forest.sample == 512
