import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import quality_rules, tokens, toxicity

BAD = ["fool", "vermin", "filth", "rubbish", "nasty"]


def labelled(seed, n, toxic=True):
    rng = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))]
        mark = rng.random() < 0.3
        if mark:
            words = [rng.choice(BAD) if toxic and rng.random() < 0.2 else w + ("" if toxic else "%%%") for w in words] + BAD[:1] * toxic
        rows.append((i, " ".join(words)))
        labels.append((i, int(mark) if toxic else int(not mark)))
    return rows, labels


def labels_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, label int")


def learnable():
    return F.col("doc_id") % 3 != 0


def accuracy(scored, labels, cut):
    want = dict(labels)
    rows = [(r["score"] >= cut, want[r["doc_id"]]) for r in scored.collect() if r["doc_id"] % 3 == 0]
    return sum(a == b for a, b in rows) / len(rows)


def test_toxicity_on_rows_held_out(spark, documents):
    rows, labels = labelled(1, 900)
    w = toxicity.fit(documents(rows), labels_table(spark, labels), learnable())
    assert accuracy(toxicity.score(documents(rows), w), labels, 0.7) > 0.97
    assert 0 < np.count_nonzero(w) < 2000
    kept = {r["doc_id"] for r in toxicity.drop_toxic(documents(rows), w, 0.7).collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(documents(rows), w).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.7}


def test_toxicity_score_by_definition(spark, documents):
    w = np.zeros(1 << toxicity.BITS, np.float32)
    w[toxicity.BIAS] = -1.0

    def place(*words):
        col = __import__("pyarrow").array([" ".join(words)])
        ((_, h, _),) = tokens.hashed(col, tokens.letter_table())
        if len(h) == 1:
            return int(h[0] >> np.uint64(64 - toxicity.BITS))
        m = toxicity._M1 if len(h) == 2 else toxicity._M2
        return int(tokens.mix(h[:1] * m + h[-1:])[0] >> np.uint64(64 - toxicity.BITS))

    w[place("fool")], w[place("you", "fool")], w[place("you", "x", "fool")] = 2.0, 0.5, 0.25
    cases = {1: ("FOOL!", 1.0), 2: ("fool fool", 1.0), 3: ("you fool", 1.5), 4: ("you utter fool", 1.25), 5: ("", -1.0), 6: (None, -1.0), 7: ("you.\nFool? you big fool", 1.75)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents([(i, t) for i, (t, _) in cases.items()]), w).collect()}
    assert all(math.isclose(got[i], 1 / (1 + math.exp(-z)), abs_tol=1e-6) for i, (_, z) in cases.items())


def test_toxicity_odd_rows(spark, documents, odd):
    labels = labels_table(spark, [(None, 1), (9001, 1), (9002, None), (9003, 7), (9005, 0), (9005, 1)])
    w = toxicity.fit(documents(odd), labels, F.lit(True))
    got = toxicity.score(documents(odd), w).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(documents(odd), w, 0.7)
    assert kept.columns == documents(odd).columns and kept.count() == len(odd)
    none = toxicity.fit(documents([]), labels_table(spark, []), F.lit(True))
    assert not none.any() and toxicity.score(documents([]), none).collect() == []


def test_the_sample_is_bounded(spark, documents):
    rows, labels = labelled(3, 900)
    w = toxicity.fit(documents(rows), labels_table(spark, labels), learnable(), max_rows=150)
    assert accuracy(toxicity.score(documents(rows), w), labels, 0.5) > 0.75


def test_quality_on_rows_held_out(spark, documents):
    rows, labels = labelled(2, 900, toxic=False)
    model = quality_rules.fit(documents(rows), labels_table(spark, labels), learnable())
    assert accuracy(quality_rules.score(documents(rows), model), labels, 0.3) > 0.97
    assert 0 < len(model.rules) < 60 and all(" if " in d for d in model.describe())


def test_quality_rules_by_definition(spark):
    stats = [{"a": 0.1, "b": 5.0}, {"a": 0.9, "b": 5.0}, {"a": 0.9, "b": 1.0}]
    model = quality_rules.RuleModel(["a", "b"], 0.5, [(((0, False, 0.5),), 2.0), (((0, False, 0.5), (1, True, 3.0)), -4.0)])
    df = spark.createDataFrame([tuple(s.values()) for s in stats], "a double, b double")
    got = [r[0] for r in df.select(model.score([F.col("a"), F.col("b")])).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-z)) for z in (0.5, 2.5, -1.5)])


def test_paths_of_printed_trees():
    text = """GBTClassificationModel
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 1 <= 1.0E-4)
      Predict: 1.0
     Else (feature 1 > 1.0E-4)
      Predict: 0.0
    Else (feature 3 > 0.5)
     Predict: -1.0
"""
    assert quality_rules._tree_rules(text) == [
        ((3, True, 0.5),), ((1, True, 1e-4), (3, True, 0.5)), ((1, False, 1e-4), (3, True, 0.5)), ((3, False, 0.5),)]


def test_statistics(spark):
    text = "Aa bb.\nAa bb.\n$$ 12|"
    row = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(
        *[c.alias(n) for n, c in quality_rules.statistics(F.col("text")).items()]).collect()
    n = len(text)
    assert row[0]["upper"] == 2 / n and row[0]["digits"] == 2 / n and row[0]["bars"] == 1 / n and row[0]["stops"] == 2 / n
    assert row[0]["symbols"] == 3 / n and row[0]["same_lines"] == pytest.approx(1 / 3) and row[0]["same_words"] == pytest.approx(2 / 6)
    assert row[1] == row[2] and not any(v is None for v in row[1])


def test_quality_odd_rows(spark, documents, odd):
    labels = labels_table(spark, [(None, 1), (9001, 1), (9002, 0), (9003, 7), (9005, 0), (9005, 1), (9004, None)])
    model = quality_rules.fit(documents(odd), labels, F.lit(True))
    got = quality_rules.score(documents(odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    for one in ([(9001, 1)], [(9001, 0)], []):
        flat = quality_rules.fit(documents(odd), labels_table(spark, one), F.lit(True))
        assert not flat.rules
    assert quality_rules.score(documents([]), flat).collect() == []


def test_toxicity_weights_by_a_plain_loop(spark, documents):
    """FTRL-proximal with a dictionary of coordinates over sets of words, pairs and pairs with a gap."""
    rows, labels = labelled(4, 120)
    rows += [(500, ""), (501, None)]
    labels += [(500, 0), (501, 1)]
    weights = toxicity.fit(documents(rows), labels_table(spark, labels), F.lit(True))

    def hashes(text):
        import pyarrow as pa

        return [int(x) for _, h, _ in tokens.hashed(pa.array([text or ""]), tokens.letter_table()) for x in h]

    def mixed(a, b, m):
        return int(tokens.mix(np.array([(a * int(m) + b) % 2**64], np.uint64))[0])

    def features(text):
        h = hashes(text)
        out = set(h) | {mixed(a, b, toxicity._M1) for a, b in zip(h, h[1:])} | {mixed(a, b, toxicity._M2) for a, b in zip(h, h[2:])}
        return sorted({x >> (64 - toxicity.BITS) for x in out}) + [toxicity.BIAS]

    order = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    turn = {r["doc_id"]: r["h"] for r in order}
    texts, want = dict(rows), dict(labels)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for doc in sorted(want, key=turn.get):
            x = features(texts[doc])
            now = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(now[i] for i in x)))))
            g = p - want[doc]
            for i in set(x):
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * now[i]
                n[i] = n.get(i, 0.0) + g * g
    plain = {i: w for i in z if (w := weight(i))}
    assert plain and set(np.flatnonzero(weights).tolist()) == set(plain)
    assert all(math.isclose(weights[i], w, rel_tol=1e-4, abs_tol=1e-5) for i, w in plain.items())


def test_quality_weights_are_the_lasso_minimum(spark, documents):
    """At the minimum the loss's slope along a kept rule's weight is the penalty, against the weight's sign."""
    rows, labels = labelled(6, 500, toxic=False)
    model = quality_rules.fit(documents(rows), labels_table(spark, labels), F.lit(True))
    named = quality_rules.statistics(F.col("text"))
    table = documents(rows).select("doc_id", *[c.alias(f"s_{k}") for k, c in named.items()]).collect()
    want = dict(labels)
    y = np.array([want[r["doc_id"]] for r in table], float)
    stats = np.array([[r[f"s_{k}"] for k in model.names] for r in table], float)
    holds = np.array([
        np.all([(stats[:, i] <= cut) if low else (stats[:, i] > cut) for i, low, cut in rule], axis=0) for rule, _ in model.rules
    ], float)
    w = np.array([v for _, v in model.rules])
    p = 1 / (1 + np.exp(-(model.intercept + w @ holds)))
    slope = holds @ (p - y) / len(y)
    assert len(w) and abs(np.mean(p - y)) < 1e-4
    assert np.abs(slope + quality_rules.PENALTY * np.sign(w)).max() < 2e-4
    # No kept weight can be moved for a smaller loss, and without the rules the loss is far larger.
    loss = lambda v: np.mean(np.log1p(np.exp(-(2 * y - 1) * (model.intercept + v @ holds)))) + quality_rules.PENALTY * np.abs(v).sum()
    best = loss(w)
    assert all(loss(w + d * e) >= best - 1e-9 for e in np.eye(len(w)) for d in (-0.05, 0.05)) and loss(0 * w) > 1.5 * best
    got = {r["doc_id"]: r["score"] for r in quality_rules.score(documents(rows), model).collect()}
    assert [got[r["doc_id"]] for r in table] == pytest.approx(p.tolist())
