"""Quality scores by a sparse rule ensemble (operator 9).

Every text gets a few statistics, computed by Spark columns. Boosted trees over the statistics of a bounded sample of
labelled rows give rules: each path from a root to a node is a conjunction of threshold conditions. Rules are 0/1
features of a logistic regression with an L1 penalty, which keeps few of them. The kept rules and their weights are
compiled into one Spark column, so scoring is a scan without a model, a join or Python.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze

#: Most labelled rows that training reads.
MAX_ROWS = 20_000
TREES, DEPTH, PENALTY = 12, 3, 0.002

Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are 0 for a null or empty text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, r"\s+")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / n_words,
        "line_length": F.log1p(F.length(t) / n_lines),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "symbols": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")) / chars,
        "digits": F.regexp_count(t, F.lit(r"[0-9]")) / chars,
        "stops": F.regexp_count(t, F.lit(r"[.,]")) / chars,
        "bars": F.regexp_count(t, F.lit(r"[|{}<>]")) / chars,
        "same_lines": F.lit(1.0) - F.size(F.array_distinct(lines)) / n_lines,
        "same_words": F.lit(1.0) - F.size(F.array_distinct(words)) / n_words,
    }


def _tree_rules(text: str) -> list[Rule]:
    """Paths of printed trees: every node below a root is the conjunction of the conditions that lead to it."""
    rules, path = [], []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = (len(m[1]) - 4) // 1
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), m[4] == "<=", float(m[5])))]
        rules.append(tuple(sorted({c for _, c in path})))
    return rules


def _holds(rule: Rule, stats: list[Column]) -> Column:
    out = F.lit(True)
    for i, low, cut in rule:
        out = out & ((stats[i] <= cut) if low else (stats[i] > cut))
    return out


class RuleModel:
    """Intercept, and rules with their weights, over named statistics."""

    def __init__(self, names: list[str], intercept: float, rules: list[tuple[Rule, float]]):
        self.names, self.intercept, self.rules = names, intercept, rules

    def score(self, stats: list[Column]) -> Column:
        """Probability of label 1 as one column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, stats), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [
            f"{w:+.3f} if " + " and ".join(f"{self.names[i]} {'<=' if low else '>'} {cut:g}" for i, low, cut in rule)
            for rule, w in self.rules
        ]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = MAX_ROWS) -> RuleModel:
    """Fit on ``labels(doc_id, label)`` rows where ``may_learn`` holds (a condition on doc_id).

    At most about ``max_rows`` of them are read, chosen by a hash of doc_id. Null ids and labels other than 0 and 1 are
    left out; of a repeated id the smallest label counts. With labels of one kind only, or none, the model is the
    constant that gives their share (one half for none).
    """
    marked = labels.filter(may_learn).filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(
        F.min("label").alias("label")
    )
    share = max_rows / max(1, marked.count())
    if share < 1:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    named = statistics(F.col("text"))
    names = list(named)
    # The sample is bounded by max_rows, so it may be broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")
    rows = freeze(sample.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in named.items()]))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        odds = {0: 0.0}.get(n, 5.0 if ones else -5.0)
        return RuleModel(names, odds, [])
    ready = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("label", "x")
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=9, stepSize=0.2, maxBins=64
    ).fit(ready)
    rules = list(dict.fromkeys(_tree_rules(trees.toDebugString)))
    stats = [F.col(n) for n in names]
    cols = [F.when(_holds(r, stats), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
    marks = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(
        rows.select("label", *cols)
    )
    lasso = LogisticRegression(
        featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False
    ).fit(marks.select("label", "x"))
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleModel(names, float(lasso.intercept), kept)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``; a null or empty text is scored by its statistics, all 0."""
    named = statistics(F.col("text"))
    stats = docs.select("doc_id", *[c.alias(f"s_{n}") for n, c in named.items()])
    return stats.select("doc_id", model.score([F.col(f"s_{n}") for n in model.names]).alias("score"))
