"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Statistics of a text are column expressions. A small forest of shallow trees is
fitted on labelled rows; every path from a root to a node is a rule, a
conjunction of thresholds. A lasso logistic regression over the rules keeps the
few that matter, and these become one column expression: the score of any table
is a projection, without Python.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm.tables import cut, texts

BLANKS = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Doubles that describe a text; an empty text has zeros."""
    chars = F.length(text)
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words = F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0)).cast("double")

    def without(characters: str) -> Column:
        return chars - F.length(F.translate(text, characters, ""))

    pairs = F.zip_with(F.slice(words, 1, F.greatest(n_words - 1, F.lit(0))), F.slice(words, 2, F.greatest(n_words - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(chars, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "same_neighbours": share(F.aggregate(pairs, F.lit(0), lambda a, b: a + b), n_words),
        "symbols": share(without("#*$%&|<>"), chars),
        "marks": share(without("!?"), chars),
        "stops": share(without(".,;:"), chars),
        "digits": share(without("0123456789"), chars),
        "capitals": share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
        "line_words": share(n_words, F.size(lines)),
    }


class Condition(NamedTuple):
    feature: str
    below: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) <= self.threshold if self.below else F.col(self.feature) > self.threshold


Rule = tuple[Condition, ...]


def tree_rules(text: str, features: list[str]) -> list[Rule]:
    """Every root-to-node path of a tree from its printed form, one line per branch and indented by depth."""
    rules, path = [], []
    for line in text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, Condition(features[int(found[2])], found[3] == "<=", float(found[4])))]
            rules.append(tuple(c for _, c in path))
    return rules


class Ensemble(NamedTuple):
    rules: list[tuple[Rule, float]]
    intercept: float

    def margin(self) -> Column:
        """The log-odds over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for condition in rule:
                held = held & condition.column()
            total = total + F.when(held, weight).otherwise(0.0)
        return total

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))


def fit(labelled: DataFrame, features: list[str], trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 5) -> Ensemble:
    """The ensemble learnt from the columns ``features`` and ``label`` (0 or 1).

    With one class or none it is a constant: the smoothed share of label 1.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return Ensemble([], math.log((good + 1) / (bad + 1)))
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=20, subsamplingRate=0.7, seed=seed).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString, features)})
    if not rules:
        return Ensemble([], math.log(good / bad))
    held = []
    for rule in rules:
        one = F.lit(True)
        for condition in rule:
            one = one & condition.column()
        held.append(one.cast("double"))
    flags = labelled.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*held)).alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(flags)
    weights = model.coefficients.toArray().tolist()
    return Ensemble([(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6], float(model.intercept))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Statistics and label of the rows to learn from: a stated fold, at most about ``most`` rows.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from. The
    sample is the smallest hashes of the id. Labels that are null or neither 0
    nor 1, and ids with contradicting labels, teach nothing.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    fold = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    turn = F.xxhash64("doc_id")
    picked = fold.orderBy(turn, "doc_id").limit(most)
    rows = texts(docs).join(picked, "doc_id")
    return cut(rows.select(*[c.alias(n) for n, c in statistics(F.col("text")).items()], "label"))


def scored(docs: DataFrame, labels: DataFrame, most: int = 20_000, threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``held_out`` marks the fold that is never learnt from (ids with crc32 mod 5
    = 0; a null id is held out). ``score`` is the probability of label 1 from
    the text alone; null and empty texts have statistics of zero. ``most``
    bounds the labelled rows the ensemble is fitted on.
    """
    names = list(statistics(F.lit("")))
    ensemble = fit(training_rows(docs, labels, most), names, **options)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    measured = texts(docs).select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return measured.select("doc_id", held_out.alias("held_out"), ensemble.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
