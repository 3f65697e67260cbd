"""Quality by a sparse rule ensemble: tree paths over text statistics, lasso logistic weights, Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import written

# Marks whose share of a text is a statistic.
MARKS = {"bang": "!", "pipe": "|", "percent": "%", "hash": "#", "dollar": "$", "and": "&", "star": "*", "stop": ".", "comma": ","}
FEATURES = ("chars", "words", "word_length", "distinct_words", "capital_words", "lines", "distinct_lines", "digits", *MARKS)


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """`df` with the statistics of its text, all JVM expressions; null text counts as empty."""
    whole = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = [f"{prefix}{n}" for n in ("text", "split", "rows")]
    # A generator stands between the steps: a projection would be merged into the rules above it, and
    # every rule would split the text again.
    parts = df.select("*", F.inline(F.array(F.struct(
        whole.alias(names[0]), F.split(F.replace(whole, F.lit("\n"), F.lit(" ")), " ").alias(names[1]), F.split(whole, "\n").alias(names[2])))))
    text, words, lines = [F.col(n) for n in names]
    chars = F.greatest(F.length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    values = {
        "chars": F.log1p(F.length(text).cast("double")), "words": F.log1p(F.size(words).cast("double")),
        "word_length": chars / count, "distinct_words": F.size(F.array_distinct(words)) / count,
        "capital_words": F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))) / count,
        "lines": F.log1p(F.size(lines).cast("double")), "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "digits": 1 - F.length(F.translate(text, "0123456789", "")) / chars}
    values["digits"] = F.when(F.length(text) > 0, values["digits"]).otherwise(0.0)
    for name, mark in MARKS.items():
        values[name] = (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / chars
    kept = [F.col(f"`{c}`") for c in df.columns]
    return parts.select(*kept, F.inline(F.array(F.struct(*[values[f].cast("double").alias(prefix + f) for f in FEATURES]))))


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))."""

    bias: float
    rules: tuple[tuple[str, float], ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for condition, weight in self.rules:
            total = total + F.expr(f"IF({condition}, {weight!r}D, 0D)")
        return 1 / (1 + F.exp(-total))


def tree_paths(debug: str, prefix: str = "_q_") -> set[str]:
    """Every path of a printed forest, inner ones included, as a conjunction over the statistics."""
    paths, stack = set(), []
    for line in debug.splitlines():
        m = re.match(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, f"{prefix}{FEATURES[int(m[2])]} {m[3]} {float(m[4])!r}D"))
        paths.add(" AND ".join(c for _, c in stack))
    return paths


def fit_rules(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              max_rows: int = 20_000, trees: int = 20, depth: int = 3, penalty: float = 0.002) -> RuleModel | None:
    """Rules from a random forest, weighted by logistic regression with an L1 penalty.

    `train` chooses label rows by `_id`. At most `max_rows` of them, those with the smallest hashed ids,
    are looked up in `df`. Labels without an id, or other than 0 and 1, teach nothing. None if no row
    is left; if all labels are alike, a model without rules.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_label"))
    picked = (known.filter(train & F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0)).distinct()
              .orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(picked), "_id")
    sample = with_statistics(rows, "_text").select("_label", *[f"_q_{f}" for f in FEATURES])
    # Repeated documents could exceed the bound again; equal rows carry equal statistics.
    sample = written(sample.groupBy(*sample.columns).agg(F.count("*").alias("_n")).coalesce(8), "quality")
    ones = sample.groupBy("_label").agg(F.sum("_n").alias("n")).collect()
    if not ones:
        return None
    if len(ones) == 1:
        return RuleModel(6.0 if ones[0]["_label"] else -6.0, ())
    seen = VectorAssembler(inputCols=[f"_q_{f}" for f in FEATURES], outputCol="_x").transform(sample).cache()
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_n", numTrees=trees, maxDepth=depth, seed=7).fit(seen)
    paths = sorted(tree_paths(forest.toDebugString))
    seen.unpersist()
    if not paths:
        share = sum(r["n"] for r in ones if r["_label"]) / sum(r["n"] for r in ones)
        return RuleModel(_logit(share), ())
    held = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(paths))], outputCol="_x").transform(
        sample.select("_label", "_n", *[F.expr(f"IF({p}, 1D, 0D)").alias(f"_r{i}") for i, p in enumerate(paths)])).select(
        "_label", "_n", "_x").cache()
    fit = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_n", elasticNetParam=1.0, regParam=penalty,
                             standardization=False, maxIter=60).fit(held)
    held.unpersist()
    weights = fit.coefficients.toArray().tolist()
    return RuleModel(float(fit.intercept), tuple((p, w) for p, w in zip(paths, weights) if w))


def _logit(share: float) -> float:
    from math import log

    share = min(max(share, 1e-3), 1 - 1e-3)
    return log(share / (1 - share))


def score_quality(df: DataFrame, model: RuleModel | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`df` with score (0 to 1) and predicted (1 if score >= threshold, else 0), replacing columns of those names.

    One pass of JVM expressions without a shuffle. Null text counts as empty and is scored as such;
    without a model every score is 0.5.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("score", "predicted")])
    score = model.column() if model else F.lit(0.5)
    wide = with_statistics(kept, text_col).withColumn("score", score)
    return wide.select(*[F.col(f"`{c}`") for c in kept.columns], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
