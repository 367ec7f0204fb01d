"""A quality classifier of conjunctive rules with sparse logistic weights.

Statistics of the whole text are Spark expressions.  Trees over them are grown on a
bounded sample of labelled documents, and every path from a root to a node becomes a
rule, a conjunction of thresholds.  A lasso logistic regression over the rules keeps
few of them with a weight, and what is left is compiled into one Spark column
expression.
"""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plyclock.llm.common import free_name, stored, surely_least

#: Labelled documents learned from, at most.
SAMPLE = 12_000
TREES, DEPTH = 24, 3
LASSO = 2e-4


def statistics(text="text"):
    """Statistics of a text, by name; null counts as empty, and no value is null."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    words = F.split(F.trim(t), r"\s+")
    lines = F.split(t, "\n")

    def left(pattern):
        return F.length(F.regexp_replace(t, pattern, ""))

    def share(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return {
        "chars": F.log1p(n.cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "chars_per_word": share(n, F.size(words)),
        "letters": share(left(r"[^\p{L}]+"), n),
        "capitals": share(left(r"[^\p{Lu}]+"), n),
        "digits": share(left(r"[^0-9]+"), n),
        "symbols": share(left(r"[\p{L}\p{N}\s.,]+"), n),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "chars_per_line": F.log1p(share(n, F.size(lines))),
    }


def with_statistics(docs, text="text", prefix="_stat_"):
    return docs.withColumns({prefix + k: v for k, v in statistics(text).items()})


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; a rule is a tuple of (statistic, "<=" or ">", threshold)."""

    intercept: float
    rules: tuple

    @staticmethod
    def condition(rule, value=lambda name: F.col("_stat_" + name)):
        """The rule over the statistics that ``value`` gives by name."""
        parts = [value(name) <= at if sign == "<=" else value(name) > at
                 for name, sign, at in rule]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole & part
        return whole

    def score(self, text="text"):
        """The probability of label 1 as a column over the text.

        The statistics are the element of an array that a lambda names: however many
        rules use one, and wherever a filter on the score is pushed, it is made once.
        """
        def of(made):
            total = F.lit(self.intercept)
            for weight, rule in self.rules:
                hit = self.condition(rule, lambda name: made[name])
                total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-total))

        made = F.struct(*[v.alias(k) for k, v in statistics(text).items()])
        return F.transform(F.array(made), of)[0]


def tree_rules(model, names):
    """The paths to all nodes of all trees, without repetition."""
    found = {}

    def walk(node, path):
        if path:
            found.setdefault(shortened(path), None)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, at = names[split.featureIndex()], split.threshold()
            walk(node.leftChild(), (*path, (name, "<=", at)))
            walk(node.rightChild(), (*path, (name, ">", at)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def shortened(path):
    """One bound of a kind per statistic, the tightest, in a fixed order."""
    tight = {}
    for name, sign, at in path:
        key = (name, sign)
        old = tight.get(key, at)
        tight[key] = min(old, at) if sign == "<=" else max(old, at)
    return tuple(sorted((name, sign, at) for (name, sign), at in tight.items()))


def fit_rules(docs, labels, label="quality", sample=SAMPLE, trees=TREES, depth=DEPTH,
              lasso=LASSO, seed=7):
    """Learn from at most ``sample`` labelled documents, chosen by a hash of the id.

    Labels other than 0 and 1 are not used, nor is an id labelled with both.  Of several
    texts of one id the least, by its bytes, is learned from, so each id counts once.  With
    labels of one kind or none the model is a constant: that label's, or one half.
    """
    distinct = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).cast("double").alias("_label"), F.max(label).cast("double").alias("_other")) \
        .filter("_label = _other").select("doc_id", "_label", F.xxhash64("doc_id").alias("_h"))
    size = distinct.count()
    chosen = distinct.filter(surely_least("_h", sample, F.lit(float(max(size, 1))))) \
        .orderBy("_h", "doc_id").limit(sample).drop("_h")
    # At most ``sample`` rows of two numbers.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id") \
        .groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    names = list(statistics())
    table = stored(with_statistics(rows).select("_label", *["_stat_" + n for n in names])).coalesce(4)
    kinds = {r[0]: r[1] for r in table.groupBy("_label").count().collect()}
    if len(kinds) < 2:
        sure = {None: 0.0, 0.0: -20.0, 1.0: 20.0}[next(iter(kinds), None)]
        return RuleModel(sure, ())
    assembled = VectorAssembler(inputCols=["_stat_" + n for n in names], outputCol="_in").transform(table)
    forest = RandomForestClassifier(
        featuresCol="_in", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed,
        featureSubsetStrategy="onethird").fit(assembled)
    rules = tree_rules(forest, names)
    plain = RuleModel(0.0, ())
    hits = table.select("_label", array_to_vector(F.array(*[
        F.when(plain.condition(r), 1.0).otherwise(0.0) for r in rules])).alias("_hits"))
    fitted = LogisticRegression(
        featuresCol="_hits", labelCol="_label", elasticNetParam=1.0, regParam=lasso, maxIter=60,
        standardization=False).fit(hits.persist())
    hits.unpersist()
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(float(fitted.intercept), tuple(
        (w, r) for w, r in zip(weights, rules, strict=True) if w))


def score_documents(docs, model, text="text", score="score", predicted="predicted"):
    """Add ``score`` (0 to 1, null and empty texts too) and ``predicted`` (1 from 0.5).

    The two may be given other names; a name that the table has already raises.  Repeated
    rows are scored alike and stay repeated; an empty table stays empty.
    """
    for name in (score, predicted):
        if free_name(docs, name) != name:
            raise ValueError(f"the table already has a column {name}")
    scored = docs.withColumn(score, model.score(text))
    return scored.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
