"""Text quality by a sparse ensemble of rules over text statistics.

Each text gives a few dozen numbers in one pass.  A forest of shallow trees is grown on labelled rows; every path from a
root to a node is a conjunction of bounds on statistics.  A logistic regression with a lasso penalty weighs the
distinct conjunctions, most of which get no weight; the strength of the penalty is the one with the least log loss on a
fifth of the labelled rows that the weights were not fitted on.  What is left is compiled into one Spark column.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, table

#: Most labelled rows that the model is fitted on, chosen by a hash of doc_id.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, LEAST_PER_NODE = 30, 3, 5
#: Strengths of the penalty that are tried.
PENALTIES = (0.01, 0.003, 0.001)
MOST_STEPS, TOLERANCE = 40, 1e-4
#: Weights below this share of the largest count as none.
LEAST_WEIGHT = 1e-6

STATISTICS = [
    "chars", "words", "lines", "word_length", "longest_word", "line_length", "letters", "others", "capitals", "digits", "stops", "symbols", "brackets", "spaces",
    "distinct_words", "commonest_word", "distinct_pairs", "distinct_lines", "commonest_line", "sound_words", "symbol_ends", "entropy", "longest_repeat",
]

_SOUND = re.compile(r"(?<!\S)[^\W\d_]+[.,;:!?]?(?!\S)")
_SYMBOL_END = re.compile(r"[#$%&*+/<=>@\\^_`|~!?]{2}(?!\S)")


def _tables():
    import numpy as np

    kind = np.zeros((7, 256))
    for row, signs in enumerate((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0xC2, 0xF5)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"-", b"#$%&*+/<=>@\\^_`|~", b"()[]{}")):
        kind[row, list(signs)] = 1
    return kind


def _numbers(text: str, kind) -> list[float]:
    """The statistics of one text; shares of nothing are zero."""
    import numpy as np

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    histogram = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    n, chars = max(1, len(words)), len(text)
    sums = (kind @ histogram).tolist()
    letters = max(1.0, sums[0] + sums[1])
    times: dict[str, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    of_lines: dict[str, int] = {}
    for x in lines:
        if x:
            of_lines[x] = of_lines.get(x, 0) + 1
    filled = max(1, sum(of_lines.values()))
    share = histogram[histogram > 0] / len(raw)
    changes = np.flatnonzero(raw[1:] != raw[:-1])
    repeat = int(np.diff(np.concatenate([[-1], changes, [len(raw) - 1]])).max())
    return [
        float(chars), float(len(words)), float(len(lines)), sum(map(len, words)) / n, float(max(map(len, words), default=0)), chars / len(lines),
        sums[0] / chars, sums[1] / chars, sums[2] / letters, sums[3] / chars, sums[4] / chars, sums[5] / chars, sums[6] / chars, (histogram[32] + histogram[9:14].sum()) / chars,
        len(times) / n, max(times.values(), default=0) / n, len(set(zip(words, words[1:]))) / max(1, len(words) - 1), len(of_lines) / filled, max(of_lines.values(), default=0) / filled,
        len(_SOUND.findall(text)) / n, len(_SYMBOL_END.findall(text)) / n, float(-(share * np.log2(share)).sum()), float(repeat),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) of every row of ``docs`` (doc_id, text): whole texts, null as empty; other columns are not read."""
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        kind = _tables()
        for batch in batches:
            found = [_numbers(t or "", kind) for t in batch.column("text").to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64()) for _ in STATISTICS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *STATISTICS])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction: each named statistic lies above the low and not above the high bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        test = F.lit(True)
        for name, low, high in self.bounds:
            test = test & (F.col(name) > low) if low > -math.inf else test
            test = test & (F.col(name) <= high) if high < math.inf else test
        return test

    def holds(self, numbers: dict[str, float]) -> bool:
        return all(low < numbers[name] <= high for name, low, high in self.bounds)


def rules_of(model) -> list[Rule]:
    """The distinct conjunctions on the paths from the roots of a forest to its nodes."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[int, tuple[float, float]]):
        if bounds:
            found[Rule(tuple((STATISTICS[i], *bounds[i]) for i in sorted(bounds)))] = None
        if node.subtreeDepth() == 0:
            return
        i, at = node.split().featureIndex(), node.split().threshold()
        low, high = bounds.get(i, (-math.inf, math.inf))
        walk(node.leftChild(), bounds | {i: (low, min(high, at))})
        walk(node.rightChild(), bounds | {i: (max(low, at), high)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


@dataclass
class Model:
    """Rules with their weights, and the log-odds of a text that none of them holds for."""

    base: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def column(self) -> Column:
        """The score as a column over the statistics."""
        odds = F.lit(self.base)
        for rule, w in self.weights.items():
            odds = odds + F.when(rule.column(), w).otherwise(0.0)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))

    def score(self, numbers: dict[str, float]) -> float:
        odds = self.base + sum(w for rule, w in self.weights.items() if rule.holds(numbers))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit(numbers: DataFrame, labels: DataFrame, training: str, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on the rows of ``numbers`` (of ``statistics``) with a label (doc_id, quality) that satisfies the SQL condition ``training``.

    At most ``max_rows`` labels are used, chosen by a hash of doc_id.  Of repeated labels the highest counts; null ids and
    labels do not.  Without a row of each class every score is the share of the class, drawn towards one half.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(training)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    known = materialize(numbers.join(F.broadcast(chosen), "doc_id"), "labelled")  # at most max_rows labels
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = math.log((good + 1) / (n - good + 1))
    if good in (0, n):
        return Model(prior)
    trees = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_PER_NODE, seed=13)
    rules = rules_of(trees.fit(known.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"))))
    if not rules:
        return Model(prior)
    held = F.array(*(r.column().cast("double") for r in rules))
    rows = materialize(known.select("label", "h", held.alias("held")), "rules")
    rows = rows.select("label", array_to_vector("held").alias("x"), (F.pmod("h", F.lit(5)) == 0).alias("aside"))
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, maxIter=MOST_STEPS, tol=TOLERANCE)
    part, aside = rows.where("NOT aside"), rows.where("aside")

    def loss(penalty: float) -> float:
        p = F.greatest(F.lit(1e-9), vector_to_array("probability")[F.col("label").cast("int")])
        scored = lasso.copy({lasso.regParam: penalty}).fit(part).transform(aside)
        return scored.agg(F.coalesce(F.avg(-F.log(p)), F.lit(0.0))).first()[0]

    classes = part.agg(F.count_distinct("label")).first()[0]
    penalty = min(PENALTIES, key=lambda x: (loss(x), -x)) if classes == 2 else PENALTIES[0]
    fitted = lasso.copy({lasso.regParam: penalty}).fit(rows)
    weights = fitted.coefficients.toArray().tolist()
    least = LEAST_WEIGHT * max(map(abs, weights))
    return Model(float(fitted.intercept), {r: w for r, w in zip(rules, weights) if abs(w) > least})


def score(numbers: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``statistics``; repeated rows come out repeated, a null doc_id stays null."""
    return numbers.select("doc_id", model.column().alias("score"))


TRAINING = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"


def op13_quality(spark, sf_dir) -> DataFrame:
    """One row for each row of ``documents``: a null text is scored as empty, a null doc_id stays null with a null held_out; an empty table gives an empty result."""
    numbers = materialize(statistics(table(spark, sf_dir, "documents")), "statistics")
    out = score(numbers, fit(numbers, table(spark, sf_dir, "labels"), TRAINING))
    return out.select("doc_id", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
