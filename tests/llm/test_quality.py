"""The rule ensemble: held-out accuracy, compiled columns against plain evaluation, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from flightlake.llm import quality

SCHEMA = "doc_id long, text string, score string, words string"
LABELS = "doc_id long, quality int, toxic int"


def made(n, seed=1):
    """(doc_id, text, good): prose, and four kinds of junk."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.6
        if good:
            text = " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))
        else:
            text = rng.choice([lambda: " | ".join(words), lambda: "!! ".join(words).upper(), lambda: " ".join(words[:1] * 40), lambda: "### ".join(words)])()
        out.append((i, text, good))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made(1500)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows], LABELS)
    numbers = quality.statistics(docs)
    return rows, numbers, quality.fit(numbers, labels, quality.TRAINING)


def test_held_out_rows_are_told_apart(fitted):
    rows, numbers, model = fitted
    good = {i: g for i, _, g in rows}
    held = quality.score(numbers, model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    assert len(held) > 400 and sum((r.score >= 0.5) == good[r.doc_id] for r in held) >= 0.98 * len(held)


def test_weights_are_sparse(fitted):
    _, _, model = fitted
    assert 0 < len(model.weights) < 100 and all(len(r.bounds) <= quality.DEPTH for r in model.weights)


def test_compiled_column_equals_plain_evaluation(fitted):
    _, numbers, model = fitted
    for r in numbers.withColumn("score", model.column()).limit(300).collect():
        assert abs(model.score(r.asDict()) - r.score) < 1e-12


def test_rules_hold_as_their_paths_say(fitted):
    _, numbers, _ = fitted
    rule = quality.Rule((("words", 25.0, 60.0), ("capitals", float("-inf"), 0.5)))
    for r in numbers.select("*", rule.column().alias("held")).collect():
        assert r.held == (25 < r.words <= 60 and r.capitals <= 0.5) == rule.holds(r.asDict())


def test_statistics_of_one_text(spark):
    text = "Ab ab ab.\n#1 é((\n\nab ab ab."
    row = quality.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().asDict()
    want = {"chars": 27, "words": 8, "lines": 4, "longest_word": 3, "letters": 12 / 27, "others": 1 / 27, "capitals": 1 / 13, "digits": 1 / 27, "stops": 2 / 27, "symbols": 1 / 27, "brackets": 2 / 27, "spaces": 8 / 27, "distinct_words": 5 / 8, "commonest_word": 3 / 8, "distinct_lines": 1, "sound_words": 6 / 8, "longest_repeat": 2}
    for name, x in want.items():
        assert row[name] == pytest.approx(x), name


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    data = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, " \n\t"), (4, "Word " * 40_000), (5, "é😀" * 500)]
    got = quality.score(quality.statistics(spark.createDataFrame([(i, t, "a", "b") for i, t in data], SCHEMA)), model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] and len(by[3]) == 1 and None in by
    assert quality.statistics(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0)], [(None, 1, 0), (1, None, 0)], [(1, 0, 0), (2, 1, 0)]])
def test_few_labels_give_the_prior(spark, labels):
    docs = quality.statistics(spark.createDataFrame([(1, "a b c", "", ""), (2, "d e f", "", "")], SCHEMA))
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS), "true")
    assert len({r.score for r in quality.score(docs, model).collect()}) == 1


def test_labels_outside_the_training_rows_change_nothing(spark):
    rows = made(400, 3)
    numbers = quality.statistics(spark.createDataFrame([(i, t, "", "") for i, t, _ in rows], SCHEMA))
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows], LABELS)
    turned = labels.withColumn("quality", F.expr(f"CASE WHEN {quality.TRAINING} THEN quality ELSE 1 - quality END"))
    assert quality.fit(numbers, labels, quality.TRAINING).weights == quality.fit(numbers, turned, quality.TRAINING).weights


def test_query_has_every_row(spark, sf):
    out = quality.op13_quality(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.predicted == (r.score >= 0.5) for r in rows)
