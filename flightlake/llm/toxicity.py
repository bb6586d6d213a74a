"""Toxic passages as maximum-scoring segments of token log-odds.

Token weights are log-odds with Dirichlet priors: a word's share of toxic occurrences is drawn
towards that of its longer prefix, the prefix's towards that of a shorter one, and so on to the
share of all tokens.  A linear-time scan (all maximal scoring segments) finds every passage whose
sum of weights stands out; extreme-value statistics, fitted on clean training texts, turn the best
sum of a text of n tokens into the number of such passages that chance would give.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, table

#: Buckets of the hashed token table: its size is fixed, whatever the corpus holds.
BUCKETS = 1 << 19
#: Prefix lengths that a word's share is drawn towards, shortest first; the word itself is last.
PREFIXES = (4, 5, 6)
#: Weight of the prior, in occurrences, at each step from prefix to word.
PRIOR = 6.0
#: Standard deviations at which a token's log-odds counts; other tokens only cost DRIFT.
Z = 2.5
#: Least log-odds that count; frequent harmless words differ by less.
LEAST_ODDS = 1.5
DRIFT = 0.04
#: Most labelled rows that the model is fitted on, chosen by a hash of doc_id.
MAX_TRAINING_ROWS = 50_000
#: Share of the clean calibration texts with the largest sums (mislabelled ones) that the extreme-value law is not fitted on.
TRIMMED = 0.01
TOKEN = re.compile(r"\w+")
#: A passage is significant if chance gives fewer than this many per text.
SIGNIFICANT_E = 0.05
_MEMO = 100_000


def _bucket(kind: str, token: str) -> int:
    return zlib.crc32(f"{kind}{token}".encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _chain(token: str) -> list[int]:
    """Buckets of the prefixes of a word and of the word, least special first."""
    return [_bucket(f"{n}:", token[:n]) for n in PREFIXES if len(token) > n] + [_bucket("w:", token)]


@dataclass
class Model:
    """Weights by bucket and the calibration; of bounded size, sent to every executor."""

    toxic: object  # float32 counts by bucket, toxic texts
    clean: object  # the same, other texts
    base: float  # share of toxic tokens among all
    rate: float = 1.0  # lambda of the extreme-value law
    k: float = 0.1  # K of the extreme-value law
    logistic: tuple = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.memo: dict[str, float] = {}
        self.base_odds = math.log(self.base / (1 - self.base))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ = state | {"memo": {}}

    def weight(self, token: str) -> float:
        w = self.memo.get(token)
        if w is None:
            share, t, n = self.base, 0.0, 0.0
            for b in _chain(token):
                t, n = float(self.toxic[b]), float(self.clean[b])
                prior_t, prior_n = PRIOR * share, PRIOR * (1 - share)
                share = (t + prior_t) / (t + n + PRIOR)
            odds = math.log(share / (1 - share)) - self.base_odds
            spread = 1 / (t + prior_t) + 1 / (n + prior_n)
            w = (odds if abs(odds) >= max(LEAST_ODDS, Z * math.sqrt(spread)) else 0.0) - DRIFT
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[token] = w
        return w

    def passages(self, text: str):
        """(start, end, sum, expected by chance) of every maximal segment, and the number of tokens."""
        spots = [(m.start(), m.end()) for m in TOKEN.finditer(text.lower())] if len(text.lower()) == len(text) else [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        weights = [self.weight(text[a:b].lower()) for a, b in spots]
        n = max(1, len(weights))
        found = maximal_segments(weights)
        return [(spots[a][0], spots[b - 1][1], s, self.expected(s, n)) for a, b, s in found], n

    def expected(self, score: float, n: int) -> float:
        return self.k * n * math.exp(-min(700.0, self.rate * score))

    def best(self, text: str) -> tuple[float, float]:
        """Number of tokens, and the largest sum of a passage."""
        weights = [self.weight(t) for t in TOKEN.findall(text.lower())]
        return max(1, len(weights)), max((s for _, _, s in maximal_segments(weights)), default=0.0)

    def features(self, text: str) -> tuple[float, float]:
        """Of the best passage, minus log E; and the sum of the same over all significant passages."""
        weights = [self.weight(t) for t in TOKEN.findall(text.lower())]
        n = max(1, len(weights))
        best, total = 0.0, 0.0
        logs = [self.rate * s - math.log(self.k * n) for _, _, s in maximal_segments(weights)]
        if logs:
            best = max(logs)
            total = sum(x for x in logs if x > -math.log(SIGNIFICANT_E))
        return min(best, 60.0) if logs else -math.log(self.k * n) - 1.0, math.log1p(max(0.0, total))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.logistic[0] + self.logistic[1] * a + self.logistic[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def maximal_segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in linear time.

    Candidates are kept with the sums before and after them; a new positive run joins back to the
    nearest candidate with a smaller sum before it if the sum after it is no smaller than its own.
    """
    total, kept = 0.0, []  # kept: [start, end, sum before, sum after, index of nearest smaller before]
    i, n = 0, len(weights)
    while i < n:
        w = weights[i]
        if w <= 0:
            total += w
            i += 1
            continue
        new = [i, i + 1, total, total + w, -1]
        total += w
        i += 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], kept[j][4]]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def _counts(labelled: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): texts of ``labelled`` (text, toxic) that hold a token of the bucket; summed per task first.

    A text counts once for a token, so that lines repeated in one text do not pass for evidence.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        sums = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            memo: dict[str, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                at: set[int] = set()
                for w in set(TOKEN.findall((text or "").lower())):
                    if w not in memo:
                        if len(memo) >= _MEMO:
                            memo.clear()
                        memo[w] = _chain(w)
                    at.update(memo[w])
                sums[0 if toxic else 1, list(at)] += 1
        used = np.flatnonzero(sums.sum(0))
        yield pd.DataFrame({"bucket": used, "toxic": sums[0, used], "clean": sums[1, used]})

    parts = labelled.select("text", "toxic").mapInPandas(run, "bucket long, toxic long, clean long")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _newton(x, y, rounds: int = 30):
    """Logistic regression on a few columns by Newton's method, lightly held to small weights."""
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1e-2
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, training: str, max_rows: int = MAX_TRAINING_ROWS, trimmed: float = TRIMMED) -> Model:
    """Fit on the labelled rows of ``docs`` (doc_id, text) that satisfy the SQL condition ``training``.

    At most ``max_rows`` labels are used, chosen by a hash of doc_id; four fifths of them give the
    counts, one fifth the calibration, of which the driver sees a few numbers for each text.  The share ``trimmed`` of the
    clean calibration texts with the largest sums is left out of the extreme-value law.  Without a row of each class every
    score is the prior.  Of repeated labels the toxic one counts; null ids and labels do not.
    """
    import numpy as np

    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(training)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows labels
    counts = _counts(rows.where("pmod(h, 5) <> 0")).toPandas()  # at most BUCKETS rows
    toxic, clean = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    toxic[counts["bucket"]], clean[counts["bucket"]] = counts["toxic"], counts["clean"]
    t, c = float(toxic.sum()), float(clean.sum())
    model = Model(toxic, clean, base=(t + 1) / (t + c + 10))
    held = rows.where("pmod(h, 5) = 0")
    best = _of_texts(held, model, lambda m, text: m.best(text), "n double, best double")
    if best["toxic"].nunique() < 2:
        rate = (t + 1) / (t + c + 10)
        model.logistic = (math.log(rate / (1 - rate)), 0.0, 0.0)
        return model
    quiet = best[best["toxic"] == 0]
    model.rate, model.k = extreme_value_law(quiet["best"].to_numpy(), quiet["n"].to_numpy(), trimmed)
    x = _of_texts(held, model, lambda m, text: m.features(text), "a double, b double")
    model.logistic = _newton(x[["a", "b"]].to_numpy(), x["toxic"].to_numpy(float))
    return model


def _of_texts(rows: DataFrame, model: Model, numbers, schema: str):
    """(toxic, numbers...) of each text of ``rows``, on the driver: a fifth of at most max_rows rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = pd.DataFrame([numbers(sent.value, text or "") for text in pdf["text"]], columns=names, dtype="float64")
            out.insert(0, "toxic", pdf["toxic"].array)
            yield out

    return rows.select("text", "toxic").mapInPandas(run, f"toxic int, {schema}").toPandas()


def extreme_value_law(best, n, trimmed: float = 0.0) -> tuple[float, float]:
    """(rate, K): a text of n tokens has K n exp(-rate s) passages of sum s or more by chance.

    The best sum S of such a text has S - ln(n) / rate with mean (ln K + gamma) / rate and standard deviation
    pi / (rate sqrt 6); the rate is the fixed point of that.
    """
    import numpy as np

    part = best <= np.quantile(best, 1 - trimmed)
    best, n = best[part], n[part]
    rate = 1.0
    for _ in range(50):
        rate = math.pi / (math.sqrt(6) * max(0.2, float(np.std(best - np.log(n) / rate))))
    return rate, math.exp(min(20.0, max(-20.0, rate * float(np.mean(best - np.log(n) / rate)) - 0.5772156649)))


PASSAGES = "array<struct<start: int, end: int, sum: double, expected: double>>"


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, with_passages: bool = False) -> DataFrame:
    """Columns ``carry`` (doc_id if none are named) and score[, passages] for every row of (doc_id, text, ...).

    passages: array of (start, end, sum, expected) of the significant ones.  Whole texts are scanned.  A null or
    empty text is scored as one without passages.  Repeated rows come out repeated, a null doc_id stays null,
    other columns are not read.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or ["doc_id"]
    # a text that is carried anyway is not sent twice
    text = "text" if "text" in carry else "_text"
    rows = docs.select(*carry) if text == "text" else docs.select(*carry, docs["text"].alias(text))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry) + ", score double"
    schema += f", passages {PASSAGES}" if with_passages else ""

    def run(batches):
        m = sent.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in carry] + [pa.array([m.score(t) for t in texts], pa.float64())]
            names = [*carry, "score"]
            if with_passages:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sum", pa.float64()), ("expected", pa.float64())]))
                spans = [[{"start": a, "end": b, "sum": s, "expected": e} for a, b, s, e in m.passages(t)[0] if e < SIGNIFICANT_E] for t in texts]
                columns, names = [*columns, pa.array(spans, kind)], [*names, "passages"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


TRAINING = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"


def op4_toxicity(spark, sf_dir) -> DataFrame:
    """One row for each row of ``documents``: a null text is scored as empty, a null doc_id stays null with a null held_out; repeated rows come out repeated."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels, TRAINING))
    return out.select(
        "doc_id",
        F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
