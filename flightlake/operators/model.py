"""Two small regression networks: inference in Arrow batches, one training task per fold and network.

Weights are a table (network, layer, weight, bias), small and of fixed size (about 5,000 numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import is_finite
from ..schema import LATERAL_FEATURES, LATERAL_LABELS, LONGITUDINAL_FEATURES, LONGITUDINAL_LABELS
from .profile import required_columns

HIDDEN = 64
# Inputs, outputs and the activation of each output.
NETWORKS = {"lateral": (11, ("linear", "linear")), "longitudinal": (12, ("linear", "sigmoid"))}
# The optimiser's settings.
TRAINING = {"seed": 42, "lr": 1e-3, "weight_decay": 1e-4, "batch": 256, "epochs": 300, "patience": 25, "clip": 5.0, "improve": 1e-9}
WEIGHTS = "layer int, weight array<array<double>>, bias array<double>"


def start_weights(inputs: int, outputs: int, seed: int):
    """Uniform within one over the root of a layer's inputs."""
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = [inputs, HIDDEN, HIDDEN, outputs]
    return [(rng.uniform(-1, 1, (a, b)) / a**0.5, rng.uniform(-1, 1, b) / a**0.5) for a, b in zip(sizes, sizes[1:])]


def forward(x, weights, activations):
    """Outputs, and what the backward pass needs."""
    import numpy as np

    kept, h = [], x
    for w, b in weights[:-1]:
        z = h @ w + b
        s = 1 / (1 + np.exp(-z))
        kept.append((h, z, s))
        h = z * s
    z = h @ weights[-1][0] + weights[-1][1]
    kept.append((h, z, None))
    squash = np.array([a == "sigmoid" for a in activations])
    return np.where(squash, 1 / (1 + np.exp(-z)), z), kept


def gradients(y, target, kept, weights, activations):
    """Of the mean squared error over all outputs."""
    import numpy as np

    squash = np.array([a == "sigmoid" for a in activations])
    d = 2 * (y - target) / target.size * np.where(squash, y * (1 - y), 1.0)
    out = []
    for k in range(len(weights) - 1, -1, -1):
        h = kept[k][0]
        out.append((h.T @ d, d.sum(0)))
        if k:
            _, z, s = kept[k - 1]
            d = (d @ weights[k][0].T) * (s * (1 + z * (1 - s)))
    return out[::-1]


class AdamW:
    """The optimiser's state for one network: weights as a flat list of arrays, moments, and the number of steps."""

    def __init__(self, weights, cfg: dict = TRAINING):
        import numpy as np

        self.cfg, self.flat, self.t = cfg, [a for pair in weights for a in pair], 0
        self.m, self.v = [np.zeros_like(a) for a in self.flat], [np.zeros_like(a) for a in self.flat]

    @property
    def weights(self):
        return list(zip(self.flat[::2], self.flat[1::2]))

    def step(self, g) -> None:
        """One step along the gradients ``g`` (in the order of ``flat``), whose norm is clipped."""
        import numpy as np

        cfg, norm = self.cfg, np.sqrt(sum(float((a * a).sum()) for a in g))
        shrink = min(1.0, cfg["clip"] / (norm + 1e-6))
        self.t += 1
        for i, a in enumerate(g):
            a = a * shrink
            self.m[i] = 0.9 * self.m[i] + 0.1 * a
            self.v[i] = 0.999 * self.v[i] + 0.001 * a * a
            self.flat[i] = self.flat[i] * (1 - cfg["lr"] * cfg["weight_decay"]) - cfg["lr"] * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def train(x, y, xv, yv, activations, epochs: int | None = None, cfg: dict = TRAINING):
    """AdamW on batches; early stop on the validation loss, or a fixed number of epochs without one."""
    import numpy as np

    rng = np.random.default_rng(cfg["seed"])
    state = AdamW(start_weights(x.shape[1], y.shape[1], cfg["seed"]), cfg)
    best = (float("inf"), 0, [a.copy() for a in state.flat])
    waited, history = 0, []
    for epoch in range(epochs or cfg["epochs"]):
        order, losses = rng.permutation(len(x)), []
        for at in range(0, len(order), cfg["batch"]):
            part = order[at : at + cfg["batch"]]
            out, kept = forward(x[part], state.weights, activations)
            losses.append(float(np.mean((out - y[part]) ** 2)))
            state.step([a for pair in gradients(out, y[part], kept, state.weights, activations) for a in pair])
        loss = float(np.mean((forward(xv, state.weights, activations)[0] - yv) ** 2)) if xv is not None and len(xv) else float("nan")
        history.append((epoch, float(np.mean(losses)), loss))
        if xv is None or not len(xv):
            best = (loss, epoch, state.flat)
        elif loss < best[0] - cfg["improve"]:
            best, waited = (loss, epoch, [a.copy() for a in state.flat]), 0
        elif (waited := waited + 1) >= cfg["patience"]:
            break
    return list(zip(best[2][::2], best[2][1::2])), best[1], best[0], history


#: Most rows of each fold and role that a network is fitted on.
MAX_ROWS = 200_000


def bounded(rows: DataFrame, by: list[str], columns: list[str], most: int = MAX_ROWS) -> DataFrame:
    """All rows of a group of up to ``most``; of a larger one about that many, chosen by a hash of the row."""
    share = rows.groupBy(*by).agg((F.lit(float(most)) / F.count("*")).alias("_share"))
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(share, by).where((F.col("_share") >= 1) | (place < F.col("_share"))).drop("_share")


def split(table: DataFrame, network: str) -> DataFrame:
    """Rows of a feature table as (meta..., x array<float>, y array<float>) in the network's fixed order of columns.

    A missing column is an error; so is a value that is no finite number, found when the rows are read.
    """
    features, labels = (LATERAL_FEATURES, LATERAL_LABELS) if network == "lateral" else (LONGITUDINAL_FEATURES, LONGITUDINAL_LABELS)
    short = network[:3]
    named = {"x": [f"{short}__{f}" for f in features], "y": [f"{short}y__{f}" for f in labels]}
    required_columns(table, [c for cs in named.values() for c in cs])

    def array(columns: list[str]):
        good = lambda c: F.when(F.coalesce(is_finite(F.col(c).cast("double")), F.lit(False)), F.col(c).cast("float")).otherwise(F.raise_error(F.lit(f"{c} is no finite number")).cast("float"))
        return F.array(*map(good, columns))

    meta = [c for c in table.columns if "__" not in c]
    return table.select(*meta, *[array(cs).alias(n) for n, cs in named.items()])


def fit(rows: DataFrame, network: str, features: list[str], labels: list[str], epochs: int | None = None, most: int = MAX_ROWS) -> DataFrame:
    """(fold_id, network, best_epoch, best_val_loss, layer, weight, bias): one independent task per fold.

    rows: fold_id, role (train or val), features and labels.  A fold is fitted on at most about ``most`` rows of each role,
    chosen by a hash of the row, so what one task holds is bounded; folds run side by side.
    """
    import pandas as pd

    n, activations = NETWORKS[network]
    if len(features) != n or len(labels) != len(activations):
        raise ValueError(f"{network} takes {n} inputs and {len(activations)} labels")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values([*features, *labels], kind="stable")
        part = {r: (g[features].to_numpy(float), g[labels].to_numpy(float)) for r, g in pdf.groupby("role")}
        x, y = part["train"]
        xv, yv = part.get("val", (None, None))
        if not all(np.isfinite(a).all() for a in (x, y)):
            raise ValueError("training rows must be finite")
        weights, epoch, loss, _ = train(x, y, xv, yv, activations, epochs)
        return pd.DataFrame([(int(pdf["fold_id"].iloc[0]), network, epoch, loss, k, w.tolist(), b.tolist()) for k, (w, b) in enumerate(weights)], columns=["fold_id", "network", "best_epoch", "best_val_loss", "layer", "weight", "bias"])

    used = bounded(rows.select("fold_id", "role", *features, *labels), ["fold_id", "role"], [*features, *labels], most)
    return used.groupBy("fold_id").applyInPandas(run, f"fold_id int, network string, best_epoch int, best_val_loss double, {WEIGHTS}")


def gradient_sums(data: DataFrame, states: dict[int, list], activations: tuple[str, ...], batch: int | None) -> dict:
    """fold -> (gradients summed over its training rows of ``batch``, their number, squared error and number of its validating rows).

    data: fold, batch, x and y (arrays).  Each task adds up its own rows for every fold; these sums, a fixed number for each task, are
    added by Spark, and the driver gets one row for each number of a network.  With no ``batch`` only errors are summed.
    """
    import numpy as np

    sent = data.sparkSession.sparkContext.broadcast(states)

    def run(batches):
        import pandas as pd

        folds, sums = sent.value, {}
        for pdf in batches:
            x, y = np.stack(pdf["x"]), np.stack(pdf["y"])
            mine, part = pdf["fold"].to_numpy(), pdf["batch"].to_numpy()
            for f, weights in folds.items():
                total = sums.setdefault(f, [np.zeros(sum(a.size for w in weights for a in w)), 0, 0.0, 0])
                held, used = mine == f, (mine != f) & (part == batch)
                if held.any() and (batch is None or batch == 0):
                    total[2] += float(((forward(x[held], weights, activations)[0] - y[held]) ** 2).sum())
                    total[3] += int(held.sum())
                if batch is not None and used.any():
                    out, kept = forward(x[used], weights, activations)
                    g = gradients(out, y[used], kept, weights, activations)  # of the mean: times the number of values it is the sum
                    total[0] += np.concatenate([a.ravel() for pair in g for a in pair]) * y[used].size
                    total[1] += int(used.sum())
        for f, (g, n, error, held) in sums.items():
            yield pd.DataFrame({"fold": f, "place": np.arange(-3, len(g)), "v": np.concatenate([[n, error, held], g])})

    parts = data.mapInPandas(run, "fold int, place int, v double").groupBy("fold", "place").agg(F.sum("v").alias("v"))
    got = parts.toPandas()  # a fixed number of rows for each fold
    out = {}
    for f, rows in got.sort_values("place").groupby("fold"):
        v = rows["v"].to_numpy()
        out[int(f)] = (v[3:], int(v[0]), float(v[1]), int(v[2]))
    sent.destroy()
    return out


def fit_shared(rows: DataFrame, network: str, features: list[str], labels: list[str], epochs: int | None = None, batches: int = 1, cfg: dict = TRAINING) -> DataFrame:
    """(fold_id, network, best_epoch, best_val_loss, layer, weight, bias), fitted on all rows, which stay where they are.

    rows: fold (the fold that a row validates; it trains all others, and with a null every one), features and labels.  Every step is one
    job over all folds at once: tasks sum gradients, the driver adds a step to each fold's few thousand weights.  A row's batch
    is told by a hash of its values, so an epoch takes ``batches`` steps whatever the number of rows.  Early stop as in ``train``.
    """
    import numpy as np

    n, activations = NETWORKS[network]
    if len(features) != n or len(labels) != len(activations):
        raise ValueError(f"{network} takes {n} inputs and {len(activations)} labels")
    number = lambda c: F.when(F.coalesce(is_finite(F.col(c).cast("double")), F.lit(False)), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(f"{c} is no finite number")).cast("double"))
    data = rows.select(
        F.coalesce(F.col("fold").cast("int"), F.lit(-1)).alias("fold"), batch_of([*features, *labels], batches).alias("batch"), F.array(*map(number, features)).alias("x"), F.array(*map(number, labels)).alias("y")
    ).persist()
    try:
        folds = sorted(r.fold for r in data.select("fold").distinct().collect() if r.fold >= 0) or [-2]  # -2: no row validates
        states = {f: AdamW(start_weights(n, len(labels), cfg["seed"]), cfg) for f in folds}
        best = {f: (float("inf"), 0, states[f].flat) for f in folds}
        waited = dict.fromkeys(folds, 0)

        def judged(sums, epoch):
            """Takes the validation losses after ``epoch``; folds that wait too long are done."""
            for f, (_, _, error, held) in sums.items():
                loss = error / (held * len(labels)) if held else float("nan")
                if not held:
                    best[f] = (loss, epoch, [a.copy() for a in states[f].flat])
                elif loss < best[f][0] - cfg["improve"]:
                    best[f], waited[f] = (loss, epoch, [a.copy() for a in states[f].flat]), 0
                else:
                    waited[f] += 1

        def current():
            return {f: s.weights for f, s in states.items() if waited[f] < cfg["patience"]}

        for epoch in range(epochs or cfg["epochs"]):
            for b in range(batches):
                sums = gradient_sums(data, current(), activations, b)
                if b == 0 and epoch:
                    judged(sums, epoch - 1)
                for f in current():
                    g, used, _, _ = sums.get(f, (None, 0, 0.0, 0))
                    if used:
                        states[f].step(_shaped(g / (used * len(labels)), states[f].flat))
                if not current():
                    break
            if not current():
                break
        else:
            judged(gradient_sums(data, current(), activations, None), (epochs or cfg["epochs"]) - 1)
    finally:
        data.unpersist()
    out = [(f, network, int(best[f][1]), float(best[f][0]), k, w.tolist(), b.tolist()) for f in folds for k, (w, b) in enumerate(zip(best[f][2][::2], best[f][2][1::2]))]
    return rows.sparkSession.createDataFrame(out, f"fold_id int, network string, best_epoch int, best_val_loss double, {WEIGHTS}")  # three rows for each fold


def batch_of(columns: list[str], batches: int):
    """The batch of a row, by a hash of its values."""
    return F.pmod(F.xxhash64(*columns), F.lit(batches)).cast("int")


def _shaped(flat, like: list) -> list:
    """A vector cut into arrays of the shapes of ``like``."""
    import numpy as np

    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, ends[:-1]), like)]


def manifest(epochs: dict[str, int], features: dict[str, list[str]], labels: dict[str, list[str]]) -> str:
    """A JSON document of the networks: layers, activations, column orders and training settings."""
    import json

    nets = {
        n: {
            "layers": [inputs, HIDDEN, HIDDEN, len(act)],
            "hidden_activation": "silu",
            "output_activation": list(act),
            "features": features[n],
            "labels": labels[n],
            "epochs": epochs.get(n),
        }
        for n, (inputs, act) in NETWORKS.items()
    }
    return json.dumps({"networks": nets, "training": TRAINING}, indent=2, sort_keys=True)


def load_weights(weights: DataFrame, network: str, features: list[str], labels: list[str] | None = None) -> list:
    """[(weight, bias), ...] of one network; its shape is checked, and the order of its labels if they are given."""
    import numpy as np

    rows = sorted(weights.select("layer", "weight", "bias").collect(), key=lambda r: r.layer)  # three rows of fixed size
    out = [(np.array(r.weight), np.array(r.bias)) for r in rows]
    n, activations = NETWORKS[network]
    shapes = [w.shape for w, _ in out]
    if shapes != [(n, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN, len(activations))] or len(features) != n:
        raise ValueError(f"{network}: unexpected shapes {shapes}")
    fixed = LATERAL_LABELS if network == "lateral" else LONGITUDINAL_LABELS
    if labels is not None and list(labels) != fixed:
        raise ValueError(f"{network}: labels {labels} are not in the order {fixed}")
    return out


def predict(df: DataFrame, weights: list, features: list[str], outputs: list[str], activations: tuple[str, ...]) -> DataFrame:
    """Adds one column per output, computed in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join(f"{o} double" for o in outputs)

    @F.pandas_udf(schema)
    def run(batch):
        import pandas as pd

        y, _ = forward(batch.to_numpy(float), sent.value, activations)
        return pd.DataFrame(y, columns=outputs)

    got = df.withColumn("_y", run(F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])))
    return got.select(*df.columns, *[F.col(f"_y.{o}").alias(o) for o in outputs])


def _unit(inputs):
    """A row (w, b) of a layer applied to an array of inputs."""

    def unit(r):
        return F.aggregate(F.zip_with(inputs, r["w"], lambda x, y: x * y), r["b"], lambda s, x: s + x)

    return unit


def predict_expressions(vector, weights: list, activations: tuple[str, ...]):
    """The same forward pass as column expressions over an array column: stays in the JVM, for small networks."""
    from ..functions.guards import sigmoid, silu

    h = vector
    for k, (w, b) in enumerate(weights):
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w[:, j]]).alias("w"), F.lit(float(b[j])).alias("b")) for j in range(w.shape[1])])

        z = F.transform(rows, _unit(h))
        h = F.transform(z, silu) if k < len(weights) - 1 else z
    return [sigmoid(h[i]) if a == "sigmoid" else h[i] for i, a in enumerate(activations)]
