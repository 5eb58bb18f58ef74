"""The neighbour-plus-self graph model: forward, loss, gradients and Adam.

Weights are small and live in the driver; node tables never do.  A layer's
gradient is a small matrix, summed over tasks."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions import metrics
from quiltgraph.operators import linalg
from quiltgraph.phases import phase
from quiltgraph.schema import GraphBundle
from quiltgraph.storage import StateLog, materialize, remove

# The coefficients of Abramowitz and Stegun 7.1.26, which gives erf to 1.5e-7.
ERF_SCALE = 0.3275911
ERF_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + ERF_SCALE * z)
    tail = sum(c * t ** (k + 1) for k, c in enumerate(ERF_TERMS)) * np.exp(-z * z)
    return np.where(x < 0, tail, 2 - tail) / 2


#: Each activation with its slope.
ACTIVATIONS: dict[str, Callable] = {
    "relu": lambda x: np.maximum(x, 0),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "gelu": lambda x: x * normal_cdf(x),
    "none": lambda x: x,
}
SLOPES: dict[str, Callable] = {
    "relu": lambda x: (x > 0).astype(float),
    "elu": lambda x: np.where(x > 0, 1.0, np.exp(np.minimum(x, 0))),
    "gelu": lambda x: normal_cdf(x) + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi),
    "none": np.ones_like,
}

Weights = list[tuple[np.ndarray, ...]]


@dataclass
class GraphModel:
    """Layers of (neighbour weights, self weights); residual projections where widths differ.

    norms: (gain, bias) of a hidden layer's norm; layers without an entry use 1 and 0.
    """

    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str = "relu"
    layer_norm: bool = False
    residual: bool = False
    dropout: float = 0.0
    projections: dict[int, np.ndarray] = field(default_factory=dict)
    norms: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def init(cls, widths: list[int], seed: int = 0, **options) -> GraphModel:
        """Xavier-uniform weights; Kaiming-uniform projections for residuals whose widths differ."""
        rng = np.random.default_rng(seed)
        xavier = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        pairs = list(zip(widths, widths[1:], strict=False))
        model = cls([(xavier(a, b), xavier(a, b)) for a, b in pairs], **options)
        if model.residual:
            model.projections = {i: rng.uniform(-1, 1, p) * np.sqrt(3 / p[0]) for i, p in enumerate(pairs[:-1]) if p[0] != p[1]}
        if model.layer_norm:
            model.norms = {i: (np.ones(b), np.zeros(b)) for i, (_, b) in enumerate(pairs[:-1])}
        return model

    def weights(self) -> Weights:
        """What training changes, for each layer: neighbour, self, then the projection, gain and bias that it has."""
        extra = lambda i: ((self.projections[i],) if self.residual and i in self.projections else ()) + (self.norms[i] if self.layer_norm and i in self.norms else ())
        return [(*pair, *extra(i)) for i, pair in enumerate(self.layers)]

    def set_weights(self, weights: Weights) -> None:
        self.layers = [(w[0], w[1]) for w in weights]
        for i, (_, _, *rest) in enumerate(weights):
            if self.residual and i in self.projections:
                self.projections[i] = rest.pop(0)
            if rest:
                self.norms[i] = (rest[0], rest[1])


def _rows(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], column: str = "features") -> DataFrame:
    """(node_id, features) with features = fn(features, ids), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"node_id": pdf["node_id"], "features": list(fn(np.stack(pdf[column].to_numpy()).astype(float), pdf["node_id"].to_numpy()))})

    return df.select("node_id", column).mapInPandas(run, "node_id bigint, features array<double>")


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    mean = x.mean(1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(1, keepdims=True) + eps)


def uniform(ids: np.ndarray, width: int, epoch: int, layer: int) -> np.ndarray:
    """A number from 0 to 1 for each id and feature, the same however rows are batched."""
    x = np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03)
    x += np.full(1, (epoch << 20 | layer) + 1, np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)) / 2.0**64


def _convolve(model: GraphModel, i: int, graph: DataFrame, h: DataFrame) -> DataFrame:
    """(node_id, features): layer i before its activation, with its residual."""
    wn, ws = model.layers[i]
    out = linalg.sage_conv(graph, h, wn, ws)
    if model.residual and i < len(model.layers) - 1:
        before = linalg.project(h, model.projections[i]) if i in model.projections else h.select("node_id", F.transform("features", lambda v: v.cast("double")).alias("features"))
        out = linalg.sum_arrays(out.unionByName(before), "node_id", wn.shape[1])
    return out


def _gate(model: GraphModel, ids: np.ndarray, width: int, epoch: int | None, i: int) -> np.ndarray | float:
    """What dropout multiplies layer i by: on only if there is an epoch."""
    if epoch is None or not model.dropout:
        return 1.0
    return (uniform(ids, width, epoch, i) >= model.dropout) / (1 - model.dropout)


def _finish(model: GraphModel, i: int, z: np.ndarray, ids: np.ndarray, epoch: int | None) -> np.ndarray:
    """A hidden layer's activation, norm and dropout."""
    x = ACTIVATIONS[model.activation](z)
    if model.layer_norm:
        gain, bias = model.norms.get(i, (1.0, 0.0))
        x = layer_norm(x) * gain + bias
    return x * _gate(model, ids, x.shape[1], epoch, i)


def _finish_back(model: GraphModel, i: int, z: np.ndarray, g: np.ndarray, ids: np.ndarray, epoch: int | None, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of z from that of the finished layer; and for each row, what it adds to those of gain and bias."""
    g = g * _gate(model, ids, g.shape[1], epoch, i)
    own = np.zeros((len(g), 0))
    if model.layer_norm:
        x = ACTIVATIONS[model.activation](z)
        x = x - x.mean(1, keepdims=True)
        spread = np.sqrt((x * x).mean(1, keepdims=True) + eps)
        x = x / spread
        own = np.concatenate([g * x, g], 1)
        g = g * model.norms.get(i, (1.0, 0.0))[0]
        g = (g - g.mean(1, keepdims=True) - x * (g * x).mean(1, keepdims=True)) / spread
    return g * SLOPES[model.activation](z), own


def _graphs(model: GraphModel, edges: DataFrame | list[DataFrame]) -> list[DataFrame]:
    graphs = edges if isinstance(edges, list) else [edges] * len(model.layers)
    if len(graphs) != len(model.layers):
        raise ValueError(f"{len(graphs)} graphs for {len(model.layers)} layers")
    return graphs


def forward(model: GraphModel, edges: DataFrame | list[DataFrame], nodes: DataFrame, *, epoch: int | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """(node_id, features): logits.  One edge table for all layers, or one for each.

    Targets that a layer doesn't reach keep their self part; a residual whose
    row is missing counts as zero.  Dropout is on only if an epoch is given,
    and is seeded by it, the layer and the node's id.  Each hidden layer is
    read up to three times by the next, so it is written once to the shared
    folder: the work grows with the number of layers, not as its power.  These
    tables are added to made, to be removed when the logits have been read.
    """
    h = nodes.select("node_id", "features")
    for i, graph in enumerate(_graphs(model, edges)):
        h = _convolve(model, i, graph, h)
        if i < len(model.layers) - 1:
            h = materialize(_rows(h, lambda z, ids, i=i: _finish(model, i, z, ids, epoch)), "layer")
            if made is not None:
                made.append(h)
    return h


def infer(model: GraphModel, edges: DataFrame | list[DataFrame], nodes: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Logits as evaluation takes them: without dropout and without residuals."""
    return forward(replace(model, residual=False), edges, nodes, made=made)


def accuracy_of(model: GraphModel, edges: DataFrame | list[DataFrame], nodes: DataFrame, labels: DataFrame) -> float:
    """The accuracy of infer's logits over labels; what it has written is removed."""
    made: list[DataFrame] = []
    found = evaluate(infer(model, edges, nodes, made), labels)
    remove(*made)
    return found


def hits(logits: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """Correct predictions and their number over labels (node_id, label), by argmax; for an array column labels, over its elements, by sign."""
    both = logits.select("node_id", F.col("features").alias("logits"))
    if "labels" in labels.columns:
        row = metrics.bce_with_logits(both.join(labels.select("node_id", "labels"), "node_id")).first()
    else:
        row = metrics.cross_entropy(both.join(labels.select("node_id", "label"), "node_id")).first()
    return row["correct"] or 0, row["total"] or 0


def evaluate(logits: DataFrame, labels: DataFrame) -> float:
    """Accuracy over labels, see hits."""
    right, total = hits(logits, labels)
    return right / max(total, 1)


def _small_product(left: DataFrame, right: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """leftᵀ right over node_id, as a sum of the tasks' own products."""
    both = left.select("node_id", F.col("features").alias("a")).join(right.select("node_id", F.col("features").alias("b")), "node_id").select("a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                total += np.stack(pdf["a"].to_numpy()).T @ np.stack(pdf["b"].to_numpy())
        yield pd.DataFrame({"i": range(total.size), "v": total.ravel()})

    rows = both.mapInPandas(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in rows:
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def _softmax_loss(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy of each row, its gradient, and whether the largest logit is right."""
    p = np.exp(x - x.max(1, keepdims=True))
    total = p.sum(1)
    at = np.arange(len(y))
    ce, ok = np.log(total) - (x[at, y] - x.max(1)), x.argmax(1) == y
    p /= total[:, None]
    p[at, y] -= 1
    return ce, p, ok.astype(int)


def _sign_loss(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for independent labels: sums over a row's elements of binary cross-entropy and hits."""
    bce = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
    return bce.sum(1), 1 / (1 + np.exp(-np.clip(x, -500, 500))) - y, ((x > 0) == (y > 0.5)).sum(1)


def loss_and_gradients(model: GraphModel, edges: DataFrame | list[DataFrame], nodes: DataFrame, train: DataFrame, *, epoch: int | None = None) -> tuple[float, int, int, Weights]:
    """Mean loss over train, hits, count, and gradients in the form of model.weights().

    train (node_id, label): softmax cross-entropy, counted in nodes.  With an
    array column labels: binary cross-entropy, counted in elements.  Dropout
    is on if an epoch is given.  The tables that are written on the way are
    removed.

    Backward of Y = A (X Wn) + X Ws + X P: dWn = Xᵀ(Aᵀ G), dWs = Xᵀ G, dP = Xᵀ G,
    dX = (Aᵀ G) Wnᵀ + G Wsᵀ + G Pᵀ.
    """
    graphs, last, made = _graphs(model, edges), len(model.layers) - 1, []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    h = nodes.select("node_id", F.transform("features", lambda v: v.cast("double")).alias("features"))
    xs, zs = [h], []
    for i, graph in enumerate(graphs):
        out = _convolve(model, i, graph, xs[-1])
        if i == last:
            break
        with phase(out.sparkSession, "layer"):
            z = written(out, "layer")
        zs.append(z)
        xs.append(written(_rows(z, lambda v, ids, i=i: _finish(model, i, v, ids, epoch)), "layer"))
    multi = "labels" in train.columns
    label, each = ("labels", _sign_loss) if multi else ("label", _softmax_loss)
    own = out.join(train.select("node_id", label), "node_id")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf[label].to_numpy()).astype(float) if multi else pdf[label].to_numpy()
                loss, g, ok = each(np.stack(pdf["features"].to_numpy()), y)
                yield pd.DataFrame({"node_id": pdf["node_id"], "features": list(g), "loss": loss, "ok": ok, "n": g.shape[1] if multi else 1})

    raw = written(own.mapInPandas(start, "node_id bigint, features array<double>, loss double, ok bigint, n bigint"), "grad")
    loss, ok, n = raw.agg(F.sum("loss"), F.sum("ok"), F.sum("n")).first()
    if not n:
        remove(*made)
        return 0.0, 0, 0, [tuple(np.zeros_like(w) for w in layer) for layer in model.weights()]
    g = raw.select("node_id", F.transform("features", lambda v: v / n).alias("features"))
    grads: Weights = []
    norm_grads: tuple[np.ndarray, ...] = ()
    for i in range(last, -1, -1):
        wn, ws = model.layers[i]
        projection = model.projections.get(i) if model.residual and i < last else None
        with phase(g.sparkSession, "spmm"):
            atg = written(linalg.spmm_arrays(linalg.transpose(graphs[i]), g, wn.shape[1]), "atg")
        by_self = _small_product(xs[i], g, ws.shape)
        grads.append((_small_product(xs[i], atg, wn.shape), by_self, *((by_self,) if projection is not None else ()), *norm_grads))
        if i:
            back = linalg.project(atg, wn.T).unionByName(linalg.project(g, (ws if projection is None else ws + projection).T))
            if model.residual and i < last and projection is None:
                back = back.unionByName(g.select("node_id", "features"))
            both = linalg.sum_arrays(back, "node_id", wn.shape[0]).join(zs[i - 1].select("node_id", F.col("features").alias("z")), "node_id")

            def through(batches: Iterator[pd.DataFrame], i: int = i - 1) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        gz, own = _finish_back(model, i, np.stack(pdf["z"].to_numpy()), np.stack(pdf["features"].to_numpy()), pdf["node_id"].to_numpy(), epoch)
                        yield pd.DataFrame({"node_id": pdf["node_id"], "features": list(gz), "own": list(own)})

            g = written(both.mapInPandas(through, "node_id bigint, features array<double>, own array<double>"), "grad")
            norm_grads = ()
            if model.layer_norm and i - 1 in model.norms:
                width = wn.shape[0]
                total = linalg.sum_arrays(g.select(F.lit(0).alias("k"), "own"), "k", 2 * width, "own").first()
                sums = np.array(total["own"]) if total else np.zeros(2 * width)
                norm_grads = (sums[:width], sums[width:])
    remove(*made)
    return float(loss) / n, int(ok), int(n), grads[::-1]


def _product(graph: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """A h of edges (src, dst, weight) by place."""
    src, dst, weight = graph
    out = np.zeros(h.shape)
    if len(src):
        order = np.argsort(src, kind="stable")
        first = np.flatnonzero(np.diff(src[order], prepend=-1))
        out[src[order][first]] = np.add.reduceat(weight[order, None] * h[dst[order]], first)
    return out


@dataclass
class TaskBatch:
    """A batch that one task holds: nodes in the order of their ids, edges (src, dst, weight) of each layer by place, places and labels of its targets."""

    ids: np.ndarray
    features: np.ndarray
    graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    targets: np.ndarray
    labels: np.ndarray


def _task_forward(model: GraphModel, batch: TaskBatch, epoch: int | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each layer, what goes in, its sum over neighbours and what comes out before the activation; see forward."""
    xs, sums, zs = [batch.features.astype(float)], [], []
    for i, (wn, ws) in enumerate(model.layers):
        x = xs[-1]
        sums.append(_product(batch.graphs[i], x))
        z = sums[-1] @ wn + x @ ws
        if i < len(model.layers) - 1:
            if model.residual:
                z = z + (x @ model.projections[i] if i in model.projections else x)
            xs.append(_finish(model, i, z, batch.ids, epoch))
        zs.append(z)
    return xs, sums, zs


def task_hits(model: GraphModel, batch: TaskBatch) -> tuple[int, int]:
    """hits of one batch over its targets."""
    logits = _task_forward(model, batch, None)[2][-1][batch.targets]
    right = (logits > 0) == (batch.labels > 0.5) if batch.labels.ndim == 2 else logits.argmax(1) == batch.labels
    return int(right.sum()), right.size


def task_gradients(model: GraphModel, batch: TaskBatch, *, epoch: int | None = None) -> tuple[float, int, int, Weights]:
    """loss_and_gradients of one batch, within a task."""
    last, (xs, sums, zs) = len(model.layers) - 1, _task_forward(model, batch, epoch)
    multi, n = batch.labels.ndim == 2, batch.labels.size
    if not n:
        return 0.0, 0, 0, [tuple(np.zeros_like(w) for w in layer) for layer in model.weights()]
    loss, own, ok = (_sign_loss if multi else _softmax_loss)(zs[-1][batch.targets], batch.labels)
    g = np.zeros(zs[-1].shape)
    g[batch.targets] = own / n
    grads: Weights = []
    norm_grads: tuple[np.ndarray, ...] = ()
    for i in range(last, -1, -1):
        wn, ws = model.layers[i]
        projection = model.projections.get(i) if model.residual and i < last else None
        by_self = xs[i].T @ g
        grads.append((sums[i].T @ g, by_self, *((by_self,) if projection is not None else ()), *norm_grads))
        if i:
            src, dst, weight = batch.graphs[i]
            back = _product((dst, src, weight), g) @ wn.T + g @ (ws if projection is None else ws + projection).T
            if model.residual and i < last and projection is None:
                back = back + g
            g, own = _finish_back(model, i - 1, zs[i - 1], back, batch.ids, epoch)
            width = wn.shape[0]
            norm_grads = (own.sum(0)[:width], own.sum(0)[width:]) if model.layer_norm and i - 1 in model.norms else ()
    return float(loss.sum()) / n, int(ok.sum()), n, grads[::-1]


class Adam:
    """Adam with weight decay, and clipping of the gradients' common length to 1."""

    def __init__(self, rate: float = 1e-3, decay: float = 0.0, clip: float = 1.0):
        self.rate, self.decay, self.clip, self.t, self.m, self.v = rate, decay, clip, 0, None, None

    def step(self, model: GraphModel, grads: Weights) -> None:
        flat = [g for layer in grads for g in layer]
        length = np.sqrt(sum(float((g * g).sum()) for g in flat))
        flat = [g * min(1.0, self.clip / (length + 1e-6)) for g in flat]
        layers = model.weights()
        weights = [w for layer in layers for w in layer]
        flat = [g + self.decay * w for g, w in zip(flat, weights, strict=True)]
        self.m, self.v, self.t = self.m or [0 * g for g in flat], self.v or [0 * g for g in flat], self.t + 1
        self.m = [0.9 * m + 0.1 * g for m, g in zip(self.m, flat, strict=True)]
        self.v = [0.999 * v + 0.001 * g * g for v, g in zip(self.v, flat, strict=True)]
        new = iter([w - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) for w, m, v in zip(weights, self.m, self.v, strict=True)])
        model.set_weights([tuple(next(new) for _ in layer) for layer in layers])


@dataclass
class Plateau:
    """Halves the rate when accuracy hasn't risen for more than ``patience`` evaluations."""

    factor: float = 0.5
    patience: int = 10
    best: float = -1.0
    bad: int = 0

    def step(self, accuracy: float, adam: Adam) -> None:
        self.best, self.bad = (accuracy, 0) if accuracy > self.best else (self.best, self.bad + 1)
        if self.bad > self.patience:
            adam.rate, self.bad = adam.rate * self.factor, 0


def save_weights(model: GraphModel, spark, path: str, **meta) -> None:
    """Weights as a table (layer, kind, row, col, value) and the options beside them."""
    rows = [(i, k, r, c, float(v)) for i, pair in enumerate(model.layers) for k, w in zip("ns", pair, strict=True) for (r, c), v in np.ndenumerate(w)]
    rows += [(i, "p", r, c, float(v)) for i, w in model.projections.items() for (r, c), v in np.ndenumerate(w)]
    rows += [(i, "g", r, c, float(v)) for i, w in model.norms.items() for (r, c), v in np.ndenumerate(np.stack(w))]
    spark.createDataFrame(rows, "layer int, kind string, row int, col int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    options = {k: getattr(model, k) for k in ("activation", "layer_norm", "residual", "dropout")}
    spark.createDataFrame([(json.dumps(options | meta),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_weights(spark, path: str) -> tuple[GraphModel, dict]:
    rows = spark.read.parquet(f"{path}/weights").collect()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    found: dict[tuple[int, str], np.ndarray] = {}
    for key in {(r["layer"], r["kind"]) for r in rows}:
        own = [r for r in rows if (r["layer"], r["kind"]) == key]
        found[key] = np.zeros((max(r["row"] for r in own) + 1, max(r["col"] for r in own) + 1))
        for r in own:
            found[key][r["row"], r["col"]] = r["value"]
    options = {k: meta.pop(k) for k in ("activation", "layer_norm", "residual", "dropout")}
    n = 1 + max(i for i, k in found if k == "n")
    return GraphModel([(found[i, "n"], found[i, "s"]) for i in range(n)], projections={i: w for (i, k), w in found.items() if k == "p"}, norms={i: (w[0], w[1]) for (i, k), w in found.items() if k == "g"}, **options), meta


def targets(bundle: GraphBundle) -> DataFrame:
    """The nodes with the one column of labels that their kind asks for: label, or labels if there are several for a node."""
    nodes = bundle.nodes
    if bundle.multi_label:
        return nodes
    if "label" not in nodes.columns and "labels" in nodes.columns:
        nodes = nodes.withColumn("label", F.col("labels")[0].cast("bigint"))
    return nodes.drop("labels")


def _pack(arrays: list[np.ndarray]) -> list[dict]:
    """Arrays as JSON holds them, to the bit."""
    return [{"shape": a.shape, "bytes": base64.b64encode(np.ascontiguousarray(a, "<f8").tobytes()).decode()} for a in arrays]


def _unpack(packed: list[dict], like: GraphModel) -> Weights:
    """In the form of like's weights."""
    flat = iter([np.frombuffer(base64.b64decode(p["bytes"]), "<f8").reshape(p["shape"]).copy() for p in packed])
    return [tuple(next(flat) for _ in layer) for layer in like.weights()]


#: Steps of several batches in a row: changes the model and Adam's state, and returns (loss, hits, count) of each.
Run = Callable[[GraphModel, Adam, int], list[tuple[float, int, int]]]
Batches = Callable[[int], Iterator[tuple[DataFrame | list[DataFrame], DataFrame, DataFrame] | Run]]


def train(bundle: GraphBundle, model: GraphModel, batches: Batches, *, epochs: int, eval_interval: int = 1, patience: int = 20, adam: Adam | None = None, weighted: bool = True, accuracy: Callable[[GraphModel], float] | None = None, plateau: bool = True, state: StateLog | None = None) -> list[dict]:
    """Epochs over batches (edges, nodes, train nodes), or runs of batches, see operators/epochs.py.

    The loss of an epoch is the mean over its batches, weighted by what they
    trained on, or plain if not weighted; batches without a train node are
    skipped.  accuracy: the validation's, by default of the whole graph.
    Keeps the best weights by it and stops ``patience`` epochs after the best.
    state: every epoch is committed there, and epochs that it has are not
    trained again.
    """
    spark, adam, rates, best, log = bundle.edges.sparkSession, adam or Adam(), Plateau(), (-1.0, 0, model.weights()), []
    if state and state.values:
        kept = state.values
        model.set_weights(_unpack(kept["weights"], model))
        best, log = (*kept["best"], _unpack(kept["best_weights"], model)), kept["log"]
        adam.rate, adam.t, rates = kept["rate"], kept["t"], Plateau(**kept["plateau"])
        if adam.t:
            adam.m, adam.v = ([w for layer in _unpack(kept[k], model) for w in layer] for k in "mv")
    accuracy = accuracy or (lambda m: accuracy_of(m, bundle.edges, bundle.nodes, targets(bundle).where("split = 'val'")))
    for epoch in range(len(log) + 1, epochs + 1):
        if log and log[-1]["epoch"] - best[1] > patience:
            break
        loss = right = total = share = 0
        for batch in batches(epoch):
            if callable(batch):
                with phase(spark, "gradients"):
                    steps = batch(model, adam, epoch)
            else:
                with phase(spark, "gradients"):
                    *step, grads = loss_and_gradients(model, *batch, epoch=epoch)
                if step[2]:
                    with phase(spark, "step"):
                        adam.step(model, grads)
                steps = [step]
            for part, ok, n in steps:
                if n:
                    weight = n if weighted else 1
                    loss, share, right, total = loss + part * weight, share + weight, right + ok, total + n
        row = {"epoch": epoch, "loss": loss / max(share, 1), "train_acc": right / max(total, 1), "val_acc": None}
        if epoch % eval_interval == 0:
            with phase(spark, "evaluate"):
                row["val_acc"] = accuracy(model)
            if plateau:
                rates.step(row["val_acc"], adam)
            if row["val_acc"] > best[0]:
                best = (row["val_acc"], epoch, model.weights())
        log.append(row)
        if state:
            moments = {k: _pack(v or []) for k, v in (("m", adam.m), ("v", adam.v))}
            state.commit(weights=_pack([w for layer in model.weights() for w in layer]), best=best[:2], best_weights=_pack([w for layer in best[2] for w in layer]), log=log, rate=adam.rate, t=adam.t, plateau=asdict(rates), **moments)
    model.set_weights(best[2])
    return log
