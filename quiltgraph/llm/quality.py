"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded; gated attention
weights, learned from document labels alone, weigh the passages, and the
weighted representation is scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import filter_batches, map_batches, utf8

#: Words of a passage.
PASSAGE_WORDS = 64
#: The bounded sample that the model is fitted on: labelled documents, with all their passages.
TRAIN_DOCS = 3000
#: Rows whose crc32 of the id as text leaves 0 by this are held out.
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 16, 8, 150, 0.02, 1e-4
#: Byte classes whose shares describe a passage.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!", "?", "|", "#", "$%&*@^~", "<>{}[]\\/=+_", "\"'`", ":;()-", "\t")
_CLASS_OF = np.full(256, len(_CLASSES) + 1, np.int64)  # control bytes
_CLASS_OF[128:] = len(_CLASSES)
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c.encode())] = _i
N_CLASSES = len(_CLASSES) + 2
N_PAIRS = 48
N_FEATURES = N_CLASSES + N_PAIRS + 6


def passages(text: bytes) -> list[list[bytes]]:
    """Runs of PASSAGE_WORDS words of the whole text; an empty text is one empty passage."""
    words = text.split()
    return [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]


def encode(bags: list[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of passages of each bag."""
    sizes = np.array([len(b) for b in bags])
    flat = [p for b in bags for p in b]
    joined = [b" ".join(p) for p in flat]
    lengths = np.array([len(j) for j in joined])
    data = np.frombuffer(b"".join(joined), np.uint8)
    owner = np.repeat(np.arange(len(flat)), lengths)
    kind = _CLASS_OF[data]
    shares = np.bincount(owner * N_CLASSES + kind, minlength=len(flat) * N_CLASSES).reshape(len(flat), N_CLASSES)
    pair = (kind[:-1] * N_CLASSES + kind[1:]) % N_PAIRS  # pairs of classes, hashed
    inside = owner[:-1] == owner[1:]
    pairs = np.bincount(owner[:-1][inside] * N_PAIRS + pair[inside], minlength=len(flat) * N_PAIRS).reshape(len(flat), N_PAIRS)
    n = np.maximum(lengths, 1)[:, None]
    more = np.array([(len(p), len(set(p)), sum(map(bytes.__eq__, p, p[1:])), max(map(len, p), default=0), len({x[:1] for x in p}), sum(x.isupper() for x in p)) for p in flat], float).reshape(len(flat), 6)
    count = np.maximum(more[:, :1], 1)
    more = np.hstack([np.log1p(more[:, :1]), more[:, 1:3] / count, np.log1p(more[:, 3:4]), more[:, 4:] / count])
    return np.hstack([np.sqrt(shares / n), np.sqrt(pairs / n), more]), sizes


@dataclass
class Model:
    """Standardisation, and the weights of encoder, gated attention and score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        w, starts = self.weights, np.append(0, np.cumsum(sizes)[:-1])
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ w["encode"] + w["encode_b"])
        t, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        s = (t * g) @ w["weigh"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        bag = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-(bag @ w["score"] + w["score_b"])))
        return y, {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "starts": starts}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, sizes = encode([passages(t) for t in texts])
        return self.forward(x, sizes)[0]


def gradients(model: Model, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, by weight."""
    w = model.weights
    p, c = model.forward(x, sizes)
    d = (p - y) / len(y)
    grad = {"score": c["bag"].T @ d, "score_b": d.sum()}
    d_bag = np.repeat(d[:, None] * w["score"], sizes, axis=0)
    d_a = (d_bag * c["h"]).sum(1)
    d_s = c["a"] * (d_a - np.repeat(np.add.reduceat(c["a"] * d_a, c["starts"]), sizes))
    grad["weigh"] = (c["t"] * c["g"]).T @ d_s
    d_tg = d_s[:, None] * w["weigh"]
    d_t, d_g = d_tg * c["g"] * (1 - c["t"] ** 2), d_tg * c["t"] * c["g"] * (1 - c["g"])
    grad["attend"], grad["gate"] = c["h"].T @ d_t, c["h"].T @ d_g
    d_h = c["a"][:, None] * d_bag + d_t @ w["attend"].T + d_g @ w["gate"].T
    d_h *= 1 - c["h"] ** 2
    grad["encode"], grad["encode_b"] = c["z"].T @ d_h, d_h.sum(0)
    return grad


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss of bags of passage features."""
    x, sizes = np.vstack(bags), np.array([len(b) for b in bags])
    y = labels.astype(float)
    rng = np.random.default_rng(seed)
    wide = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    model = Model(x.mean(0), x.std(0) + 1e-3, {"encode": wide(x.shape[1], HIDDEN), "encode_b": np.zeros(HIDDEN), "attend": wide(HIDDEN, ATTENTION), "gate": wide(HIDDEN, ATTENTION), "weigh": wide(ATTENTION, 1)[:, 0], "score": wide(HIDDEN, 1)[:, 0], "score_b": np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))})
    w = model.weights
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        grad = gradients(model, x, sizes, y)
        for k in w:
            g = grad[k] + DECAY * w[k] * (not k.endswith("_b"))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on a sample, of TRAIN_DOCS at most, of the labelled documents that aren't held out.

    The sample is those with the least hashes of their ids.  Ids or labels
    that are null are left out; of an id with several labels the least counts,
    of one with several texts the one whose features are least as bytes.
    Without labels of both kinds there is no model (None).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in utf8(batch.column(1)):
                out.append(passages(text))
            if out:
                x, sizes = encode(out)
                parts = np.split(x.astype("<f4"), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "label", "bag"])

    # At most TRAIN_DOCS ids: a proven bound, so this side is broadcast and the texts aren't shuffled.
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = own.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "text", "label")
    found = sample.mapInArrow(bags, f"id {docs.schema[id_col].dataType.simpleString()}, label int, bag binary")
    rows = found.groupBy("id", "label").agg(F.min("bag").alias("bag")).collect()
    rows.sort(key=lambda r: r["id"])
    if len({r["label"] for r in rows}) < 2:
        return None
    return fit([np.frombuffer(r["bag"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows], np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only texts go into a score.  A null or empty text is one empty passage,
    with the score that the model gives it; repeated rows get equal scores.
    If no model can be fitted, all scores are 1.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_scores(model.value, utf8(batch.column(2))), pa.float64())], names=["doc_id", "held_out", "score"])

    scored = map_batches(docs, [F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)], f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double", rows)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scores(model: Model | None, texts: list[bytes]) -> list[float]:
    if model is None:
        return [1.0] * len(texts)
    out: list[float] = []
    at = 0
    while at < len(texts):  # a few hundred kilobytes at a time, or one document
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= 1 << 19):
            held += len(texts[end])
            end += 1
        out += model.score(texts[at:end]).tolist()
        at = end
    return out


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, whose score is at least the threshold.

    Null and empty texts have the score of an empty text; whole texts are
    scored, however long.  Repeated rows, which have equal scores, stay or go
    together; null ids are scored like others.  An empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    return filter_batches(docs, text_col, lambda texts: [s >= threshold for s in _scores(model.value, texts)])
