"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages, windows of `PASSAGE` bytes one after the other over the whole text.  Each passage is encoded by a
hidden layer over its byte trigrams (hashed, square roots of shares) and the shares of kinds of bytes.  Gated attention
weighs the passages: the product of a tanh and a sigmoid layer over the encoding gives a number for each, and a softmax over
the text's passages makes weights of them.  The weighted sum of the encodings is scored by a logistic output.  Encoder,
attention and output learn together from the labels of documents; passages have none.

The classifier is fitted on a bounded sample: the first `TRAIN_ROWS` labelled rows by a hash of the id, and of each at most
`TRAIN_PASSAGES` passages at even distances.  The fit is distributed: the sample is dealt into `WORKERS` parts, each takes a few
passes from the common weights, and the driver averages what they have learnt, a few thousand numbers, round by round.
Scoring reads every passage of every text; the softmax is carried on from stretch to stretch, so a text of any length takes
the same memory.

Defined results: a null text counts as empty; an empty text is one passage without bytes; labels that are null or neither 0
nor 1 are not learnt from, nor are rows without an id; if a class has no rows, every score is the smoothed share of label 1;
repeated rows score alike; other columns pass through, and the added column replaces one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.bpe import _mapped, _slices
from ledgerlens.llm.shared import for_python, lean
from ledgerlens.scratch import scope, written

PASSAGE, TRIGRAMS = 512, 256
#: Bounds of the training sample: labelled rows, and passages of each.
TRAIN_ROWS, TRAIN_PASSAGES = 4_000, 64
#: Sizes of the encoding and of the attention's layers.
HIDDEN, GATES = 24, 12
WORKERS, ROUNDS, RATE, DECAY = 8, 8, 0.01, 1e-4
#: Of each round: texts of a step, and passes over a part's texts, more where they would make fewer steps than `STEPS`.
BATCH, PASSES, STEPS = 32, 3, 15
#: Passages that are encoded at once.
STRETCH = 2048
#: Kinds of bytes: lower and upper case, digits, white space, line ends, marks of sentences, other marks, beyond ASCII.
_KIND = np.array([4 if c in b"\r\n" else 3 if c < 33 else 5 if c in b".,;:?'\"-()" else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 7 if c > 127 else 6 for c in range(256)], np.int64)
_KINDS = 8
FEATURES = TRIGRAMS + _KINDS + 4


def passages_of(size: np.ndarray) -> np.ndarray:
    """How many passages texts of so many bytes have."""
    return np.maximum(1, -(-size // PASSAGE))


def features(body: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Features of passages that stand one after the other in `body` and have these sizes in bytes."""
    count = len(size)
    owner = np.repeat(np.arange(count), size)
    whole = np.maximum(size, 1)[:, None]
    out = np.zeros((count, FEATURES), np.float32)
    if len(body) > 2:
        wide = body.astype(np.uint32)
        code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
        inside = owner[:-2] == owner[2:]
        found = np.bincount((owner[:-2] * TRIGRAMS + code)[inside], minlength=count * TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(found.reshape(count, TRIGRAMS) / whole) * 2
    kind = _KIND[body]
    out[:, TRIGRAMS : TRIGRAMS + _KINDS] = np.bincount(owner * _KINDS + kind, minlength=count * _KINDS).reshape(count, _KINDS) / whole
    space = (kind == 3) | (kind == 4)
    first = np.ones(len(body), bool)  # of its passage: what a passage has depends on its own bytes alone
    first[1:] = owner[1:] != owner[:-1]
    alike = ~space & ~first & (body == np.roll(body, 1))
    starts = ~space & (first | np.roll(space, 1))
    share = lambda mask: np.bincount(owner[mask], minlength=count) / whole[:, 0]
    out[:, -4:] = np.stack([share(alike) * 4, share(starts) * 4, size / PASSAGE, size == 0], axis=1)
    return out


@dataclass(frozen=True)
class Weights:
    """Encoder (a, a0), attention's layers (v, u) and its vector w, output (c, c0)."""

    a: np.ndarray
    a0: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.a, self.a0, self.v, self.u, self.w, self.c, self.c0]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Weights:
        shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*[x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shapes)])

    @classmethod
    def start(cls, bias: float) -> Weights:
        draw = np.random.default_rng(11)
        some = lambda *shape: draw.normal(0, shape[0] ** -0.5, shape)
        return cls(some(FEATURES, HIDDEN), np.zeros(HIDDEN), some(HIDDEN, GATES), some(HIDDEN, GATES), some(GATES), np.zeros(HIDDEN), np.array([bias]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def encoded(weights: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encodings of passages, both layers of the attention, and its numbers."""
    h = np.tanh(x @ weights.a + weights.a0)
    t, g = np.tanh(h @ weights.v), _sigmoid(h @ weights.u)
    return h, t, g, (t * g) @ weights.w


def gradient(weights: Weights, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of the mean log loss of texts whose passages begin at `starts`, flat as the weights."""
    h, t, g, e = encoded(weights, x)
    text = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x)))
    e = np.exp(e - np.maximum.reduceat(e, starts)[text])
    share = e / np.add.reduceat(e, starts)[text]
    z = np.add.reduceat(share[:, None] * h, starts)
    wrong = (_sigmoid(z @ weights.c + weights.c0) - label) / len(label)
    by_z = wrong[:, None] * weights.c
    by_share = (h * by_z[text]).sum(axis=1)
    by_e = share * (by_share - np.add.reduceat(share * by_share, starts)[text])
    by_t, by_g = by_e[:, None] * weights.w * g * (1 - t * t), by_e[:, None] * weights.w * t * g * (1 - g)
    by_h = share[:, None] * by_z[text] + by_t @ weights.v.T + by_g @ weights.u.T
    by_a = by_h * (1 - h * h)
    return np.concatenate([(x.T @ by_a).ravel(), by_a.sum(axis=0), (h.T @ by_t).ravel(), (h.T @ by_g).ravel(), (t * g).T @ by_e, z.T @ wrong, [wrong.sum()]])


def learnt(flat: np.ndarray, x: np.ndarray, starts: np.ndarray, label: np.ndarray, turn: int) -> np.ndarray:
    """The weights after some passes of Adam over these texts, in an order drawn for the turn."""
    flat, order = flat.copy(), np.random.default_rng(turn)
    ends = np.append(starts[1:], len(x))
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(max(PASSES, -(-STEPS // max(1, -(-len(starts) // BATCH))))):
        chosen = order.permutation(len(starts))
        for k in range(0, len(chosen), BATCH):
            some = chosen[k : k + BATCH]
            size = (ends - starts)[some]
            at = np.cumsum(size) - size
            place = np.repeat(starts[some] - at, size) + np.arange(size.sum())
            slope = gradient(Weights.of(flat), x[place], at, label[some]) + DECAY * flat
            step += 1
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            flat -= RATE / (1 + turn) ** 0.5 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return flat


def _sampled(batches):
    """Features of at most `TRAIN_PASSAGES` passages of each text, packed."""
    for batch in batches:
        for at in range(batch.num_rows):
            body = np.frombuffer((batch.column(0)[at].as_py() or "").encode(), np.uint8)
            whole = int(passages_of(np.array([len(body)]))[0])
            chosen = np.unique(np.linspace(0, whole - 1, min(whole, TRAIN_PASSAGES)).round().astype(np.int64))
            parts = [body[k * PASSAGE : (k + 1) * PASSAGE] for k in chosen]
            x = features(np.concatenate(parts), np.array([len(p) for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, 1), batch.column(2).slice(at, 1), pa.array([len(x)]), pa.array([x.tobytes()], pa.binary())], names=["part", "label", "passages", "features"])


def _round(flat: np.ndarray, turn: int):
    """What one part of the sample learns from the common weights."""

    def run(key: tuple, held: pa.Table) -> pa.Table:
        held = held.sort_by([("passages", "ascending"), ("label", "ascending"), ("features", "ascending")])  # the same in each attempt
        size = held["passages"].to_numpy()
        x = np.frombuffer(b"".join(held["features"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
        new = learnt(flat, x, np.cumsum(size) - size, held["label"].to_numpy(), turn)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "texts": [held.num_rows], "weights": [new.tobytes()]})

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = TRAIN_ROWS) -> Weights:
    """Fits the classifier on at most `bound` rows of `labels` and their texts."""
    spark = docs.sparkSession
    for_python(spark)
    with scope(spark):
        known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
        chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(WORKERS)).cast("int")
        sample = texts.join(F.broadcast(chosen), "doc_id").select("text", part.alias("part"), F.col("label").cast("double").alias("label"))
        rows = written(sample.mapInArrow(lean(_sampled), "part int, label double, passages long, features binary"))
        totals = dict(rows.groupBy("label").count().collect())
        positive, negative = totals.get(1.0, 0), totals.get(0.0, 0)
        flat = Weights.start(float(np.log((positive + 1) / (negative + 1)))).flat()
        for turn in range(ROUNDS if positive and negative else 0):
            found = rows.groupBy("part").applyInArrow(_round(flat, turn), "part int, texts long, weights binary").orderBy("part").collect()  # one row for each part
            flat = sum(r.texts * np.frombuffer(r.weights) for r in found) / sum(r.texts for r in found)
        return Weights.of(flat)


def scores(texts: pa.Array, weights: Weights) -> np.ndarray:
    """Score of each text of a column."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    count = passages_of(size)
    first = np.cumsum(count) - count
    top, total, z = np.full(len(size), -np.inf), np.zeros(len(size)), np.zeros((len(size), HIDDEN))
    for a in range(0, int(count.sum()), STRETCH):
        b = min(a + STRETCH, int(count.sum()))
        number = np.arange(a, b)
        row = np.searchsorted(first, number, "right") - 1
        start = (number - first[row]) * PASSAGE
        length = np.minimum(PASSAGE, size[row] - start)
        begin = offsets[row[0]] + start[0]
        h, _, _, e = encoded(weights, features(body[begin : begin + length.sum()], length))
        # the softmax goes on from what earlier stretches gave
        here, starts = np.unique(row, return_index=True)
        high = np.maximum(top[here], np.maximum.reduceat(e, starts))
        keep = np.exp(top[here] - high)
        e = np.exp(e - np.repeat(high, np.diff(starts, append=len(row))))
        total[here] = total[here] * keep + np.add.reduceat(e, starts)
        z[here] = z[here] * keep[:, None] + np.add.reduceat(e[:, None] * h, starts)
        top[here] = high
    return _sigmoid((z / np.maximum(total, 1e-300)[:, None]) @ weights.c + weights.c0)


def score(docs: DataFrame, weights: Weights, text: str = "text", name: str = "score") -> DataFrame:
    """Adds `name`: the probability of label 1 by the model."""
    for_python(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.flat())

    def make():
        own = Weights.of(held.value.astype(np.float32))
        return lambda column: [pa.array(np.concatenate([np.zeros(0), *(scores(part, own) for part in _slices(column, STRETCH * PASSAGE))]))]

    return _mapped(docs, text, [(name, T.DoubleType())], make)
