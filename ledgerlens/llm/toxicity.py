"""Toxicity of whole texts: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are its words' character n-grams of 3 to 6 characters, the word's borders included, hashed
into buckets; a bucket's value is the number of distinct words of the text that have it.  From labelled texts each
bucket gets the log ratio of the share of toxic texts that have it to that of the others; buckets whose
ratio is not clear of its sampling error count as 0.  A logistic regression with weight decay, in which both classes
weigh the same, is then fitted on the logarithms of the values times these ratios; all clear buckets take part.  The
fit is distributed: the driver holds a number for each bucket and no rows.  As the score is a sum over words, a text
of any length is scored in one pass.

The classifier is fitted on a bounded sample of labelled rows (`TRAIN_ROWS`, those first by a hash of the id).
Scores depend on the text alone.

Defined results: a null text counts as empty and scores as a text without words; labels that are null or
neither 0 nor 1 are not learnt from, nor are rows without an id; if a class has no rows, every score is the
smoothed share of toxic labels; repeated rows score alike; other columns pass through, and the added columns
replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.bpe import _mapped, _slices
from ledgerlens.llm.shared import for_python, lean
from ledgerlens.scratch import scope, written

#: Bound of the training sample, in labelled rows.
TRAIN_ROWS = 10_000
BUCKET_BITS = 18
NGRAMS = (3, 6)
#: A bucket's log ratio must be this many standard errors from 0.  At two the sign of a ratio is known; held-out AUC on 4,000
#: labelled texts was 0.988 at four (294 buckets), 0.992 at two (15,125) and 0.68 with all 200,964: there Spark's fit, which
#: scales its penalty by the spread of each feature, does not come near its optimum in `STEPS` steps.
CLEAR = 2.0
#: Steps of the fit at most, and its weight decay.
STEPS, DECAY = 60, 1e-3
#: Bytes of text whose n-grams are held at once, about.
STRETCH_BYTES = 1 << 18


@dataclass(frozen=True)
class Model:
    """Weight of each bucket (coefficient times log ratio) and the intercept."""

    weight: np.ndarray
    bias: float


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of the word, bucket) for all n-grams of the words."""
    text = "\n" + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py() + "\n"
    text = np.frombuffer(text.replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    border = text == 10
    word = np.cumsum(border) - 1  # of the word that a border ends or a character stands in; a border begins the next
    inner = np.concatenate([[0], np.cumsum(border)])
    owners, buckets = [], []
    value = text.copy()
    for n in range(2, NGRAMS[1] + 1):
        value = value[:-1] * np.uint32(0x01000193) + text[n - 1 :]
        if n >= NGRAMS[0]:
            first = np.arange(len(value))
            whole = inner[first + n - 1] == inner[first + 1]  # no border but at its ends
            mixed = (value[whole] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            buckets.append((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
            owners.append(word[first[whole] + 1])
    return np.concatenate(owners), np.concatenate(buckets)


def _distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column, and the pairs (row, index of the word) without repetition."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pairs = np.unique(row << 32 | words.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return words.dictionary, pairs >> 32, pairs & 0xFFFFFFFF


def _values(texts: pa.Array, wanted: np.ndarray | None = None):
    """(row, bucket, number of distinct words of the row that have the bucket), in order."""
    words, row, word = _distinct_words(texts)
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    owner, bucket = word_features(words)
    if wanted is not None:
        keep = wanted[bucket]
        owner, bucket = owner[keep], bucket[keep]
    pairs = np.unique(owner << BUCKET_BITS | bucket)
    owner, bucket = pairs >> BUCKET_BITS, pairs & (1 << BUCKET_BITS) - 1
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    size = np.diff(first)[word]
    place = np.repeat(first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    found, count = np.unique(np.repeat(row, size) << BUCKET_BITS | bucket[place], return_counts=True)
    return found >> BUCKET_BITS, found & (1 << BUCKET_BITS) - 1, count


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = TRAIN_ROWS) -> Model:
    """Fits the classifier on at most `bound` rows of `labels` and their texts."""
    for_python(docs.sparkSession)
    with scope(docs.sparkSession):
        return _trained(docs, labels, doc_id, text, label, bound)


def _trained(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, bound: int) -> Model:
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(bound)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = written(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    totals = dict(sample.groupBy("toxic").count().collect())
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log((positive + 1) / (negative + 1))))

    def count(batches):
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            done = 0
            for part in _slices(batch.column(0), STRETCH_BYTES):
                toxic = batch.column(1).slice(done, len(part)).to_numpy()
                done += len(part)
                row, bucket, _ = _values(part)
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[toxic[row] == k], minlength=1 << BUCKET_BITS)
        held = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[1, held]), pa.array(seen[0, held])], names=["bucket", "p", "n"])

    sums = sample.mapInArrow(lean(count), "bucket long, p long, n long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    ratio = F.log((F.col("p") + 1) / (positive + 2)) - F.log((F.col("n") + 1) / (negative + 2))
    error = F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("n") + 1))
    clear = sums.select("bucket", ratio.alias("ratio")).where(F.abs(ratio / error) >= CLEAR).toPandas()  # a row for each bucket at most
    ratios = np.zeros(1 << BUCKET_BITS)
    ratios[clear["bucket"]] = clear["ratio"]
    if not len(clear):
        return Model(ratios, float(np.log((positive + 1) / (negative + 1))))
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def select(batches):
        wanted = held.value != 0
        place = np.cumsum(wanted) - 1
        kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        for batch in batches:
            done = 0
            for part in _slices(batch.column(0), STRETCH_BYTES):
                toxic = batch.column(1).slice(done, len(part))
                done += len(part)
                row, bucket, times = _values(part, wanted)
                bounds = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (place[bucket].astype(np.int32), np.log1p(times) * held.value[bucket])]
                sparse = pa.StructArray.from_arrays([pa.array(np.zeros(len(part), np.int8)), pa.array(np.full(len(part), wanted.sum(), np.int32)), *lists], fields=list(kind))
                yield pa.RecordBatch.from_arrays([toxic.cast(pa.float64()), sparse], names=["label", "features"])

    rows = sample.mapInArrow(lean(select), "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    balance = F.when(F.col("label") == 1, 0.5 / positive).otherwise(0.5 / negative)
    path = written(rows.withColumn("weight", balance)).inputFiles()
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT()), T.StructField("weight", T.DoubleType())])
    given = docs.sparkSession.read.schema(schema).parquet(*path)  # a vector is stored as this structure
    fitted = LogisticRegression(maxIter=STEPS, regParam=DECAY, standardization=False, weightCol="weight").fit(given)
    weight = np.zeros(1 << BUCKET_BITS)
    names = np.flatnonzero(ratios)
    weight[names] = fitted.coefficients.toArray() * ratios[names]
    return Model(weight, float(fitted.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds `name`: the probability that the text is toxic, by the model."""
    for_python(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(part: pa.Array) -> pa.Array:
        row, bucket, times = _values(part, held.value.weight != 0)
        raw = np.bincount(row, np.log1p(times) * held.value.weight[bucket], len(part)) + held.value.bias
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -50, 50))))

    def make():
        return lambda column: [pa.concat_arrays([one(part) for part in _slices(column, 2 * STRETCH_BYTES)] or [pa.array([], pa.float64())])]

    return _mapped(docs, text, [(name, T.DoubleType())], make)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; rows without a text stay if the empty text scores less."""
    name = next(n for n in ("_score" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    return score(docs, model, text, name).where(F.col(name) < threshold).select(*docs.columns)
