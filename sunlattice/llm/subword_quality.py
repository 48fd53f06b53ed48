"""A quality classifier on supervised subword embeddings.

A text is a bag of features: its words as they stand (runs of all but blanks,
with case and marks), their runs of 3 and 4 characters with one blank at the
edges, and a mark for a word that repeats the one before. Each is hashed to one of
`buckets` vectors; the mean of a text's vectors goes through a softmax of two
outputs. Vectors and outputs are learned together by stochastic gradient descent,
a text at a time, with a rate that falls to nothing.

Training takes at most about `max_rows` labelled rows and `max_bytes` of text, those
of the least hashes of ids; whole texts go in, in one task, in an order that the
seed sets, so reruns agree. Only the ids of that sample are sent to the workers.
Scoring needs no vectors: what the softmax sees of a feature is one number, so a
task holds `buckets` numbers and adds them up over each text.

A null or empty text has no features and gets the score of the bias, as does every
text where there are no labelled rows (0.5 then). Null labels and labels other than
0 and 1 teach nothing; rows that repeat id, text and label teach once, and an id
with two labels teaches both. Very long texts are scored whole. Repeated rows each get
a score, other columns play no part, and empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.common import prepare, saved

GRAMS = (3, 4)
SLICE = 1 << 20
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: The feature of a word that repeats the one before.
REPEAT = np.uint32(0)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _B
    return (h ^ (h >> np.uint32(13))) % np.uint32(buckets)


def pieces(texts: list[str | None]):
    """(first, end) of runs of texts of about a million characters, one text at least."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > lo and held + n > SLICE:
            yield lo, k
            lo, held = k, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)


def features(texts: list[str | None], buckets: int):
    """Arrays (bucket of each feature of one kind, row of each) over all texts; the kinds one after the other."""
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    c = np.frombuffer(("\n" + "".join((t or "") + "\n" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[1], 1 + np.cumsum(sizes)])
    blank = ((c >= 9) & (c <= 13)) | (c == 32)
    row_of = lambda at: np.searchsorted(start, at, side="right") - 1
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    if not len(first):
        return
    # A word is the sum of its characters, each with its place.
    place = np.arange(len(c), dtype=np.int64)
    inside = np.flatnonzero(~blank)
    length = end - first
    own = (place[inside] - np.repeat(first, length)).astype(np.uint32)
    mixed = (c[inside] + _A * own) * _B
    mixed ^= mixed >> np.uint32(16)
    word = np.add.reduceat(mixed * _A, np.cumsum(length) - length, dtype=np.uint32)
    row = row_of(first)
    yield np.maximum(_bucket(word, buckets), 1), row
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    yield np.full(len(again), REPEAT, np.uint32), row[again]
    blanks = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    h = c * _A
    at = 1
    for n in GRAMS:
        while at < n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _A + c[at:]
            at += 1
        last = len(c) - n + 1
        # Blanks at the edges only, and not both ends of a word missing.
        some = np.flatnonzero(blanks[n - 1 : n - 1 + last] == blanks[1 : 1 + last])
        yield np.maximum(_bucket(h[some] + np.uint32(n), buckets), 1), row_of(some + 1)


class Model:
    """Vectors of all buckets, outputs and biases of the classes 0 and 1."""

    def __init__(self, vectors: np.ndarray, outputs: np.ndarray, bias: np.ndarray):
        self.vectors, self.outputs, self.bias = vectors, outputs, bias
        self.seen = (vectors @ (outputs[1] - outputs[0])).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Softmax output of class 1 of each text."""
        out = np.zeros(len(texts))
        for lo, hi in pieces(texts):
            total, n = np.zeros(hi - lo), np.zeros(hi - lo)
            for bucket, row in features(texts[lo:hi], len(self.seen)):
                total += np.bincount(row, self.seen[bucket], hi - lo)
                n += np.bincount(row, minlength=hi - lo)
            out[lo:hi] = total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias[1] - self.bias[0], -500, 500)))


def bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Different features of a text and the share of each."""
    found = [b for b, _ in features([text], buckets)]
    bucket, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0))
    return bucket, (n / max(n.sum(), 1)).astype(np.float32)


def fit(texts: list[str | None], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent over the texts. Vectors move so that the mean of a text moves by the rate, however many it has."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    outputs = np.zeros((2, dim), np.float32)
    # The biases begin at the shares of the classes.
    bias = np.log((np.bincount(y, minlength=2) + 1) / (len(y) + 2)) if len(y) else np.zeros(2)
    bags = [bag(t, buckets) for t in texts]
    step, steps = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)).tolist():
            bucket, share = bags[k]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[bucket]
            z = outputs @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ outputs
            outputs -= (lr * p[:, None] * mean).astype(np.float32)
            bias -= 0.1 * lr * p
            if len(bucket):
                vectors[bucket] -= (lr / (share @ share)) * share[:, None] * back.astype(np.float32)
    return Model(vectors, outputs, bias)


def training_rows(docs: DataFrame, labels: DataFrame, may_learn, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """doc_id, text, y: a written table of at most about max_rows rows and max_bytes bytes of labelled rows of docs.

    may_learn: a boolean column over doc_id.
    """
    known = labels.filter(may_learn).filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null").distinct()
    steps = 1 << 30
    rank = F.pmod(F.xxhash64("doc_id", "y"), F.lit(steps))
    total = known.count()
    ids = known.filter(rank < int(steps * min(1.0, max_rows / max(total, 1))))
    # About max_rows ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text", "y"])
    rows = saved(rows, "quality-rows")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(1.0, max_rows / max(size.n, 1), max_bytes / max(size.bytes or 0, 1))
    return rows.filter(F.pmod(F.xxhash64("y", "doc_id", F.lit(1)), F.lit(steps)) < int(share * steps)) if share < 1 else rows


def train(rows: DataFrame, **fitting) -> Model:
    """The model of rows (doc_id, text, y), a bounded sample, made in one task."""

    def run(batches):
        held = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        held.sort(key=lambda r: (r[0], r[2], r[1]))
        m = fit([t for _, t, _ in held], [y for *_, y in held], **fitting)
        yield pa.RecordBatch.from_pydict({"vectors": [m.vectors.tobytes()], "outputs": [m.outputs.tobytes()], "bias": [m.bias.tobytes()]})

    found = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "vectors binary, outputs binary, bias binary").collect()
    if not found:
        return fit([], [], **fitting)
    outputs = np.frombuffer(found[0].outputs, np.float32).reshape(2, -1)
    return Model(np.frombuffer(found[0].vectors, np.float32).reshape(-1, outputs.shape[1]), outputs, np.frombuffer(found[0].bias, np.float64))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """doc_id and the score of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], ["doc_id", name])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {name} double")


def judge(docs: DataFrame, labels: DataFrame, may_learn, label: str = "quality", threshold: float = 0.7, max_rows: int = 8192, max_bytes: int = 64 << 20, **fitting) -> DataFrame:
    """doc_id, score, predicted (1 with a score of `threshold` or more) of each row of docs."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, may_learn, label, max_rows, max_bytes)
    model = train(rows, **fitting)
    return score(docs, model).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
