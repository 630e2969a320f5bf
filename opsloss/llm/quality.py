"""Quality classifier: supervised subword embeddings.

Every word, pair of neighbouring words, word shape and character n-gram is hashed to a bucket
with a learned vector. A document is the average of its word-side vectors plus the average of
its n-gram vectors; a softmax layer turns it into class probabilities. Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded labelled sample
(``common.SAMPLE_ROWS`` documents a class, ``common.SAMPLE_BYTES``).

Scoring is distributed and exact: the output layer is linear in the vectors, so each bucket's
vector is folded into one number (its difference of logits) and a document needs two averages
of looked-up numbers. The folded table (2 x 2^17 floats, 1 MB whatever the corpus) is the only
thing sent to the tasks.

Defined cases: a null or empty text has no features, its score is the trained layer's bias;
without learnable labels every score is 0.5, with one class only that class's share (0 or 1);
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloss.llm.common import labelled_sample, learn_row, slices, texts
from opsloss.llm.textvec import U, Bytes, mix, sums

BUCKETS = 1 << 17
WIDTH = 16
EPOCHS = 4
RATE = 0.4
GRAMS = (3, 4, 5)
CHUNK = 1 << 18

_CLASS = np.zeros(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[33:48] = np.arange(4, 19)
_CLASS[58:65] = np.arange(19, 26)
_CLASS[91:97] = np.arange(26, 32)
_CLASS[123:127] = np.arange(32, 36)
_CLASS[128:] = 1


def _shapes(cased: Bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the sequence of character classes of each word, runs taken once."""
    cls = _CLASS[cased.arr]
    new = np.concatenate([[True], cls[1:] != cls[:-1]])
    new[begin] = True
    at = np.flatnonzero(new & ~cased.space)
    cuts = np.searchsorted(at, np.concatenate([begin, [len(cls)]]))
    place = (np.arange(len(at)) - np.repeat(cuts[:-1], np.diff(cuts))).astype(U)
    parts = mix((cls[at] + U(1)) * U(131) + np.minimum(place, U(7)))
    total = np.concatenate([np.zeros(1, U), np.cumsum(parts, dtype=U)])
    return mix(total[cuts[1:]] - total[cuts[:-1]])


def features(docs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sides (words, n-grams): bucket numbers in text order, and the cuts between texts."""
    low, cased = Bytes(docs), Bytes(docs, lower=False)
    begin, end = low.words()
    cuts = low.per_text(begin)
    h = low.word_hashes(begin, end)
    first = np.zeros(len(h), dtype=bool)
    first[cuts[:-1][cuts[:-1] < len(h)]] = True
    before = np.concatenate([np.zeros(1, U), h[:-1]]) if len(h) else h
    before = np.where(first, U(7), before)
    pair = mix(h * U(0x9E3779B97F4A7C15) + before)
    again = np.where(h == before, U(1), U(2))            # a word that repeats the one before it
    rows = np.stack([h, pair, mix(_shapes(cased, begin, end) + U(3)), mix(again)], axis=1).reshape(-1)
    words = ((rows >> U(40)) % U(BUCKETS)).astype(np.int64)
    at, gram = [], []
    for n in GRAMS:
        a, g = low.grams(n)
        at.append(a)
        gram.append(g)
    at, gram = np.concatenate(at), np.concatenate(gram)
    order = np.argsort(at, kind="stable")
    at = at[order]
    chars = ((gram[order] >> U(40)) % U(BUCKETS)).astype(np.int64) + BUCKETS
    starts = low.start.copy()
    starts[:-1] -= 1                                      # an n-gram may begin at the separator before a text
    starts[-1] = len(low.arr)
    return [(words, cuts * 4), (chars, np.searchsorted(at, starts))]


def train(docs: list[str], y: np.ndarray, counts: list[int], epochs: int = EPOCHS, rate: float = RATE,
          width: int = WIDTH, seed: int = 1) -> tuple[np.ndarray, float]:
    """(folded table, bias): what each bucket and the layer add to the logit of label 1."""
    if len(docs) == 0 or len(set(y.tolist())) < 2:
        known = sum(counts)
        bias = 0.0 if not known else (40.0 if counts[1] == known else -40.0 if counts[0] == known else
                                      float(np.log(counts[1] / counts[0])))
        return np.zeros(2 * BUCKETS, dtype=np.float32), bias
    bags = []
    for lo, hi in slices([len(t) for t in docs], CHUNK):
        sides = features(docs[lo:hi])
        for i in range(hi - lo):
            ids, share = [], []
            for bucket, cuts in sides:
                b, c = np.unique(bucket[cuts[i]:cuts[i + 1]], return_counts=True)
                ids.append(b.astype(np.int32))
                share.append((c / max(1, c.sum())).astype(np.float32))
            bags.append((np.concatenate(ids), np.concatenate(share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (2 * BUCKETS, width)).astype(np.float32)
    layer = np.zeros((2, width), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen = np.bincount(y, minlength=2)
    weight = len(y) / (2.0 * seen)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            x = share @ vectors[ids] if len(ids) else np.zeros(width, np.float32)
            z = layer @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            p *= lr * weight[y[i]]
            back = p @ layer
            layer -= np.outer(p, x)
            bias -= p
            vectors[ids] -= share[:, None] * back[None, :] * 4.0   # sparse rows move a little faster
    fold = vectors @ (layer[1] - layer[0])
    # trained on balanced classes; the shares of all learnable rows come back as a shift of the bias
    shift = np.log(max(1, counts[1]) / max(1, counts[0]))
    return fold.astype(np.float32), float(bias[1] - bias[0] + shift)


def score_texts(docs: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(docs))
    for lo, hi in slices([len(t) for t in docs], CHUNK):
        z = np.full(hi - lo, bias)
        for bucket, cuts in features(docs[lo:hi]):
            z += sums(table[bucket], cuts) / np.maximum(1, np.diff(cuts))
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", held: tuple[int, int] = (4, 2),
             threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    spark = docs.sparkSession
    x, y, counts = labelled_sample(docs, labels, label, *held)
    model = spark.sparkContext.broadcast(train(x, y, counts))

    def run(batches):
        table, bias = model.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "score": score_texts(pdf["text"].tolist(), table, bias)})

    rows = texts(docs).select("doc_id", "text", learn_row("doc_id", *held).alias("held_out"))
    return (rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, every column kept. One pass: the text is
    scored where it is read, nothing is joined."""
    spark = docs.sparkSession
    x, y, counts = labelled_sample(docs, labels, "quality", 4, 2)
    model = spark.sparkContext.broadcast(train(x, y, counts))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        table, bias = model.value
        return pd.Series(score_texts(text.tolist(), table, bias))

    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= threshold)
