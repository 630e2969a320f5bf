"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

For every hashed n-gram, r is the log of the ratio of its (smoothed) shares among toxic and other
training documents. Most ratios are chance; those of n-grams whose counts do not differ between the
classes by a likelihood-ratio test (root of G^2 below ``EVIDENCE``) are set to zero. Logistic regression then
learns one weight for each feature r * [n-gram occurs], so the score is linear: one number per
bucket, looked up and added.

A toxic passage must not drown in a long text, so a text is cut into windows of ``WINDOW`` words, one every
``STEP``, and scored by its worst window; every run of WINDOW - STEP + 1 words lies whole in one, wherever it
stands. Training picks each document's worst window in the same way and refits. The model (2^18
floats, 1 MB whatever the corpus) is all that is sent to the tasks. It learns from a bounded sample of
labelled rows (``common.SAMPLE_ROWS`` a class, ``common.SAMPLE_BYTES``); held-out rows never enter it. The
parameters were chosen on learnable rows only.

Defined cases: a null or empty text has one window without features, so its score is the bias;
without learnable labels every score is 0.5, with one class only that class's share; repeated rows
are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloss.llm.common import labelled_sample, learn_row, slices, texts
from opsloss.llm.textvec import U, Bytes

BUCKETS = 1 << 18
GRAMS = (4, 5, 6)
WINDOW = 32
STEP = 16
SMOOTH = 0.5
EVIDENCE = 4.0
BALANCE = 0.5               # power of the class weights: 0 none, 1 classes of equal weight
EPOCHS = 5
RATE = 0.1
RIDGE = 1e-4
SCALE = 0.25
ROUNDS = 3
CHUNK = 1 << 18


def occurrences(docs: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of some texts: text, word (its number in the text) and bucket of each, and the words of each text.
    ``wanted``: a boolean for each bucket, to leave out the others."""
    low = Bytes(docs)
    begin, _ = low.words()
    cuts = low.per_text(begin)
    text, word, bucket = [], [], []
    for n in GRAMS:
        at, gram = low.grams(n)
        b = ((gram >> U(40)) % U(BUCKETS)).astype(np.int64)
        if wanted is not None:
            ok = np.flatnonzero(wanted[b])
            at, b = at[ok], b[ok]
        w = np.searchsorted(begin, at + 1, side="right") - 1      # a gram may begin with its word's separator
        t = np.searchsorted(cuts, w, side="right") - 1
        text.append(t)
        word.append(w - cuts[t])
        bucket.append(b)
    return np.concatenate(text), np.concatenate(word), np.concatenate(bucket), np.diff(cuts)


def windows(docs: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct wanted buckets of each window; the cuts between windows; the first window of each text."""
    text, word, bucket, words = occurrences(docs, wanted)
    per = np.maximum(1, -(-(words - (WINDOW - STEP)) // STEP))
    first = np.concatenate([[0], np.cumsum(per)])
    last = np.minimum(word // STEP, per[text] - 1)
    size = last - np.maximum(0, -(-(word - WINDOW + 1) // STEP)) + 1       # an n-gram lies in so many windows
    back = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    window = np.repeat(first[text] + last, size) - back
    held = np.unique(window * BUCKETS + np.repeat(bucket, size))
    return held % BUCKETS, np.searchsorted(held, np.arange(first[-1] + 1) * BUCKETS), first


def ratios(holding: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log ratios of the smoothed shares of documents that hold a bucket's n-gram; zero without evidence."""
    total, g = holding.sum(axis=0), np.zeros(BUCKETS)
    for c in (0, 1):
        expected = total * n[c] / n.sum()
        for seen, e in ((holding[c], expected), (n[c] - holding[c], n[c] - expected)):
            g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(e, 1e-9)), 0.0)
    share = (holding + SMOOTH) / (n[:, None] + 2 * SMOOTH)
    return np.where(2 * g >= EVIDENCE ** 2, np.log(share[1] / share[0]), 0.0)


def train(docs: list[str], y: np.ndarray, counts: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    if len(docs) == 0 or len(set(y.tolist())) < 2:
        known = sum(counts)
        bias = 0.0 if not known else (40.0 if counts[1] == known else -40.0 if counts[0] == known else
                                      float(np.log(counts[1] / counts[0])))
        return np.zeros(BUCKETS, dtype=np.float32), bias
    parts = list(slices([len(t) for t in docs], CHUNK))
    holding, n = np.zeros((2, BUCKETS)), np.bincount(y, minlength=2).astype(np.float64)
    for lo, hi in parts:
        text, _, bucket, _ = occurrences(docs[lo:hi])
        once = np.unique(text * BUCKETS + bucket)
        for c in (0, 1):
            holding[c] += np.bincount(once[y[lo + once // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
    ratio = ratios(holding, n)
    bags = []                                   # of each document, the features of each window
    for lo, hi in parts:
        bucket, cuts, first = windows(docs[lo:hi], ratio != 0)
        bags += [[bucket[cuts[w]:cuts[w + 1]] for w in range(first[i], first[i + 1])] for i in range(hi - lo)]
    weight, bias = np.ones(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    balance = (len(y) / (2.0 * n)) ** BALANCE
    for _ in range(ROUNDS):
        table = ratio * weight
        worst = [max(bag, key=lambda ids: table[ids].sum()) for bag in bags]
        speed, speed_bias = np.full(BUCKETS, 1e-3), 1e-3
        for _ in range(EPOCHS):
            for i in rng.permutation(len(worst)):
                ids = worst[i]
                x = ratio[ids] * SCALE
                z = float(x @ weight[ids]) + bias
                gap = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i]) * balance[y[i]]
                step = gap * x + RIDGE * weight[ids]
                speed[ids] += step * step
                weight[ids] -= RATE * step / np.sqrt(speed[ids])
                speed_bias += gap * gap
                bias -= RATE * gap / np.sqrt(speed_bias)
    return (ratio * weight * SCALE).astype(np.float32), float(bias)


def score_texts(docs: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    out, wanted = np.zeros(len(docs)), table != 0
    for lo, hi in slices([len(t) for t in docs], CHUNK):
        bucket, cuts, first = windows(docs[lo:hi], wanted)
        window = np.repeat(np.arange(first[-1]), np.diff(cuts))
        z = np.maximum.reduceat(np.bincount(window, table[bucket], minlength=first[-1]), first[:-1]) + bias
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: tuple[int, int] = (5, 0),
             threshold: float = 0.5) -> DataFrame:
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
