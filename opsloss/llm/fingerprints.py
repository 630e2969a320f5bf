"""Document fingerprints: a homomorphic multiset hash of a document's paragraphs.

A fingerprint is the sum of wide vectors, one for each paragraph (line), lane by lane modulo a
power of two. Sums commute, so the order of paragraphs does not matter, a paragraph is inserted or
deleted by adding or subtracting its vector (``add``, ``subtract``), and fingerprints of parts add
up to that of the whole.

Two groups of lanes:

* ``WIDE`` lanes modulo 2^64, uniformly random for each paragraph: equal exactly when the multisets
  of paragraphs are (but for chance, about 2^-1024).
* ``SIGNS`` lanes modulo 2^32, +1 or -1 for each group of ``GROUP`` words of a paragraph. A text has
  less than 2^31 bytes and a group of a full paragraph takes at least seven of them (its last one may take two, with
  its line end), so sums stay below 2^30 and never wrap, however often a group repeats; the squared length of a difference estimates in how many groups two
  documents differ. ``likeness`` is 1 - |a - b|^2 / (|a|^2 + |b|^2), cut to 0..1; its standard
  error is about 0.09, and equal fingerprints have likeness exactly 1.

Defined cases: a null text is the empty text, which has one empty paragraph; two texts without
words have likeness 1 when equal, else 0; repeated rows are documents of their own (order: doc_id
descending, then text); rows without an id come last; a single document is its own successor; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloss.llm.common import MIN_LONG, id_bounds, shuffle_partitions, texts, with_part
from opsloss.llm.textvec import U, mix

WIDE = 16
SIGNS = 128
GROUP = 4
_STEP = (np.arange(1, WIDE + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))[None, :]


def _wide(paragraphs: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    out = np.zeros(WIDE, dtype=U)
    for i in range(0, len(paragraphs), 4096):
        h = np.frombuffer(b"".join([digest(p) for p in paragraphs[i:i + 4096]]), dtype="<u8").reshape(-1, 2)
        out += mix(mix(h[:, :1] + _STEP) ^ (h[:, 1:] * (_STEP | U(1)))).sum(axis=0, dtype=U)
    return out


def _signs(paragraphs: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    out, n, groups = np.zeros(SIGNS, dtype=np.int64), 0, []

    def flush():
        nonlocal n
        rows = np.frombuffer(b"".join(groups), dtype=np.uint8).reshape(-1, SIGNS // 8)
        out[:] += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
        n += len(rows)
        groups.clear()

    for p in paragraphs:
        w = p.split()
        groups += [digest(b" ".join(w[i:i + GROUP])) for i in range(0, len(w), GROUP)]
        if len(groups) > 1 << 14:
            flush()
    if groups:
        flush()
    return (2 * out - n).astype(np.uint32)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    paragraphs = text.encode("utf-8", "surrogatepass").split(b"\n")
    return _wide(paragraphs), _signs(paragraphs)


def add(a, b):
    """Fingerprint of both multisets together."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a, b):
    """Fingerprint of ``a`` after the paragraphs of ``b`` are deleted from it."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a, b) -> float:
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    d = (a[1] - b[1]).view(np.int32).astype(np.float64)
    total = x @ x + y @ y
    return float(min(1.0, max(0.0, 1.0 - (d @ d) / total))) if total else 0.0


def encode(fp) -> str:
    return base64.b64encode(fp[0].astype("<u8").tobytes() + fp[1].astype("<u4").tobytes()).decode()


def decode(s: str):
    raw = base64.b64decode(s)
    return np.frombuffer(raw[:8 * WIDE], "<u8").astype(U), np.frombuffer(raw[8 * WIDE:], "<u4").astype(np.uint32)


def of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row, where the row is read (no shuffle)."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [encode(fingerprint(t)) for t in pdf["text"]]})

    return texts(docs).mapInPandas(run, "doc_id long, fingerprint string")


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows (part, tail, doc_id, text) dealt into ranges of ids. Sorted by part, tail and doc_id
    descending, each row that is not a tail is followed by its successor: the next document by
    descending doc_id, after the last one the first. The tail of a range is a copy of the first
    row of the next range that has any, so no range needs another task's rows."""
    spark = docs.sparkSession
    rows = texts(docs)
    bounds = id_bounds(rows, 4 * shuffle_partitions(spark))
    parts = with_part(rows, bounds)
    key = F.coalesce("doc_id", F.lit(MIN_LONG))
    # one small row for each range: its largest id; the first row is the smallest text among those with this id
    top = {r["part"]: r["top"] for r in
           with_part(rows.select("doc_id"), bounds).groupBy("part").agg(F.max(key).alias("top")).collect()}
    order = sorted(top, reverse=True)
    follows = [(part, top[order[(i + 1) % len(order)]]) for i, part in enumerate(order)]
    if not follows:
        return parts.select("part", F.lit(0).alias("tail"), "doc_id", "text")
    heads = spark.createDataFrame(follows, "part int, id long")
    ids = sorted({x for _, x in follows})
    head = (rows.filter(F.col("doc_id").isin(ids) | F.lit(MIN_LONG in ids) & F.col("doc_id").isNull())
            .withColumn("id", key).groupBy("id").agg(F.min("text").alias("text")))
    tails = head.join(F.broadcast(heads), "id").select(
        "part", F.lit(1).alias("tail"), F.col("id").alias("doc_id"), "text")
    return parts.select("part", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document against an edited text of it: the last floor(n / 3) code points replaced by the
    first as many (or all) of the successor. Columns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    def run(batches):
        held = None                                        # (part, doc_id, text, fingerprint)
        for pdf in batches:
            out = []
            for part, doc_id, text in zip(pdf["part"], pdf["doc_id"], pdf["text"]):
                fp = fingerprint(text)
                if held is not None and held[0] == part:
                    _, old_id, old, old_fp = held
                    n = len(old)
                    edited = old[:n - n // 3] + text[:n // 3]
                    edited_fp = fingerprint(edited)
                    out.append((old_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                encode(old_fp), encode(edited_fp), likeness(old_fp, edited_fp),
                                likeness(old_fp, fp)))
                held = (part, doc_id, text, fp)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint",
                                               "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = with_successor(docs).withColumn("key", F.coalesce("doc_id", F.lit(MIN_LONG)))
    rows = (rows.repartition("part").sortWithinPartitions("part", "tail", F.desc("key"), "text")
            .select("part", "doc_id", "text"))
    return rows.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
