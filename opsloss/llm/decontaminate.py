"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document when at least ``THRESHOLD`` of its distinct ``WORDS``-word
shingles (words: lower-cased A-Z, split at ASCII white space) occur in it. Items are partitioned by
their number of shingles into classes up to 2^k. For each class a document is cut into blocks of 2^k
shingles, and windows of two neighbouring blocks are signed with ``HASHES`` MinHash values; blocks of
the next class are minima of pairs, so a shingle is hashed once for all classes. An item of the class
lies whole in one window, whose Jaccard similarity with it is 0.2 or more, whatever the document's
length; with one row a band and 64 bands at least one value agrees with probability 1 - 0.8^64, above
0.999999. Candidates are then verified by exact containment of their shingles (strings, not hashes)
in the whole document.

Documents are signed and verified where they are read: no shuffle. Items are sent to the tasks in
sets of about ``ITEMS`` and ``ITEM_BYTES``, one pass over the documents each, so what is sent stays bounded however
large the benchmark grows. A single item is never split.

Defined cases: a null text has no shingles and matches nothing; an item of fewer than five words has
none either and is never reported; items that repeat an id and a text are one item; repeated documents
are reported each; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloss.llm.common import slices, texts
from opsloss.llm.textvec import Bytes, combine, mix

WORDS = 5
THRESHOLD = 0.8
HASHES = 64
ITEMS = 20_000
ITEM_BYTES = 32 << 20
CHUNK = 1 << 19
_ODD = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1))


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)}


def shingle_hashes(docs: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the cuts between texts."""
    low = Bytes(docs)
    begin, end = low.words()
    cuts = low.per_text(begin)
    h = combine(low.word_hashes(begin, end), words)
    n = np.diff(cuts)
    have = np.maximum(0, n - words + 1)
    out = np.concatenate([[0], np.cumsum(have)])
    at = np.arange(out[-1]) + np.repeat(cuts[:-1] - out[:-1], have)
    return h[at], out


class Index:
    """MinHash values of items by size class, and their shingles for verification."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        self.words, self.ids, self.sets = words, [], []
        by_class: dict[int, list[int]] = {}
        for item_id, text in items:
            s = shingles(text or "", words)
            if s:
                k = max(2, (len(s) - 1).bit_length()) if len(s) > 1 else 0      # one shingle: windows of two
                by_class.setdefault(k, []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(s)
        self.classes = []
        for k in sorted(by_class):
            rows = by_class[k]
            hashes = [self._hashes(i) for i in rows]
            low = np.array([[(h * o).min() for h in hashes] for o in _ODD], dtype=np.uint64)   # hashes x items
            order = np.argsort(low, axis=1, kind="stable")
            self.classes.append((k, np.take_along_axis(low, order, axis=1), np.array(rows)[order]))

    def _hashes(self, i: int) -> np.ndarray:
        return shingle_hashes([s.decode("utf-8", "surrogatepass") for s in self.sets[i]], self.words)[0]

    def candidates(self, docs: list[str]) -> set[tuple[int, int]]:
        """(text, item) pairs with a common MinHash value in some window."""
        found: set[tuple[int, int]] = set()
        if not self.classes:
            return found
        h, cuts = shingle_hashes(docs, self.words)
        level, low, first = self.classes[0][0], None, None
        for k, table, rows in self.classes:
            if low is None:
                size = 1 << k
                per = -(-np.diff(cuts) // size)
                first = np.concatenate([[0], np.cumsum(per)])
                if first[-1] == 0:
                    return found
                start = np.repeat(cuts[:-1], per) + (np.arange(first[-1]) - np.repeat(first[:-1], per)) * size
                low = np.stack([np.minimum.reduceat(h * o, start) for o in _ODD])       # hashes x blocks
            while level < k:                               # pairs of blocks make the next class's blocks
                per = np.diff(first)
                half = -(-per // 2)
                up = np.concatenate([[0], np.cumsum(half)])
                nth = np.arange(up[-1]) - np.repeat(up[:-1], half)
                left = np.repeat(first[:-1], half) + 2 * nth
                right = np.minimum(left + 1, np.repeat(first[1:], half) - 1)
                low, first, level = np.minimum(low[:, left], low[:, right]), up, level + 1
            owner = np.repeat(np.arange(len(docs)), np.diff(first))
            after = np.minimum(np.arange(first[-1]) + 1, np.repeat(first[1:], np.diff(first)) - 1)
            window = np.minimum(low, low[:, after])
            for j in range(HASHES):
                a = np.searchsorted(table[j], window[j], side="left")
                hit = np.flatnonzero(table[j][np.minimum(a, table.shape[1] - 1)] == window[j])
                for w in hit.tolist():
                    i = a[w]
                    while i < table.shape[1] and table[j][i] == window[j][w]:
                        found.add((int(owner[w]), int(rows[j][i])))
                        i += 1
        return found

    def search(self, docs: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles shared, shingles of the item), verified, sorted."""
        out, now, have = [], None, set()
        for t, i in sorted(self.candidates(docs)):
            if t != now:
                now, have = t, shingles(docs[t], self.words)
            shared, n = len(self.sets[i] & have), len(self.sets[i])
            if shared >= threshold * n:
                out.append((t, i, shared, n))
        return out


def item_sets(benchmark: DataFrame, items: int = ITEMS, size: int = ITEM_BYTES):
    """The benchmark as indexes of at most about ``items`` items and ``size`` bytes each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()
    rows = rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    # dealt by a hash, with room for its unevenness
    n, total, large = rows.agg(F.count("*"), F.coalesce(F.sum(F.least("bytes", F.lit(size))), F.lit(0)),
                               F.count_if(F.col("bytes") > size)).first()
    parts = max(1, -(-n // items), -(-2 * total // size) if total > size else 1) + large
    for i in range(parts):
        yield Index([(r["item_id"], r["text"]) for r in
                     rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()])


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every contained item."""
    spark, found = docs.sparkSession, None

    def over(index):
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            for pdf in batches:
                rows = pdf["text"].tolist()
                for lo, hi in slices([len(t) for t in rows], CHUNK):
                    hits = shared.value.search(rows[lo:hi], threshold)
                    frame = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[[lo + h[0] for h in hits]].reset_index(drop=True),
                                          "item_id": pd.array([shared.value.ids[h[1]] for h in hits], dtype="Int64"),
                                          "n_shared": [h[2] for h in hits], "n_shingles": [h[3] for h in hits]})
                    yield frame

        return texts(docs).mapInPandas(run, "doc_id long, item_id long, n_shared long, n_shingles long")

    for index in item_sets(benchmark, items):
        part = over(index)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def keep(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` that contain no item, every column kept."""
    spark = docs.sparkSession
    for index in item_sets(benchmark, items):
        shared = spark.sparkContext.broadcast(index)

        docs = docs.filter(_clean(shared, threshold)(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def _clean(shared, threshold: float):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        rows, out = text.tolist(), np.ones(len(text), dtype=bool)
        for lo, hi in slices([len(t) for t in rows], CHUNK):
            out[[lo + h[0] for h in shared.value.search(rows[lo:hi], threshold)]] = False
        return pd.Series(out)

    return clean
