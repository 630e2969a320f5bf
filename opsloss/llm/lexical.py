"""Ranked lexical search by bag deduplication.

Documents are cut down to the vocabulary of the items; a document's score for any item depends on its
term counts over that vocabulary and on its length norm ``m`` alone, so documents that agree in both
are one class. Classes are found by hash and verified by the whole vector (the window's key holds hash
and vector), scored once, and expanded to their members by ascending doc_id.

1. ``vectors``: one pass over the texts, in blocks of numpy; a written table of doc_id, length, term
   numbers and counts. N, L and the document counts of the terms are sums over it.
2. ``classes``: only a class's first ``k`` members by doc_id can appear among an item's first ``k``
   documents, so a row_number with a group limit cuts a class before its shuffle; a class with a third of all
   documents sends at most ``k`` rows from each task.
3. ``search``: each task scores its classes against the stated items, block by block, and gives an
   item's first ``k`` classes (by score, then smallest member); every document of the true first ``k``
   lies in one of them. Windows over those rows rank classes, then their members.

Items are taken in sets whose terms add up to at most ``ITEM_BYTES`` (a single larger item is a set by
itself), so what the driver holds and sends is bounded however many items there are.

Defined cases: a null or empty text has no terms and never appears; rows that repeat an item_id are one
item with all their terms; rows that repeat a doc_id are documents of their own; a null doc_id ranks
before all others among equal scores; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloss.llm.common import MIN_LONG, cut, texts
from opsloss.llm.tokens import Tokens, byte_class

K = 20
ITEM_BYTES = 32 << 20       # terms of the items searched at a time
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = byte_class(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELLS = 1 << 21             # scores held at a time


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, qtf."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("qtf")))


def item_sets(items: DataFrame, limit: int = ITEM_BYTES):
    """Rows (item_id, term, qtf) of the items, some whole items at a time."""
    terms = cut(item_terms(items), "lexical_items")
    size = F.sum(F.octet_length("term") + 24)
    by_item = terms.groupBy("item_id").agg(size.alias("b"))
    total, largest = by_item.agg(F.sum("b"), F.max("b")).first()
    n = max(1, -(-(total or 0) // limit))
    while n > 1:
        part = F.pmod(F.xxhash64("item_id"), F.lit(n))
        if by_item.groupBy(part).agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] <= max(limit, largest):
            break
        n *= 2
    for i in range(n):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()
        if rows or i == 0:
            yield rows


class Items:
    """The terms of some items as arrays: postings of term t are item[start[t]:start[t + 1]] and qtf alike."""

    def __init__(self, rows):
        self.ids = sorted({r.item_id for r in rows}, key=lambda x: (x is not None, x))
        place = {x: i for i, x in enumerate(self.ids)}
        self.vocabulary = {w.encode(): i for i, w in enumerate(sorted({r.term for r in rows}))}
        term = np.array([self.vocabulary[r.term.encode()] for r in rows], dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.item = np.array([place[r.item_id] for r in rows], dtype=np.int64)[order]
        self.qtf = np.array([r.qtf for r in rows], dtype=np.int64)[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), terms, tfs: the documents that have a term at all, written."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    size = max(1, len(vocabulary))

    def run(batches):
        find = shared.value.get
        for b in batches:
            t = Tokens(b.column("text"), TERM)
            known = np.array([find(w, -1) for w in t.distinct.to_pylist()], dtype=np.int64)
            n = np.bincount(t.row, minlength=b.num_rows)
            term = known[t.code] if len(t.row) else t.row
            key, tf = np.unique((t.row * size + term)[term >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(b.num_rows + 1) * size).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(key % size, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return cut(texts(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "lexical_vectors")


def classes(vecs: DataFrame, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """terms, tfs, m, members (the first k by doc_id): one row for each class of equal vector and m."""
    m = F.expr(f"75 + (cast(25 as decimal(38, 0)) * n * {n_docs}BD) div {max(1, n_terms)}BD")
    key = ["h", "terms", "tfs", "m"]
    rows = (vecs.filter(F.size("terms") > 0).withColumn("m", m)
            .withColumn("h", F.xxhash64("terms", "tfs", "m")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).filter(F.col("nth") <= k)
    members = F.transform(F.sort_array(F.collect_list(F.struct("doc_id"))), lambda x: x["doc_id"])
    return first.groupBy(*key).agg(members.alias("members")).drop("h")


def _prune(item, score, low, members, k):
    """The first k of each item by score, then smallest member; and each item's k-th score where it is full."""
    order = np.lexsort((low, -score, item))
    item, score, low, members = item[order], score[order], low[order], members[order]
    nth = np.arange(len(item)) - np.searchsorted(item, item)
    keep = nth < k
    return item[keep], score[keep], low[keep], members[keep], (item[nth == k - 1], score[nth == k - 1])


def first_classes(found: DataFrame, items: Items, weight: np.ndarray, k: int) -> DataFrame:
    """item (its number), score, members: each task's first k classes for every item."""
    shared = found.sparkSession.sparkContext.broadcast((items.item, items.qtf, items.start, weight, len(items.ids)))

    def run(batches):
        item, qtf, start, w, n_items = shared.value
        best = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, object)]
        least = np.ones(n_items, dtype=np.int64)       # a class below this is of no use to the item
        step = max(1, CELLS // max(1, n_items))
        for b in batches:
            members = np.empty(b.num_rows, dtype=object)
            members[:] = b.column("members").to_pylist()
            low = np.array([MIN_LONG if x[0] is None else x[0] for x in members], dtype=np.int64)
            m = b.column("m").to_numpy()
            terms, tfs = b.column("terms"), b.column("tfs").flatten().to_numpy()
            size = np.asarray(terms.value_lengths(), dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            term, owner = terms.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), size)
            gain = w[term] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[owner]))
            for lo in range(0, b.num_rows, step):
                hi = min(lo + step, b.num_rows)
                total = np.zeros((hi - lo) * n_items, dtype=np.int64)
                a, z = ends[lo], ends[hi]
                while a < z:                            # some postings at a time
                    width = start[term[a:z] + 1] - start[term[a:z]]
                    e = a + max(1, int(np.searchsorted(np.cumsum(width), CELLS, side="right")))
                    width, t = width[:e - a], term[a:e]
                    each = np.repeat(np.arange(e - a), width)
                    at = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width) + start[t][each]
                    np.add.at(total, (owner[a:e][each] - lo) * n_items + item[at], gain[a:e][each] * qtf[at])
                    a = e
                total = total.reshape(hi - lo, n_items)
                c, i = np.nonzero(total >= least)
                if len(c):
                    got = (i, total[c, i], low[lo + c], members[lo + c])
                    *best, (full, bound) = _prune(*(np.concatenate(x) for x in zip(best, got)), k)
                    least[full] = bound
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1], pa.int64()),
                                          pa.array(best[3].tolist(), pa.list_(pa.int64()))], ["item", "score", "members"])

    return found.mapInArrow(run, "item int, score long, members array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = K, limit: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's first k documents with a score above 0."""
    spark, out = docs.sparkSession, None
    for rows in item_sets(items, limit):
        query = Items(rows)
        vecs = vectors(docs, query.vocabulary)
        n_docs, n_terms = vecs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(vecs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
                           for t in range(len(query.vocabulary))], dtype=np.int64)
        found = first_classes(classes(vecs, n_docs, n_terms, k), query, weight, k)
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.expr("members[0]"))
        top = found.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k)
        top = top.select("item", "score", F.explode("members").alias("doc_id"))
        by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        top = top.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(query.ids)], "item int, item_id long")
        part = top.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
