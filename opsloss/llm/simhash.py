"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: XXH64 (seed 42) of every word shingle, repeats included; a bit of the fingerprint
is set when more than half of the hashes set it. Documents whose fingerprints differ in at most
``radius`` bits are linked; components are the links' transitive closure.

Comparison is exact and done in tiles: two sorted blocks of distinct fingerprints are compared
by exclusive-or and bit counts in numpy, and a pair of blocks is skipped when no population
count of the one is within the radius of one of the other. So that the work stays near the input
size, tiles are laid over *cells*: the 64 bits are cut into blocks, and a cell holds the
fingerprints that agree on some of the blocks. With radius r and r + k blocks, two fingerprints
within the radius agree on at least k blocks, so every linked pair meets in a cell and none is
lost; k grows with the number of fingerprints (``blocks_for``), which changes the work, not the
result. A cell above ``CELL`` fingerprints is split by population count (and, within one, by
hash) into sub-cells, and only pairs of sub-cells within the radius meet, each in its own task.
A task returns at most one link per fingerprint: a spanning forest of what it found.

Equal fingerprints are one row from the start, with the smallest doc_id, so a group of copies of
any size is one fingerprint. Nothing but counts reaches the driver.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows share their
component; a null doc_id counts as the smallest only if all are null; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloss.llm.common import MIN_LONG, cut, nested, texts
from opsloss.llm.components import components

RADIUS = 4
WORDS = 4
TILE = 1024
CELL = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if n == 0:
        return 0
    body = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(body, 42)
    size = [len(x) + 1 for x in w]
    begin = list(accumulate(size, initial=0))
    h = np.fromiter((digest(body[a:b - 1], 42) for a, b in zip(begin, begin[words:])),
                    dtype=np.uint64, count=n - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    rows = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[lo:lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    return texts(docs).mapInPandas(run, "doc_id long, fp long")


def keyed_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, digest, fp): with the digest of the text, which tells rows of one doc_id apart."""
    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "fp": fp})

    rows = texts(docs).withColumn("digest", F.md5("text"))
    return rows.mapInPandas(run, "doc_id long, digest string, fp long")


def blocks_for(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agreeing blocks): the fewest blocks whose cells hold about a tile or less."""
    k = 1
    while n * 2.0 ** -(64 * k / (radius + k)) > TILE and k < 6:
        k += 1
    return radius + k, k


def _roots(fp: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of its component's first one, by comparing tiles.
    side: 0 and 1 when two sub-cells meet (then only across), else all 0."""
    count = np.bitwise_count(fp)
    order = np.lexsort((count, side))
    f, c, s = fp[order], count[order].astype(np.int64), side[order]
    n, split = len(f), int(np.searchsorted(s, 1))
    parent = np.arange(n)
    if 0 < split < n:
        pairs = [(i, j) for i in range(0, split, TILE) for j in range(split, n, TILE)]
        end = lambda i: min(i + TILE, split if i < split else n)
    else:
        pairs = [(i, j) for i in range(0, n, TILE) for j in range(i, n, TILE)]
        end = lambda i: min(i + TILE, n)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = slice(i, end(i)), slice(j, end(j))
        if c[b][0] - c[a][-1] > radius or c[a][0] - c[b][-1] > radius:
            continue
        near = np.bitwise_count(f[a][:, None] ^ f[b][None, :]) <= radius
        if i == j:
            np.fill_diagonal(near, False)
        while near.any():
            # one link for each row and column that still has any, then drop what is joined by now
            row = np.flatnonzero(near.any(axis=1))
            col = np.flatnonzero(near.any(axis=0))
            for x, y in [*zip(row, near[row].argmax(axis=1)), *zip(near[:, col].argmax(axis=0), col)]:
                p, q = find(i + x), find(j + y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            ra = np.array([find(x) for x in range(a.start, a.stop)])
            rb = np.array([find(x) for x in range(b.start, b.stop)])
            near &= ra[:, None] != rb[None, :]
    out = np.empty(n, dtype=np.int64)
    out[order] = order[[find(x) for x in range(n)]]
    return out


def _cells(blocks: int, agree: int) -> list[int]:
    """Masks of the bits that a cell's fingerprints agree on."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(part, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps(fp)`` that join exactly the fingerprints
    connected by pairs within the radius."""
    n = fps.count()
    masks = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("v"))
             for i, x in enumerate(_cells(*blocks_for(n, radius)))]
    placed = fps.select("fp", F.explode(F.array(*masks)).alias("c")).select("fp", "c.m", "c.v")
    sizes = placed.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1")
    large = cut(sizes.filter(F.col("n") > cell), "cells")
    plain = placed.withColumns({"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)})
    if large.isEmpty():
        met = plain
    else:
        # a large cell: one sub-cell for each population count and hash share; pairs of sub-cells
        # whose counts are within the radius meet, each under a key of its own
        hot = placed.join(F.broadcast(large) if large.count() < 10_000 else large, ["m", "v"])
        hot = (hot.withColumn("c", F.bit_count("fp"))
               .withColumn("s", F.greatest(F.lit(1), F.ceil(F.col("n") / (4.0 * cell))).cast("int"))
               .withColumn("h", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")))
        own = (F.col("c") * F.col("s") + F.col("h")).cast("int")
        other = F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - radius) * F.col("s"),
                                     (F.least(F.lit(64), F.col("c") + radius) + 1) * F.col("s") - 1))
        hot = hot.withColumn("own", own).withColumn("other", other)
        hot = hot.select("fp", "m", "v", (F.least("own", "other") + 1).cast("int").alias("p"),
                         (F.greatest("own", "other") + 1).cast("int").alias("q"),
                         F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
        met = plain.join(large.select("m", "v"), ["m", "v"], "left_anti").unionByName(hot)

    def run(batches):
        def tile(key, fp, side):
            fp, side = np.concatenate(fp).view(np.uint64), np.concatenate(side)
            if len(fp) < 2:
                return None
            root = _roots(fp, side, radius)
            far = np.flatnonzero(root != np.arange(len(fp)))
            signed = fp.view(np.int64)
            return pd.DataFrame({"a": signed[far], "b": signed[root[far]]}) if len(far) else None

        key, fp, side = None, [], []
        for pdf in batches:
            keys = pdf[["m", "v", "p", "q"]].to_numpy(dtype=np.int64)
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(pdf) else []
            f, s = pdf["fp"].to_numpy(dtype=np.int64), pdf["side"].to_numpy()
            for lo, hi in zip(new, [*new[1:], len(pdf)]):
                if key is not None and tuple(keys[lo]) != key:
                    if (got := tile(key, fp, side)) is not None:
                        yield got
                    fp, side = [], []
                key = tuple(keys[lo])
                fp.append(f[lo:hi])
                side.append(s[lo:hi])
        if key is not None and (got := tile(key, fp, side)) is not None:
            yield got

    order = ["m", "v", "p", "q"]
    return (met.repartition(*order).sortWithinPartitions(*order)
            .mapInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row."""
    own = cut(fingerprints(docs, words), "simhash")
    first = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash_distinct")
    root = components(links(first.select("fp"), radius, cell))
    class_of = first.join(root, first["fp"] == root["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = class_of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = class_of.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One row of each group stays, every column kept: the one with the smallest doc_id (null ids come
    last) and, among rows that repeat it, the smallest digest of the text; of equal rows one stays."""
    own = cut(keyed_fingerprints(docs, words), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = cut(own.groupBy("fp").agg(F.min(row).alias("first")), "simhash_distinct")
    root = components(links(first.select("fp"), radius, cell))
    stay = (first.join(root, first["fp"] == root["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first"))
            .select(F.coalesce("first.doc_id", F.lit(MIN_LONG)).alias("keep"), F.col("first.digest").alias("digest")))
    key = ["keep", "digest"]
    one = Window.partitionBy(*key).orderBy(F.col("row.doc_id").asc_nulls_last(), F.col("row.text").asc_nulls_first())
    keyed = (nested(docs).withColumn("keep", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(MIN_LONG)))
             .withColumn("digest", F.md5(F.coalesce(F.col("row.text"), F.lit("")))))
    return (keyed.join(stay, key).withColumn("nth", F.row_number().over(one)).filter("nth = 1")
            .select(*[F.col(f"row.`{c}`") for c in docs.columns]))
