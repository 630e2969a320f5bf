"""Line dedup: exact reference counts behind sharded cuckoo filters; insertions and deletions reversible.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased; keys of at
least ``MIN_CHARS`` code points count. State:

* ``holdings(k1, k2, doc_id)``: which document holds which key (128-bit XXH3 of the key), each pair
  once. ``insert`` adds a batch of documents, ``delete`` takes documents out again; inserting and then
  deleting a batch gives back the state before it.
* ``references(k1, k2, n_docs, last_doc)``: the exact reference-count table, an aggregate of the
  holdings with partial sums before the shuffle.
* ``filters(shard, filter)``: a cuckoo filter for each shard of the keys held by at least ``MIN_DOCS``
  documents (the shard count follows the number of keys, so a shard has a bounded size). Filters
  support single insertions and deletions (``update_filters``), so a batch that makes keys repeated, or
  no longer repeated, changes the shards it touches in place; a shard that has become too full for its size is
  built anew, larger, from the exact reference table.

Applying: holdings stream through the filter of their shard (no false negatives; a line that occurs
too rarely passes no further, but for one in some thousands), survivors are checked against the
reference table by an exact join, and the lines to drop go back to their documents. Shards are salted
by document, with as many salts as it takes for about ``TASK_ROWS`` holdings a task, so a key held by a third of
all documents is dealt over tasks in proportion; a filter is repeated for each salt.

Defined cases: a null or empty text is one empty line; documents are told apart by doc_id, rows that
repeat an id count as one document and all keep (or lose) the line; a null id is a document smaller
than all others; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloss.llm.common import MIN_LONG, cut, nested, texts
from opsloss.llm.textvec import U, mix

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 50_000
TASK_ROWS = 100_000
HELD = "k1 long, k2 long, doc_id long"


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit tags; each key may sit in two buckets, and either is
    found from the other and the tag. Keys that find no place wait in an exact stash."""

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int = 0, tags: np.ndarray | None = None, stash: list[int] | None = None):
        size = 1
        while size * self.SLOTS * 0.9 < keys:
            size *= 2
        self.tags = np.zeros((size, self.SLOTS), dtype=np.uint16) if tags is None else tags
        self.stash = list(stash or [])

    def held(self) -> int:
        return int(np.count_nonzero(self.tags)) + len(self.stash)

    def room(self) -> int:
        """Keys that fit without long chains of moves."""
        return int(self.tags.size * 0.9)

    def _place(self, k: np.ndarray):
        h = mix(k.astype(np.int64).view(U) + U(0x51ED270B))
        tag = ((h >> U(48)).astype(np.uint16) | np.uint16(1))
        mask = U(len(self.tags) - 1)
        first = h & mask
        return tag, first, (first ^ mix(tag.astype(U))) & mask

    def insert(self, keys: np.ndarray) -> None:
        size = len(self.tags)
        for key, tag, i, j in zip(keys.tolist(), *(x.tolist() for x in self._place(keys))):
            for b in (i, j):
                free = np.flatnonzero(self.tags[b] == 0)
                if len(free):
                    self.tags[b, free[0]] = tag
                    break
            else:
                moves, b, t = [], i, tag
                for kick in range(self.KICKS):
                    slot = (b + kick) % self.SLOTS
                    moves.append((b, slot))
                    t, self.tags[b, slot] = int(self.tags[b, slot]), t
                    b = (b ^ int(mix(np.array([t], dtype=U))[0])) & (size - 1)
                    free = np.flatnonzero(self.tags[b] == 0)
                    if len(free):
                        self.tags[b, free[0]] = t
                        break
                else:                                      # undo, and keep the key as it is
                    for b, slot in reversed(moves):
                        t, self.tags[b, slot] = int(self.tags[b, slot]), t
                    self.stash.append(key)

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for key, tag, i, j in zip(keys.tolist(), *(x.tolist() for x in self._place(keys))):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for b in (i, j):
                at = np.flatnonzero(self.tags[b] == tag)
                if len(at):
                    self.tags[b, at[0]] = 0
                    break

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.int64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, i, j = self._place(keys)
        i, j = i.astype(np.int64), j.astype(np.int64)
        found = (self.tags[i] == tag[:, None]).any(axis=1) | (self.tags[j] == tag[:, None]).any(axis=1)
        return found | np.isin(keys, self.stash) if self.stash else found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.tags), len(self.stash)], dtype="<i8").tobytes()
        return head + np.array(self.stash, dtype="<i8").tobytes() + self.tags.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Cuckoo":
        size, stash = np.frombuffer(raw[:16], "<i8")
        at = 16 + 8 * int(stash)
        return cls(tags=np.frombuffer(raw[at:], "<u2").reshape(int(size), cls.SLOTS).copy(),
                   stash=np.frombuffer(raw[16:at], "<i8").tolist())


def _keys(text: str) -> list[bytes | None]:
    """The key's digest of each line, None for a line whose key is too short."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        long = len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def holdings(docs: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            found = [sorted({k for k in _keys(t) if k is not None}) for t in pdf["text"]]
            k = _halves([d for keys in found for d in keys])
            ids = np.repeat(pdf["doc_id"].to_numpy(dtype=np.int64), [len(x) for x in found])
            yield pd.DataFrame({"k1": k[:, 0], "k2": k[:, 1], "doc_id": ids})

    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(MIN_LONG)))
    return rows.mapInPandas(run, HELD).distinct()


def insert(state: DataFrame, docs: DataFrame) -> DataFrame:
    """Holdings after ``docs`` are added; documents already there change nothing."""
    return state.unionByName(holdings(docs)).distinct()


def delete(state: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Holdings without the documents of ``doc_ids(doc_id)``."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias("doc_id")).distinct()
    return state.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id")


def references(state: DataFrame) -> DataFrame:
    return state.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def repeated(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    return refs.filter(F.col("n_docs") >= min_docs)


def _shard(shards: int):
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int, room: float = 1.0) -> DataFrame:
    """(shard, filter): a cuckoo filter of each shard's keys(k1, k2), with room for ``room`` times as many."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo(int(len(pdf) * room))
        f.insert(np.sort(pdf["k1"].to_numpy()))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [f.to_bytes()]})

    return (keys.select(_shard(shards).alias("shard"), "k1").groupBy("shard")
            .applyInPandas(run, "shard int, filter binary"))


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int, often: DataFrame) -> DataFrame:
    """Filters after keys became repeated (``added``) or ceased to be (``removed``).

    ``often(k1, k2)``: all repeated keys after the change. Shards whose new keys do not fit their filter's size are built
    from it with room for twice their keys; all others change in place."""
    def run(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else change)["shard"].iloc[0]
        f = Cuckoo.from_bytes(old["filter"].iloc[0]) if len(old) else None
        gone, new = (change.loc[change["sign"] == x, "k1"].to_numpy() for x in (-1, 1))
        if f is not None:
            f.delete(gone)
        if len(new) and (f is None or f.held() + len(new) > f.room()):
            return pd.DataFrame({"shard": [shard], "filter": [None]})
        if len(new):
            f.insert(new)
        return pd.DataFrame({"shard": [shard], "filter": [f.to_bytes()] if f is not None else [None]})

    change = added.select(_shard(shards).alias("shard"), "k1", F.lit(1).alias("sign")).unionByName(
        removed.select(_shard(shards).alias("shard"), "k1", F.lit(-1).alias("sign")))
    done = cut(filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(run, "shard int, filter binary"),
               "line_filters")
    full = done.filter("filter IS NULL").select("shard")
    own = often.select("k1", "k2", _shard(shards).alias("shard")).join(F.broadcast(full), "shard", "left_semi")
    return done.filter("filter IS NOT NULL").unionByName(build_filters(own, shards, 2.0))


def reshard(shards: int, keys: int) -> int:
    """The shard count for ``keys`` repeated keys: unchanged until a shard would pass twice its share. After a change all
    filters are built anew (``build_filters``), since a key's shard depends on the count."""
    want = max(1, -(-keys // SHARD_KEYS))
    return want if want > 2 * shards or 2 * want < shards else shards


def salts_for(rows: int, shards: int) -> int:
    """Salts a shard needs for about ``TASK_ROWS`` holdings a task."""
    return max(1, -(-rows // (shards * TASK_ROWS)))


def probe(held: DataFrame, filters: DataFrame, shards: int, salts: int) -> DataFrame:
    """The holdings whose key may be repeated: each streams through its shard's filter, which comes
    first in the sorted task, so one filter and one batch are in memory at a time."""
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts)).cast("int")
    rows = held.select(_shard(shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("kind"),
                       "k1", "k2", "doc_id", F.lit(None).cast("binary").alias("filter"))
    each = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                          F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k1"),
                          F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("doc_id"), "filter")

    def run(batches):
        now, f = None, None
        for pdf in batches:
            place = pdf["shard"].to_numpy(dtype=np.int64) * salts + pdf["salt"].to_numpy(dtype=np.int64)
            kind = pdf["kind"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (kind[1:] == 0)])) if len(pdf) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(pdf)]):
                if place[lo] != now:
                    now, f = place[lo], None
                if kind[lo] == 0:
                    f = Cuckoo.from_bytes(pdf["filter"].iloc[lo])
                    lo += 1
                if f is not None and lo < hi:
                    part = pdf.iloc[lo:hi]
                    yield part.loc[f.contains(part["k1"].to_numpy()), ["k1", "k2", "doc_id"]]

    return (rows.unionByName(each).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
            .mapInPandas(run, HELD))


def lines_to_drop(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, k1, k2): the keys each document loses; a key stays in the largest doc_id holding it."""
    held = cut(holdings(docs), "line_holdings")
    often = cut(repeated(references(held), min_docs), "line_references")
    shards = max(1, -(-often.count() // SHARD_KEYS))
    maybe = probe(held, build_filters(often, shards), shards, salts_for(held.count(), shards))
    return (maybe.join(often.select("k1", "k2", "last_doc"), ["k1", "k2"])
            .filter("doc_id < last_doc").select("doc_id", "k1", "k2"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so that no name clashes) and ``lines``: ``kept`` (the remaining lines,
    joined by newlines), ``n_lines`` (before) and ``n_dropped`` of every row."""
    lost = lines_to_drop(docs, min_docs).groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("lost"))
    joined = (nested(docs).withColumn("doc_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(MIN_LONG)))
              .join(lost, "doc_id", "left"))

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def remaining(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, lost):
            lines = t.split("\n")
            if gone is None or len(gone) == 0:
                out.append((t, len(lines), 0))
                continue
            drop = {np.array([x["k1"], x["k2"]], dtype="<i8").tobytes() for x in gone}
            stay = [x for x, k in zip(lines, _keys(t)) if k not in drop]
            out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    return joined.select("row", remaining(F.coalesce(F.col("row.text"), F.lit("")), "lost").alias("lines"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` and ``n_chars`` to match, the columns as before. Other columns
    may have any names."""
    changed = F.col("lines.n_dropped") > 0
    new = {c: F.col(f"row.`{c}`") for c in docs.columns}
    new["text"] = F.when(changed, F.col("lines.kept")).otherwise(new["text"])
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("lines.kept")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return dedup(docs, min_docs).select(*[new[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return dedup(texts(docs)).select("row.doc_id", "lines.n_lines", "lines.n_dropped",
                                     F.sha2(F.col("lines.kept"), 256).alias("kept_sha256"))
