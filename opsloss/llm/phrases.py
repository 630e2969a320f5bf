"""Phrase collocation mining by dynamic itemset counting.

The corpus is dealt into ``SHARDS`` written shards, which are scanned in a cycle, one job a shard. All
words are counted from the first scan on. After each scan the phrases that have reached the threshold
so far are noted; from the next scan on a phrase of k words is counted as soon as both its subphrases of
k - 1 words have reached it. So all lengths are interleaved, and each phrase is counted through
one full cycle from the scan where it first occurred as a candidate. The cycles end when
no phrase is within its own any more. A phrase that reaches the threshold in all has subphrases that do,
and is counted for a whole cycle after they have.

* While it is open which phrases are frequent, they are told apart by their length and a 64-bit hash. Two phrases with one hash
  have their counts added; a last scan (``recount``) counts the words themselves of all that passed, which
  makes every reported count exact. A frequent phrase could only be lost if it shares its hash with one whose cycle began earlier
  and has few occurrences in each of both cycles: for 10^11 candidates, a few hundred of which share a hash at all,
  the chance is below 1 in 100.
* The notes that tasks need are a table of bytes for each length (by hash of language and words): the last scan before which
  a phrase with this hash reached the threshold. Its size follows from the words of the first shard, up to ``SLOTS`` bytes
  in all, and stays: a collision counts a phrase that need not be counted, which is harmless only if it goes on for a
  whole cycle. So a note never goes away, and none of another length, which is scanned at other times, takes its place.
* The shards hold each text with the hashes of its words, so texts are cut into words once. Hashes and counts are dealt
  over buckets by hash, about ``BUCKET`` words of the corpus to a bucket, and travel as sorted arrays: a row holds what
  one task has counted for a bucket and length.
* The state is a written table of such arrays (hashes, start, count, reached), renewed with every scan by
  merging the old state and the scan's counts bucket by bucket. Tasks add up their own counts first, so a word
  or pair in every document costs an entry a task. Phrases that stayed below the threshold for their whole
  cycle leave the state. Counts stop at the threshold there.
* The driver sees the notes as bit maps (at most SLOTS bits a scan) and never a phrase. A scan's state and broadcast go when
  the next state is written.

``collocations`` then joins each candidate's cuts with the counts of their parts, all of which are frequent
themselves, in exact decimal arithmetic, and drops candidates covered by a longer one.

Defined cases: null texts are empty, a null lang is ``und``, repeated rows count as often as they stand
there, ties are broken by count and phrase bytes, empty tables give an empty result. The hashes of one text must fit
in 2 GB (8 bytes for a word and 8 for a break), as those of any text below 256 MB do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from opsloss.llm.common import cut, slices, small_batches
from opsloss.llm.textvec import U, mix
from opsloss.llm.tokens import Tokens, byte_class
from opsloss.session import fresh_dir
from opsloss.sources.snapshots import delete_path

LONGEST = 5
LEAST = 100
TOP = 2000
COVER = 100                 # per cent of a candidate's count that a longer one needs to cover it
SHARDS = 4
SLOTS = 1 << 26             # most bytes of the tables of notes
FIRST = 1 << 16             # least bytes of one
BLOCK = 5 << 19             # bytes of text cut into words, or named, together in a task
KEYS = 3 << 20              # hashes that a task holds until it adds them up
BUCKET = 1 << 20            # words of the corpus to a bucket
BUCKETS = 16                # and least buckets
SPREAD = 64                 # buckets of the first ranking step
BREAK = byte_class(b".,;:!?\x0a\x0b\x0c\x0d")
WORD = ~(BREAK | byte_class(b" \t"))
SPARE = 32                  # slots for a phrase in the table of the last scan
OTHER = 32                  # a phrase has two there: by its hash, and by its hash without this many low bits
STEP = U(0x9E3779B97F4A7C15)
DEALT = "lang string, text string, shard int, hashes binary, n long"
COUNTED = "bucket int, words int, h binary, count binary"
STATE = "bucket int, words int, h binary, start binary, count binary, reached binary, new binary"
REACHED = "h long, words int, reached int"
NAMED = "lang string, words int, phrase string, hits long"


def shards(docs: DataFrame, n: int) -> DataFrame:
    """DEALT, in n folders by a hash of the row; no shuffle. ``hashes``: 64 bits for each word of the text, which its
    language is part of, and 0 before the first word of each piece; ``n``: the number of words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("shard"))

    def run(batches):
        for b in batches:
            for lo, hi in slices(pc.binary_length(b.column("text")).to_numpy().tolist(), BLOCK):
                part = b.slice(lo, hi - lo)
                hashes, n_words = hashed(part.column("lang"), part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, hashes, n_words], ["lang", "text", "shard", "hashes", "n"])

    # a word's hash takes 8 bytes each time; zstd finds them again where snappy does not
    return cut(rows.mapInArrow(run, DEALT), "phrase_shards", partition="shard", compression="zstd")


def hashed(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``hashes`` and ``n`` of each text."""
    t = Tokens(texts, WORD)
    coded = langs.dictionary_encode()
    seed = np.array([xxhash.xxh3_64_intdigest(x.encode(), 7) for x in coded.dictionary.to_pylist()], dtype=U)
    # words of one piece: of one text, with no break between them
    breaks = np.concatenate([[0], np.cumsum(BREAK[t.raw], dtype=np.int32)]) if len(t.raw) else np.zeros(1, np.int32)
    here = breaks[t.begin]
    opens = np.ones(len(t.begin), dtype=bool)
    opens[1:] = (t.row[1:] != t.row[:-1]) | (here[1:] != here[:-1])
    place = np.concatenate([[0], np.cumsum(1 + opens.astype(np.int64))])     # after the word before
    stream = np.zeros(int(place[-1]), dtype=U)
    if len(t.begin):
        stream[place[1:] - 1] = np.maximum(mix(t.hashes() ^ seed[coded.indices.to_numpy(zero_copy_only=False)[t.row]]), U(1))
    first = np.searchsorted(t.begin, t.at)
    offsets = (8 * place[first]).astype(np.int32)
    return (pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(stream)]),
            pa.array(np.diff(first), pa.int64()))


def stream(hashes: pa.Array) -> np.ndarray:
    """The hashes of all texts of a column, one after the other."""
    at = np.frombuffer(hashes.buffers()[1], dtype=np.int32)[hashes.offset:hashes.offset + len(hashes) + 1]
    lo, hi = (int(at[0]), int(at[-1])) if len(hashes) else (0, 0)
    return np.frombuffer(hashes.buffers()[2], dtype=U, count=(hi - lo) // 8, offset=lo) if hi > lo else np.zeros(0, U)


def candidates(words: np.ndarray, step: int, notes: np.ndarray, lengths: list[int], cycle: int):
    """Length and hashes of the phrases of the given lengths that are within their cycle. A phrase is a candidate since
    the last of the notes of all its parts was made."""
    at = np.flatnonzero(words)
    h = words[at]
    since = np.zeros(len(at), dtype=np.uint8)
    if 1 in lengths:
        yield 1, h
    for k in range(1, max(lengths)):
        note = notes[k - 1][(h & U(notes.shape[1] - 1)).astype(np.int64)]
        found = np.flatnonzero(note)
        at, h, since = at[found], h[found], np.maximum(note[found], since[found])
        next_too = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, since = at[next_too], np.maximum(since[next_too], since[next_too + 1])
        h = mix(h[next_too] * STEP + words[at + k])
        if k + 1 in lengths:
            yield k + 1, h[since.astype(np.int64) - 1 + cycle > step]


def _counted(keys: np.ndarray, words: int, buckets: int, least: int) -> pa.RecordBatch:
    """COUNTED of some hashes: for each bucket the distinct ones, ascending, and how often they occur (up to ``least``)."""
    h, hits = np.unique(keys, return_counts=True)
    hits = np.minimum(hits, least).astype(np.min_scalar_type(least))
    lows = [-(-(b << 32) // buckets) << 32 for b in range(1, buckets)]
    cuts = np.concatenate([[0], np.searchsorted(h, np.array(lows, dtype=U)), [len(h)]])
    full = np.flatnonzero(np.diff(cuts))
    ends = np.concatenate([cuts[full], [len(h)]])
    blobs = [pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
             for x in (h, hits)]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), words), pa.int32()), *blobs],
                                      ["bucket", "words", "h", "count"])


class Block:
    """Texts of several languages with the hashes of their words."""

    def __init__(self, langs: pa.Array, texts: pa.Array, hashes: np.ndarray):
        t = self.tokens = Tokens(texts, WORD)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[t.row]
        at = np.flatnonzero(hashes)
        self.word = hashes[at]
        self.joined = at[1:] == at[:-1] + 1                     # with the next word, in one piece

    def name(self, noted: np.ndarray, longest: int):
        """Record batches of NAMED: the phrases whose hash is noted, as words, and the number of all words (words 0). A
        frequent phrase has frequent parts, so a longer one needs both parts noted."""
        code, words = self.tokens.code, self.tokens.distinct
        mask = U(len(noted) - 1)
        at, h, number = np.arange(len(self.word)), self.word, self.lang   # number: which phrase, without its last word
        for k in range(1, longest + 1):
            here = np.flatnonzero(noted[(h & mask).astype(np.int64)])
            here = here[noted[(h[here] >> U(OTHER) & mask).astype(np.int64)]]
            at, h = at[here], h[here]
            if not len(at):
                break
            ids = number[here] << 32 | code[at + k - 1]
            _, first, number, hits = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            where = at[first]
            parts = [words.take(pa.array(code[where + i])) for i in range(k)]
            phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type)) if k > 1 else parts[0]
            yield self._named([self.langs[x] for x in self.lang[where]], k, phrases.cast(pa.large_string()).cast(pa.string()), hits)
            nexts = np.flatnonzero((at[1:] == at[:-1] + 1) & self.joined[at[:-1]])
            at, number = at[nexts], number[nexts]
            h = mix(h[nexts] * STEP + self.word[at + k])
        if len(self.lang):
            yield self._named(self.langs, 0, [""] * len(self.langs), np.bincount(self.lang, minlength=len(self.langs)))

    @staticmethod
    def _named(langs, k, phrases, hits):
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([k] * len(langs), pa.int32()),
                                           pa.array(phrases, pa.string()), pa.array(hits, pa.int64())],
                                          ["lang", "words", "phrase", "hits"])


def _blocks(batches):
    """The rows of the batches in lists of slices with about ``BLOCK`` bytes of text (a longer text by itself)."""
    held, size = [], 0
    for b in batches:
        length = pc.binary_length(b.column("text")).to_numpy()
        for lo, hi in slices(length.tolist(), BLOCK):
            n = int(length[lo:hi].sum())
            if held and size + n > BLOCK:
                yield held
                held, size = [], 0
            held.append(b.slice(lo, hi - lo))
            size += n
    if held:
        yield held


def scan(shard: DataFrame, step: int, shared, lengths: list[int], cycle: int, buckets: int, least: int) -> DataFrame:
    """COUNTED of one shard; ``shared``: the broadcast notes."""
    def run(batches):
        held = {k: [] for k in lengths}
        flush = lambda: [_counted(np.concatenate(v), k, buckets, least) for k, v in held.items() if v]
        for b in batches:
            for k, h in candidates(stream(b.column("hashes")), step, shared.value, lengths, cycle):
                if len(h):
                    held[k].append(h)
            if sum(len(h) for v in held.values() for h in v) >= KEYS:
                yield from flush()
                held = {k: [] for k in lengths}
        yield from flush()

    return shard.select("hashes").mapInArrow(run, COUNTED)


def recount(dealt: DataFrame, shared, longest: int, least: int) -> DataFrame:
    """lang, words, phrase, count of the frequent phrases, by their words; words 0: all words of lang."""
    def run(batches):
        for held in _blocks(batches):
            langs, texts = (pa.concat_arrays([b.column(name) for b in held]) for name in ("lang", "text"))
            yield from Block(langs, texts, np.concatenate([stream(b.column("hashes")) for b in held])).name(shared.value, longest)

    counts = dealt.select("lang", "text", "hashes").mapInArrow(run, NAMED).groupBy("lang", "words", "phrase").agg(F.sum("hits").alias("count"))
    return counts.filter((F.col("count") >= least) | (F.col("words") == 0))


def merge(state: DataFrame | None, counted: DataFrame, step: int, cycle: int, least: int) -> DataFrame:
    """The state after a scan. A phrase below the threshold is within the cycle that began with its first scan, or it has
    left; of the others the count does not matter any more (``recount`` has the exact one). ``new``: the hashes of those that
    reached the threshold in this scan."""
    kinds = {"h": U, "start": np.uint8, "count": np.min_scalar_type(least), "reached": np.uint8}     # reached 0: not yet

    def run(table: pa.Table) -> pa.Table:
        out, words = [], table.column("words").to_numpy()
        column = {c: table.column(c).combine_chunks() for c in kinds}
        read = lambda c, i: np.frombuffer(column[c][int(i)].as_buffer(), dtype=kinds[c])
        counts = table.column("start").is_null().to_numpy()
        for k in np.unique(words):
            h, start, count, reached = (np.concatenate([read(c, i) for i in np.flatnonzero((words == k) & ~counts)] or [np.zeros(0, t)])
                                        for c, t in kinds.items())
            found = np.flatnonzero((words == k) & counts)
            if len(found):
                key, hits = (np.concatenate([read(c, i) for i in found]) for c in ("h", "count"))
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key, hits = key[first], np.minimum(np.add.reduceat(hits[order].astype(np.int64), first), least)
                at = np.searchsorted(h, key)
                old = at < len(h)
                old[old] = h[at[old]] == key[old]
                count = count.astype(np.int64)
                count[at[old]] = np.minimum(count[at[old]] + hits[old], least)
                at = at[~old]
                h, start, count, reached = (np.insert(x, at, v) for x, v in (
                    (h, key[~old]), (start, np.uint8(step)), (count, hits[~old]), (reached, np.uint8(0))))
            new = (reached == 0) & (count >= least)
            reached = np.where(new, np.uint8(step + 1), reached)
            stay = (start.astype(np.int64) + cycle > step + 1) | (count >= least)
            out.append((table.column("bucket")[0].as_py(), int(k), *(x[stay].astype(t).tobytes() for x, t in zip((h, start, count, reached), kinds.values())),
                        h[new].tobytes()))
        names = ("bucket", "words", *kinds, "new")
        types = (pa.int32(), pa.int32(), *[pa.binary()] * (len(kinds) + 1))
        return pa.table({n: pa.array(v, t) for n, t, v in zip(names, types, zip(*out))})

    rows = counted if state is None else state.drop("new").unionByName(counted, allowMissingColumns=True)
    for c in ("start", "reached"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("binary"))
    return rows.select("bucket", "words", *kinds).groupBy("bucket").applyInArrow(run, STATE)


def reached(state: DataFrame, step: int | None = None) -> DataFrame:
    """REACHED: a row for each phrase in the state that has reached the threshold (with ``step``, in the scan of this number)."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                h = np.frombuffer(r["h"], dtype=np.int64)
                when = np.frombuffer(r["reached"], dtype=np.uint8) if "reached" in r else np.full(len(h), step + 1, dtype=np.uint8)
                h, when = h[when > 0], when[when > 0]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), r["words"]), pa.int32()), pa.array(when, pa.int32())],
                                                 ["h", "words", "reached"])

    rows = state.select("words", "h", "reached") if step is None else state.select("words", F.col("new").alias("h"))
    return rows.mapInArrow(run, REACHED)


def _maps(found: DataFrame, size: int, without: int = 0):
    """Rows (words, reached, slots) of the phrases of REACHED: the distinct slots of a table of ``size``, made of bit maps.
    The slot comes from the hash ``without`` some low bits."""
    slot = F.pmod(F.shiftrightunsigned("h", without), F.lit(size))
    maps = (found.groupBy("words", "reached", F.bitmap_bucket_number(slot).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect())
    for r in maps:
        bits = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little")
        # value v > 0 has bucket 1 + (v - 1) div size; value 0 is alone in bucket 0
        at = (r.bucket - 1) * len(bits) + np.flatnonzero(bits) + 1 if r.bucket else np.zeros(1, np.int64)
        yield r.words, r.reached, at % size


def table(words: int, least: int) -> np.ndarray:
    """Empty notes, a row for each length: at least two slots for each phrase of one length that can reach the threshold
    in a text of so many words."""
    size, most = 1, max(1, SLOTS // (LONGEST - 1))
    while size < most and size < max(FIRST, 2 * words // least):
        size *= 2
    return np.zeros((LONGEST - 1, size), dtype=np.uint8)


def note(state: DataFrame, notes: np.ndarray, step: int) -> tuple[np.ndarray, list[int]]:
    """The notes with the phrases that reached the threshold in scan ``step``, and their lengths. Bit maps reach
    the driver, no phrases."""
    new, lengths = notes.copy(), set()
    for words, when, at in _maps(reached(state.filter(F.col("words") < LONGEST), step), notes.shape[1]):
        lengths.add(words)
        new[words - 1, at] = when + 1
    return new, sorted(lengths)


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cycle: int = SHARDS) -> DataFrame:
    """lang, words, phrase, count: every phrase with at least ``least`` occurrences; words 0: all words of lang."""
    spark = docs.sparkSession
    dealt, state, old = shards(docs, cycle), None, None
    total = dealt.agg(F.sum("n")).first()[0] or 0
    notes, buckets = table(total, least), max(BUCKETS, total // BUCKET)
    last = {1: cycle}                                   # each length is scanned before this step
    step = 0
    while step < max(last.values()):
        lengths = [k for k in sorted(last) if step < last[k]]
        if lengths:
            shared = spark.sparkContext.broadcast(notes)
            counted = scan(dealt.filter(F.col("shard") == step % cycle), step, shared, lengths, cycle, buckets, least)
            place = fresh_dir(spark, "phrase_state")
            merge(state, counted, step, cycle, least).write.parquet(place)
            state = spark.read.schema(STATE).parquet(place)
            shared.destroy()                            # the state is written; nothing is computed from them again
            if old is not None:
                delete_path(spark, old)
            old = place
            notes, found = note(state, notes, step)
            for k in found:
                if k < longest:
                    last[k + 1] = step + 1 + cycle
        step += 1
    frequent = cut(reached(state), "phrase_reached")
    size, want = 1, SPARE * frequent.count()
    while size < min(want, SLOTS):
        size *= 2
    noted = np.zeros(size, dtype=bool)
    for without in (0, OTHER):
        for _, _, at in _maps(frequent, size, without):
            noted[at] = True
    return recount(dealt, spark.sparkContext.broadcast(noted), longest, least)


def _cuts(cand: DataFrame, longest: int) -> DataFrame:
    """Each candidate with its parts for every place to cut it."""
    w = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    c = cand.select("lang", "phrase", "words", F.col("count").alias("a"), w.alias("w"), cuts)
    return c.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))


def covered(cand: DataFrame, cover: int) -> DataFrame:
    """lang, phrase of the candidates inside a longer one that has ``cover`` per cent of their count."""
    w = F.split("phrase", " ")
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    sub = cand.filter(F.col("words") > 2).select(w.alias("w"), "lang", "words", "count", size)
    sub = sub.select("lang", "w", "size", "count", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    sub = sub.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "count")
    sub = sub.groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    return sub.join(cand, ["lang", "phrase"]).filter(100 * F.col("longer") >= cover * F.col("count")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER,
                 cycle: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts = cut(count_phrases(docs, least, longest, cycle), "phrase_counts")
    cand = counts.filter(F.col("words") >= 2)
    part = counts.filter(F.col("words").between(1, longest - 1)).select("lang", "phrase", "count")
    n = counts.filter(F.col("words") == 0).select("lang", F.col("count").alias("n"))
    rows = (_cuts(cand.join(covered(cand, cover), ["lang", "phrase"], "left_anti"), longest)
            .join(part.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r")), ["lang", "tail"]))
    # an average word has a count far below n, so the number of languages is small; AQE broadcasts n if its size allows
    big = lambda c: F.col(c).cast(DecimalType(20, 0))
    rows = rows.join(n, "lang").withColumns({"up": (F.lit(1000).cast(DecimalType(4, 0)) * big("a") * big("n")).cast(DecimalType(38, 0)),
                                             "down": (big("l") * big("r")).cast(DecimalType(38, 0))})
    rows = rows.withColumn("score", F.expr("up div down"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    nth = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
    best = best.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("nth", nth).filter(F.col("nth") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
