"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus is counted once (pre-tokens, all documents); its most frequent ones, ``LEXICON`` at most (a
bound that does not grow with the corpus; equally frequent ones are all in or all out) are compiled, with the ids the merges give them, into a minimal
acyclic automaton whose states share suffixes. An arc carries the number of words that sort before
those behind it, so the outputs along a path add up to the word's index, and the index points at the
word's ids. The automaton is a handful of integer arrays in one file, which Spark ships to the
executors and every worker memory-maps. Batches are encoded by their distinct pre-tokens: all of them
walk the automaton together, one numpy step for each byte. A word that is not in it is merged exactly,
pair by pair in rank order, as byte-pair encoding defines: short words of a batch all together, each by its
pair of lowest rank in one numpy step; in a longer one pairs wait in a heap, so that a word of a
million bytes (no blanks in a whole text) takes n log n steps. Words above ``WORD`` bytes
never enter the lexicon, which bounds the file and what the driver holds in bytes.

Decoding concatenates the ids' bytes and reads them as UTF-8 (invalid sequences become U+FFFD, as in
the library); special tokens stand as their text.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text that spells a
special token gets its id there, as in the library; repeated rows are encoded alike; an empty table
gives an empty result (and an empty lexicon).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloss.llm import pretokens
from opsloss.llm.common import cut, slices, texts
from opsloss.llm.tokenfile import Pieces, spread, token_file
from opsloss.session import fresh_dir

LEXICON = 50_000
CHUNK = 1 << 20
WORD = 64                  # bytes of the longest word in the lexicon
COUNTED = 100_000          # distinct pre-tokens a counting task holds before it passes them on
CACHE = 150_000            # words merged by hand that a worker remembers,
CACHE_IDS = 1 << 22        # and the most ids of them


# ------------------------------------------------------------------ vocabulary

class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = bytes(char[c] for c in token) if all(c in char for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        letter = {b: self.ids[c] for c, b in char.items()}
        self.letters = [letter[b] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.decimal = [str(i) for i in range(size)]
        # the merges as arrays, sorted by pair, and the ids by rank
        pairs = np.array([a * size + b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.merged = np.zeros(len(spec["model"]["merges"]), dtype=np.int64)
        self.merged[self.ranks] = np.array([i for _, i in self.merges.values()], dtype=np.int64)[order]
        self.none = len(self.merged)                       # the rank of a pair that is not merged

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank is merged, leftmost first, until none is left."""
        s, merges = [self.letters[b] for b in word], self.merges
        if len(s) > WORD:
            return self._merge_long(s)
        while len(s) > 1:
            best, at = None, 0
            for i, pair in enumerate(zip(s, s[1:])):
                m = merges.get(pair)
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            s[at:at + 2] = [best[1]]
        return s

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * len(self.bytes) + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], self.none)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens one after the other, and how many each has.

        In every round each word merges its pair of lowest rank, all places of it from the left. That is the order of
        ``merge``: a pair that holds a merged id ranks behind the merge that made the id, so none of lower rank can
        appear while places of this one are left."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        done_word, done_ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(length > WORD).tolist():
            ids = self.merge(words[i])
            done_word.append(np.full(len(ids), i))
            done_ids.append(np.array(ids, dtype=np.int64))
        short = np.flatnonzero(length <= WORD)
        s = np.array(self.letters, dtype=np.int64)[np.frombuffer(b"".join([words[i] for i in short.tolist()]), dtype=np.uint8)]
        word = np.repeat(short, length[short])
        rank = np.full(len(s), self.none)                  # of the pair that begins here
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(self.pairs):
            rank[inner] = self._rank(s[inner], s[inner + 1])
        while len(s):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([begin, [len(s)]]))
            best = np.minimum.reduceat(rank, begin)
            over = best == self.none
            if over.any():                                 # nothing left to merge in these words
                out = np.repeat(over, size)
                done_word.append(word[out])
                done_ids.append(s[out])
                s, word, rank = s[~out], word[~out], rank[~out]
                best, size = best[~over], size[~over]
                if not len(s):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            # places that overlap (a pair of one id twice): every other one of a run, from the left
            run = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != at[:-1] + 1]), run, 0))
            at = at[(run - first) % 2 == 0]
            s[at] = self.merged[rank[at]]
            stay = np.ones(len(s), dtype=bool)
            stay[at + 1] = False
            place = np.cumsum(stay)[at] - 1
            s, word, rank = s[stay], word[stay], rank[stay]
            new = np.unique(np.concatenate([place, place[place > 0] - 1]))
            rank[new] = self.none
            new = new[new + 1 < len(s)]
            new = new[word[new] == word[new + 1]]
            rank[new] = self._rank(s[new], s[new + 1])
        owner, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same order of merges by a heap of (rank, place); a merged id stands at its pair's first place."""
        n, merges = len(s), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i) for i, pair in enumerate(zip(s, s[1:])) if (m := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            m = merges.get((s[i], s[j])) if s[i] >= 0 and j < n else None
            if m is None or m[0] != rank:                  # one of the pair was merged meanwhile
                continue
            s[i], s[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (m := merges.get((s[left], s[right]))):
                    heapq.heappush(heap, (m[0], left))
        return [x for x in s if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.flat, self.begin[ids], self.size[ids])[0].tobytes()


# ------------------------------------------------------------------ automaton

class Transducer:
    """The arrays of a minimal acyclic automaton with word numbers, and the ids of each word."""

    NAMES = ("key", "target", "output", "final", "begin", "ids")

    def __init__(self, arrays: list[np.ndarray]):
        self.key, self.target, self.output, self.final, self.begin, self.ids = arrays

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> "Transducer":
        """From sorted words, a suffix is merged with an equal one as soon as no word can reach into it."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]                                          # states along the last word
        last = b""
        free: list[int] = []

        def close(depth):
            while len(path) - 1 > depth:
                child = path.pop()
                sign = (final[child], *arcs[child].items())
                same = known.setdefault(sign, child)
                if same != child:
                    arcs[path[-1]][last[len(path) - 1]] = same
                    free.append(child)

        order = sorted(words)
        for w in order:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            close(common)
            for b in w[common:]:
                if free:
                    new = free.pop()
                    arcs[new], final[new] = {}, False
                else:
                    new = len(arcs)
                    arcs.append({})
                    final.append(False)
                arcs[path[-1]][b] = new
                path.append(new)
            final[path[-1]] = True
            last = w
        close(0)
        # number the states that are in use, children known first: how many words each one leads to
        count: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                count[s] = int(final[s]) + sum(count[t] for t in arcs[s].values())
            elif s not in count:
                stack.append((s, True))
                stack += [(t, False) for t in arcs[s].values() if t not in count]
        number = {s: i for i, s in enumerate(sorted(count))}
        key, target, output = [], [], []
        for s, i in number.items():
            before = int(final[s])
            for b in sorted(arcs[s]):
                key.append(i << 8 | b)
                target.append(number[arcs[s][b]])
                output.append(before)
                before += count[arcs[s][b]]
        size = [len(words[w]) for w in order]
        return cls([np.array(key, dtype=np.int64), np.array(target, dtype=np.int64), np.array(output, dtype=np.int64),
                    np.array([final[s] for s in number], dtype=np.int64),
                    np.concatenate([[0], np.cumsum(size)]).astype(np.int64),
                    np.array([i for w in order for i in words[w]], dtype=np.int64)])

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, n) for n in self.NAMES]
        head = np.array([len(a) for a in arrays], dtype="<i8")
        return b"".join(a.astype("<i8").tobytes() for a in (head, *arrays))

    @classmethod
    def map(cls, path: str) -> "Transducer":
        """The arrays as views of a memory-mapped file."""
        raw = np.memmap(path, dtype="<i8", mode="r")
        at, arrays = len(cls.NAMES), []
        for n in raw[:len(cls.NAMES)].tolist():
            arrays.append(raw[at:at + n])
            at += n
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 if it is not in the lexicon."""
        n = len(words)
        if n == 0 or len(self.key) == 0:
            return np.full(n, -1, dtype=np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        body = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        state, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        state[size == 0] = -1
        while len(live):
            k = state[live] << 8 | body[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[arc] == k
            state[live] = np.where(hit, self.target[arc], -1)
            total[live] += np.where(hit, self.output[arc], 0)
            depth += 1
            live = live[hit & (size[live] > depth)]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] == 1), total, -1)


# ------------------------------------------------------------------ Spark

def count_pretokens(docs: DataFrame) -> DataFrame:
    """(piece, n) of the pre-tokens of at most ``WORD`` bytes over all documents; each task adds up
    before it passes counts on."""
    def run(batches):
        seen: dict[bytes, int] = {}

        def give():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()),
                                               pa.array(list(seen.values()), type=pa.int64())], names=["piece", "n"])

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for lo, hi in slices([len(t) for t in rows], CHUNK):
                raw, offset, _ = pretokens.split(rows[lo:hi])
                words, index = pretokens.distinct(raw, offset)
                for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist()):
                    if len(w) <= WORD:
                        seen[w] = seen.get(w, 0) + n
                if len(seen) > COUNTED:
                    yield give()
                    seen = {}
        if seen:
            yield give()

    return (texts(docs).select("text").mapInArrow(run, "piece binary, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = LEXICON) -> str:
    """Compile the most frequent pre-tokens and ship the file; returns its name for ``SparkFiles``."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(token_file(tokenizer))
    # the cut-off from a histogram of the counts (some hundred rows), so that the driver gets the chosen words only
    counted = cut(count_pretokens(docs), "pretokens")
    level = F.floor(F.log2("n") * 64).cast("int")
    at, room = None, size
    for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        if r["words"] > room:
            break
        at, room = r["level"], room - r["words"]
    top = counted.filter(level >= at).collect() if at is not None else []
    words = [bytes(r["piece"]) for r in top]
    ids, size = vocabulary.merge_all(words)
    ends = np.cumsum(size).tolist()
    raw = Transducer.compile({w: ids[e - n:e].tolist() for w, n, e in zip(words, size.tolist(), ends)}).to_bytes()
    return ship(spark, raw)


def ship(spark: SparkSession, raw: bytes) -> str:
    """Write bytes to the shared folder, through Hadoop's file system, and hand them to every executor."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = f"{fresh_dir(spark, 'lexicon')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(raw))
    out.close()
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    def __init__(self, lexicon: Transducer, vocabulary: Vocabulary):
        self.lexicon, self.vocabulary, self.merged = lexicon, vocabulary, Pieces()

    def _plain(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, offset, cuts = pretokens.split(docs)
        words, index = pretokens.distinct(raw, offset)
        at = self.lexicon.find(words)
        if len(self.merged) > CACHE or self.merged.used() > CACHE_IDS:
            self.merged.clear()
        known, unseen = self.merged.known, np.flatnonzero(at < 0)
        own = [words[i] for i in unseen.tolist()]
        new = [w for w in own if w not in known]
        self.merged.add_all(new, *self.vocabulary.merge_all(new))
        # one table of ids: the lexicon's, then those merged here
        flat = np.concatenate([self.lexicon.ids, self.merged.flat[:self.merged.used()]])
        begin, size = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        old = np.flatnonzero(at >= 0)
        begin[old] = self.lexicon.begin[at[old]]
        size[old] = self.lexicon.begin[at[old] + 1] - begin[old]
        place = np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own))
        begin[unseen] = self.merged.edge[place] + len(self.lexicon.ids)
        size[unseen] = self.merged.edge[place + 1] - self.merged.edge[place]
        ids, where = spread(flat, begin[index], size[index])
        return ids.astype(np.int32), where[cuts]

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the end)."""
        special = self.vocabulary.special
        if not any(s in t for t in docs for s in special):
            return self._plain(docs)
        import regex

        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        parts = [cut.split(t) for t in docs]                # text, special, text, special, ... text
        ids, where = self._plain([p for x in parts for p in x[0::2]])
        rows, k = [], 0
        for x in parts:
            own = []
            for i, p in enumerate(x):
                if i % 2:
                    own.append(np.array([special[p]], dtype=np.int32))
                else:
                    own.append(ids[where[k]:where[k + 1]])
                    k += 1
            rows.append(np.concatenate(own))
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_WORKER: dict[str, Encoder] = {}
_VOCABULARY: dict[str, Vocabulary] = {}


def vocabulary(tokenizer: str) -> Vocabulary:
    if tokenizer not in _VOCABULARY:
        _VOCABULARY[tokenizer] = Vocabulary(token_file(tokenizer))
    return _VOCABULARY[tokenizer]


def worker(name: str, tokenizer: str) -> Encoder:
    """One encoder for each worker process; the last lexicon only."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Encoder(Transducer.map(os.path.join(SparkFiles.getRootDirectory(), name)), vocabulary(tokenizer))
    return _WORKER[name]


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = LEXICON) -> DataFrame:
    """(doc_id, ids) of every row."""
    name = build_lexicon(docs, tokenizer, size)

    def run(batches):
        enc = worker(name, tokenizer)
        for batch in batches:
            names, rows = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in rows], CHUNK):
                ids, cuts = enc.encode(rows[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def run(batches):
        v = vocabulary(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "text": [v.decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace") for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(ids: np.ndarray, cuts: np.ndarray, v: Vocabulary) -> tuple[list[str], list[str]]:
    """SHA-256 of each document's decimal ids joined by commas, and of the text its ids decode to."""
    of_ids, of_text = [], []
    for a, b in zip(cuts, cuts[1:]):
        own = ids[a:b]
        of_ids.append(hashlib.sha256(",".join([v.decimal[i] for i in own.tolist()]).encode()).hexdigest())
        of_text.append(hashlib.sha256(v.decode(own).decode("utf-8", "replace").encode("utf-8")).hexdigest())
    return of_ids, of_text


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = LEXICON,
               with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encoded, and decoded from the ids, in one pass."""
    name = build_lexicon(docs, tokenizer, size)

    def run(batches):
        enc = worker(name, tokenizer)
        for batch in batches:
            names, rows = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in rows], CHUNK):
                ids, cuts = enc.encode(rows[lo:hi])
                of_ids, of_text = digests(ids, cuts, enc.vocabulary)
                out = {"doc_id": names.slice(lo, hi - lo), "n_tokens": pa.array(np.diff(cuts), type=pa.int64()),
                       "ids_sha256": pa.array(of_ids, type=pa.string()), "decoded_sha256": pa.array(of_text, type=pa.string())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts(docs).mapInArrow(run, schema)
