"""Token-ID output: fixed-width bit packing with block offsets.

An image holds the ids of consecutive documents, each in the fewest bits that the vocabulary needs
(16 for 50,257 ids), least significant bit first, in blocks of ``BLOCK`` ids; every block begins at a
byte whose offset stands in the header, so any range of ids is unpacked alone, by numpy, from memory
or from a memory-mapped file. All numbers are little-endian:

    magic "FWBP", u32 bits, u64 ids, u32 ids a block, u32 documents,
    u64 byte offset of each block and of the end, i64 id and u64 first token of each document, blocks

Writing: documents are dealt into ranges of doc_id, each task encodes its ranges in ascending order
with the ``tokenizers`` library (distinct pre-tokens once, see ``pretokens``) and closes an image
after ``IMAGE_IDS`` ids. Images are rows of a Parquet table in the shared folder: Spark's committer
makes a lost or repeated task harmless, and any store that Spark writes to will do. Reading: images
carry their offset in the range; the offset of each range is a sum over the counts of the ranges
before it (one number for each range reaches the driver).

Defined cases: a null or empty text is the end id alone; repeated rows follow each other (order:
doc_id, text); rows without an id come first; an empty table gives no image and an empty result.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloss.llm import pretokens
from opsloss.llm.common import MIN_LONG, id_bounds, shuffle_partitions, slices, texts, with_part
from opsloss.session import fresh_dir

BLOCK = 1 << 16
IMAGE_IDS = 1 << 19
CHUNK = 1 << 20
CACHE = 400_000          # pieces a worker keeps, and the most ids of theirs
CACHE_IDS = 1 << 22
MAGIC = b"FWBP"


# ------------------------------------------------------------------ bit packing

def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(rows.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")[:n * bits].reshape(n, bits)
    return (rows.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build_image(ids: np.ndarray, doc_ids: np.ndarray, first: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i:i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    head = (MAGIC + np.array([bits], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
            + np.array([BLOCK, len(doc_ids)], "<u4").tobytes())
    base = len(head) + 8 * (len(blocks) + 1) + 16 * len(doc_ids)
    offsets = base + np.cumsum([0, *map(len, blocks)])
    return b"".join([head, offsets.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(),
                     first.astype("<u8").tobytes(), *blocks])


class Image:
    """Random access to an image: bytes, or a numpy memory map of a file that holds them."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        if bytes(self.raw[:4]) != MAGIC:
            raise ValueError("not an image of packed ids")
        self.bits = int(np.frombuffer(self.raw[4:8], "<u4")[0])
        self.n = int(np.frombuffer(self.raw[8:16], "<u8")[0])
        self.block, docs = map(int, np.frombuffer(self.raw[16:24], "<u4"))
        blocks = -(-self.n // self.block)
        at = 24 + 8 * (blocks + 1)
        self.offsets = np.frombuffer(self.raw[24:at], "<u8")
        self.doc_ids = np.frombuffer(self.raw[at:at + 8 * docs], "<i8")
        self.first = np.append(np.frombuffer(self.raw[at + 8 * docs:at + 16 * docs], "<u8"), np.uint64(self.n)).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi - 1; only the bytes that hold them are unpacked (eight ids fill whole bytes)."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        got, skip = [], lo % self.block % 8
        for i in range(lo // self.block, (hi - 1) // self.block + 1):
            base, at = i * self.block, int(self.offsets[i])
            x, y = max(lo - base, 0) // 8 * 8, min(hi - base, self.block)
            got.append(unpack(self.raw[at + x * self.bits // 8:at - (-y * self.bits // 8)], self.bits, y - x))
        return np.concatenate(got)[skip:]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


# ------------------------------------------------------------------ encoding

def token_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of pre-tokens, one after the other in an array that grows, and each known piece's number."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.edge = np.zeros(1 << 14, dtype=np.int64)      # piece i: flat[edge[i]:edge[i + 1]]

    def __len__(self) -> int:
        return len(self.known)

    def add(self, pieces: list[bytes], ids: list[list[int]]) -> None:
        self.add_all(pieces, np.array([i for x in ids for i in x], dtype=np.int32),
                     np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))

    def add_all(self, pieces: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        """``flat``: the ids of all pieces one after the other, ``size`` of each."""
        n = len(self.known)
        while n + len(size) + 1 > len(self.edge):
            self.edge = np.concatenate([self.edge, np.zeros_like(self.edge)])
        edge = self.edge[n] + np.cumsum(size)
        while len(size) and edge[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if len(size):
            self.flat[self.edge[n]:edge[-1]] = flat
            self.edge[n + 1:n + 1 + len(size)] = edge
            self.known.update(zip(pieces, range(n, n + len(size))))

    def used(self) -> int:
        return int(self.edge[len(self.known)])

    def keep(self, which: np.ndarray) -> None:
        """Forget all pieces but those with these numbers; they are numbered anew, in this order."""
        names, size = list(self.known), np.diff(self.edge)[which]
        flat, _ = spread(self.flat, self.edge[which], size)
        self.clear()
        self.add_all([names[i] for i in which.tolist()], flat, size)


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin[i]:begin[i] + size[i]] one after the other, and where each begins."""
    cuts = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], size)], cuts


class LibraryEncoder:
    """The ids that ``tokenizers`` gives, each distinct pre-token encoded by it once (a bounded cache)."""

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocabulary = self.tok.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        from tokenizers.pre_tokenizers import ByteLevel

        letters = sorted(ByteLevel.alphabet())              # the byte-level alphabet: printable Latin-1 stands for itself
        own = [c for c in letters if ord(c) < 256]
        self.letter = {ord(c): c for c in own} | dict(zip((b for b in range(256) if chr(b) not in own),
                                                          (c for c in letters if ord(c) > 255)))
        self.pieces, self.cache = Pieces(), cache
        self.uses = np.zeros(0, dtype=np.int64)             # of each piece: in how many slices it stood, halved when others go

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def learn(self, new: list[bytes]) -> None:
        """Encode unknown pieces by the library's model, which takes one pre-token at a time."""
        tokenize, letter = self.tok.model.tokenize, self.letter
        self.pieces.add(new, [[t.id for t in tokenize(w.decode("latin-1").translate(letter))] for w in new])

    def forget(self) -> None:
        """Make room: the more used half of the cache stays, within half of the ids."""
        order = np.argsort(-self.uses[:len(self.pieces)], kind="stable")[:self.cache // 2]
        which = np.sort(order[np.cumsum(np.diff(self.pieces.edge)[order]) <= CACHE_IDS // 2])
        self.pieces.keep(which)
        self.uses = self.uses[which] // 2

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the end)."""
        odd = [i for i, t in enumerate(docs) if any(s in t for s in self.special)]
        if odd:                                             # texts that spell a special token: as they are
            plain = list(docs)
            for i in odd:
                plain[i] = ""
            ids, cuts = self.encode(plain)
            rows = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            for i in odd:
                rows[i] = np.array(self.whole(docs[i]), dtype=np.int32)
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        raw, offset, cuts = pretokens.split(docs)
        words, index = pretokens.distinct(raw, offset)
        if len(self.pieces) > self.cache or self.pieces.used() > CACHE_IDS:
            self.forget()
        number = np.fromiter(map(self.pieces.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            self.learn([words[i] for i in new.tolist()])
        if len(self.uses) < len(self.pieces):
            self.uses = np.concatenate([self.uses, np.zeros(len(self.pieces.edge) - len(self.uses), dtype=np.int64)])
        self.uses[number] += 1
        place = number[index]
        begin = self.pieces.edge[place]
        ids, where = spread(self.pieces.flat, begin, self.pieces.edge[place + 1] - begin)
        return ids, where[cuts]


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------------ Spark

IMAGES = "part int, part_start long, n_ids long, image binary"


def write_images(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
                 image_ids: int = IMAGE_IDS) -> str:
    """Encode, pack and write; returns the folder of the image table. ``tokenizer`` is looked up on the
    executors, as their installation may lie elsewhere."""
    spark = docs.sparkSession

    def run(batches):
        enc = encoder(token_file(tokenizer))
        bits = bits_for(enc.vocabulary)
        part, start, ids, names, first, n = None, 0, [], [], [], 0

        def close():
            nonlocal start, ids, names, first, n
            row = pd.DataFrame({"part": [part], "part_start": [start], "n_ids": [n], "image": [
                build_image(np.concatenate(ids), np.array(names, dtype=np.int64), np.array(first, dtype=np.int64), bits)]})
            start += n
            ids, names, first, n = [], [], [], 0
            return row

        for pdf in batches:
            docs_, parts, keys = pdf["text"].tolist(), pdf["part"].to_numpy(), pdf["key"].to_numpy()
            for lo, hi in slices([len(t) for t in docs_], CHUNK):
                got, cuts = enc.encode(docs_[lo:hi])
                for i in range(hi - lo):
                    if parts[lo + i] != part:
                        if n:
                            yield close()
                        part, start = parts[lo + i], 0
                    names.append(keys[lo + i])
                    first.append(n)
                    ids += [got[cuts[i]:cuts[i + 1]], np.array([end_id], dtype=np.int32)]
                    n += int(cuts[i + 1] - cuts[i]) + 1
                    if n >= image_ids:
                        yield close()
        if n:
            yield close()

    rows = texts(docs)
    rows = (with_part(rows, id_bounds(rows, 4 * shuffle_partitions(spark)))
            .withColumn("key", F.coalesce("doc_id", F.lit(MIN_LONG))).select("part", "key", "text"))
    path = fresh_dir(spark, "token_images")
    (rows.repartition("part").sortWithinPartitions("part", "key", "text")
     .mapInPandas(run, IMAGES).write.parquet(path))
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the images under ``path``."""
    images = spark.read.schema(IMAGES).parquet(path)
    size = {r["part"]: r["n"] for r in images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(size):
        base[part] = before
        before += size[part]

    def run(batches):
        for pdf in batches:
            for part, start, raw in zip(pdf["part"], pdf["part_start"], pdf["image"]):
                image = Image(raw)
                crc = [zlib.crc32(image.document(i).astype("<u4").tobytes()) for i in range(len(image.doc_ids))]
                frame = pd.DataFrame({"doc_id": pd.array(image.doc_ids, dtype="Int64"),
                                      "start": base[part] + start + image.first[:-1],
                                      "n_tokens": np.diff(image.first), "ids_crc32": crc})
                frame.loc[image.doc_ids == MIN_LONG, "doc_id"] = pd.NA
                yield frame

    return images.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
