"""Exact dedup, phrase mining and ranked search against plain Python; edge rows, ties, clashing columns, empty tables."""

import collections
import hashlib
import math
import os
import random
import re

import pytest

from opsloss.llm import exactdedup, lexical, phrases
from opsloss.session import fresh_dir
from tests.llm.conftest import EDGE, SMALL, documents

low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
WIDE = "doc_id long, text string, lang string, score string, `count` int, digest string, `row` int, term string"


def wide(spark, rows):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(*r, "x", 1, "d", 7, "t") for r in rows], WIDE)


# ---------------------------------------------------------------- exact dedup

def dedup_brute(rows):
    """rows: (doc_id, text) -> sorted (doc_id, keep_id, group_size, sha256) and the number kept of each text."""
    by = collections.defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    key = lambda d: -(2**70) if d is None else d
    return sorted(((d, max(v, key=key), len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in by.items() for d in v),
                  key=repr), len(by)


def check_dedup(out, rows):
    got = out.collect()
    want, n_kept = dedup_brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == n_kept and all(r.doc_id == r.keep_id for r in got if r.kept)


DUPS = [(1, "a"), (2, "a"), (2, "a"), (3, None), (None, ""), (None, "only"), (4, "é漢" * 50000), (5, "é漢" * 50000),
        (6, "a "), (7, "A"), (-8, "z"), (2, "other text, same id")]


def test_exact_dedup_goes_on_from_its_state(spark):
    path, folder = fresh_dir(spark, "t_docs"), fresh_dir(spark, "t_state")
    wide(spark, [(*r, "en") for r in DUPS[:6]]).write.parquet(path)
    check_dedup(exactdedup.deduplicate(spark, path, folder), DUPS[:6])
    check_dedup(exactdedup.deduplicate(spark, path, folder), DUPS[:6])          # nothing new: the same result
    wide(spark, [(*r, "en") for r in DUPS[6:]]).write.mode("append").parquet(path)
    check_dedup(exactdedup.deduplicate(spark, path, folder, files=1), DUPS)     # several micro-batches


@pytest.mark.parametrize("width", [0, 1])
def test_exact_dedup_compares_bytes_under_equal_digests(spark, width):
    """With no byte or one byte of the digest nearly all rows hit a wrong entry; only the bytes tell them apart."""
    rng = random.Random(3)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice("abcdef") * rng.randrange(3)) for _ in range(300)]
    path = fresh_dir(spark, "t_docs")
    wide(spark, [(*r, "en") for r in rows]).repartition(5).write.parquet(path)
    check_dedup(exactdedup.deduplicate(spark, path, width=width), rows)


def test_exact_dedup_reads_a_single_file_and_an_empty_folder(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_dedup(exactdedup.deduplicate(spark, f"{SMALL}/documents.parquet"), rows)
    path = fresh_dir(spark, "t_docs")
    wide(spark, []).write.parquet(path)
    assert exactdedup.deduplicate(spark, path).count() == 0


def test_exact_dedup_has_no_python_worker(spark):
    path, folder = f"{SMALL}/documents.parquet", fresh_dir(spark, "t_state")
    out = exactdedup.deduplicate(spark, path, folder)
    plans = [out, exactdedup.compare(spark, path, exactdedup.entries(spark, folder)), exactdedup.resolve(
        spark, path, exactdedup.entries(spark, folder).select("digest"))]
    assert not any(w in p._jdf.queryExecution().toString() for p in plans for w in ("Python", "Pandas", "Arrow"))
    assert any("rocksdb" in f or f.endswith((".zip", ".changelog")) for _, _, fs in os.walk(f"{folder}/state/state") for f in fs)


def test_exact_dedup_sets_no_disk_aside_for_its_state(spark):
    """A store for each partition: with space set aside, 211 of them took 0.9 GB for 2 MB of state."""
    path, sc = fresh_dir(spark, "t_docs"), spark.sparkContext
    wide(spark, [(*r, "en") for r in DUPS]).write.parquet(path)
    exactdedup.ingest(spark, path, fresh_dir(spark, "t_state"))
    local = sc._jvm.org.apache.spark.util.Utils.getLocalDir(sc._jsc.sc().conf())
    stores = [os.lstat(f"{at}/{f}") for at, _, fs in os.walk(local) for f in fs if f.startswith("MANIFEST-")]
    assert stores and all(512 * x.st_blocks <= x.st_size + 65536 for x in stores)


# ---------------------------------------------------------------- phrase mining

def mine_brute(rows, least, top, cover=100):
    """rows: (lang, text) -> {(lang, rank, phrase, a, l, r, n, score)}"""
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, w[i:i + z]) for (lang, w), a in cand.items() for z in range(2, len(w)) for i in range(len(w) - z + 1)
            if 100 * a >= cover * f[lang, w[i:i + z]]}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                 for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items()
            for i, (s, a, p, l, r) in enumerate(sorted(v)[:top])}


def mined(out):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect()}


@pytest.mark.parametrize("cycle, least, top", [(1, 3, 2000), (3, 6, 15), (5, 2, 2000)])
def test_phrases_against_brute_force(spark, cycle, least, top):
    rng = random.Random(cycle)
    words = ["a", "B", "b", "ça", "d!", "e.f", "漢", "x;", "aa", " "]
    rows = [(rng.randrange(90), " ".join(rng.choices(words, [9, 5, 5, 3, 2, 2, 2, 1, 1, 1], k=rng.randrange(60))),
             rng.choice(["en", "de", None])) for _ in range(120)]
    rows += [(1000 + i, "one two three four five six,\tone two", "en") for i in range(9)] + [(None, None, None), (5, "", "fr"), (5, ".,;", "fr")]
    rows += rows[-12:]
    got = mined(phrases.collocations(wide(spark, rows).repartition(4), least=least, top=top, cycle=cycle))
    want = mine_brute([(r[2], r[1]) for r in rows], least, top)
    assert got == want and len(want) > 20


def test_phrases_survive_a_full_table_of_notes(spark, monkeypatch):
    """With two slots every phrase collides with another; results stay exact."""
    monkeypatch.setattr(phrases, "SLOTS", 2)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    got = mined(phrases.collocations(wide(spark, rows), least=4, cycle=2))
    assert got == mine_brute([(r[2], r[1]) for r in rows], 4, 2000)


def test_phrases_counted_by_a_collision_are_counted_for_a_whole_cycle(spark, monkeypatch):
    """With small tables many phrases are candidates early, by the notes of others; none of them may be lost later."""
    monkeypatch.setattr(phrases, "FIRST", 64)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = mined(phrases.collocations(wide(spark, rows).repartition(4), least=3, top=10**6))
    assert got == mine_brute([(r[2], r[1]) for r in rows], 3, 10**6)


def test_phrases_travel_as_arrays_by_bucket(spark):
    """A scan hands on, and the state holds, a row for each task, bucket and length at most, not one for each phrase."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(60)) + ". " + "a b " * 9, "en") for i in range(300)]
    dealt = phrases.shards(wide(spark, rows).coalesce(2), 1)
    shared = spark.sparkContext.broadcast(phrases.table(0, 2) + 1)         # every phrase is a candidate
    counted = phrases.scan(dealt, 0, shared, [1, 2, 3], 1, 4, 2)
    state = phrases.merge(None, counted, 0, 1, 2)
    tasks = counted.rdd.getNumPartitions()
    assert counted.count() <= 12 * tasks and state.count() <= 12
    n = collections.Counter()
    for _, text, _ in rows:
        for piece in text.split("."):
            w = piece.split()
            n.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    want = collections.Counter(len(p) for p, a in n.items() if a >= 2)
    assert {r.words: r.n for r in phrases.reached(state).groupBy("words").agg({"h": "count"}).toDF("words", "n").collect()} == want


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(wide(spark, [])).count() == 0
    assert phrases.collocations(wide(spark, [(1, None, None), (2, " . ", "en")])).count() == 0


# ---------------------------------------------------------------- ranked search

def search_brute(docs, items, k=20):
    term = lambda t: re.findall(lexical.PATTERN, low(t or ""))
    bags = [(d, collections.Counter(term(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(w for _, b, _ in bags for w in b)
    query = collections.defaultdict(collections.Counter)
    for i, t in items:
        query[i].update(term(t))
    out = {}
    for i, q in query.items():
        found = []
        for d, b, n in bags:
            m = 75 + 25 * n * n_docs // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m))
                    for w, c in q.items() if w in b)
            if s > 0:
                found.append((-s, -(2**63) if d is None else d))
        for r, (s, d) in enumerate(sorted(found)[:k]):
            out[i, r + 1] = (None if d == -(2**63) else d, -s)
    return out


def ranked(out):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}


@pytest.mark.parametrize("k, limit", [(20, lexical.ITEM_BYTES), (3, 200)])
def test_search_against_brute_force(spark, k, limit):
    rng = random.Random(k)
    words = "red Green blue été 漢字 7 a-b x_y the the the of of".split()
    docs = [(rng.randrange(70) if rng.random() < 0.95 else None, " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(150)]
    docs += [(300 - i, "the red copy of the copy") for i in range(60)] + [(None, None), (400, ""), (401, "-- !!"), (402, "the " * 5000)]
    docs += [(d, t) for d, t, _, _ in EDGE]
    items = [(1, "Red red GREEN copy"), (2, "the"), (3, "nothing matches zzz"), (4, None), (5, ""), (6, "été x_y 漢字"),
             (2, "of"), (None, "blue blue"), (7, "Same WORDS here copy the of red green blue")]
    out = lexical.search(wide(spark, [(*d, "en") for d in docs]).repartition(6),
                         spark.createDataFrame([(*i, 5, "y") for i in items], "item_id long, text string, `rank` int, term string"), k, limit)
    want = search_brute(docs, items, k)
    assert ranked(out) == want and len(want) >= 15


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert lexical.search(documents(spark, []), items).count() == 0
    assert lexical.search(documents(spark), items.limit(0)).count() == 0


def test_classes_keep_the_first_members_only(spark):
    rows = [(i, n, [1, 2], [1, n]) for i, n in [(9, 5), (3, 5), (None, 5), (4, 5), (8, 6)]]
    vecs = spark.createDataFrame(rows, "doc_id long, n long, terms array<int>, tfs array<long>")
    got = {tuple(r.tfs): r.members for r in lexical.classes(vecs, 5, 26, 3).collect()}
    assert got == {(1, 5): [None, 3, 4], (1, 6): [8]}
