"""Operators against brute force, exact round trips and held-out accuracy; edge rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from opsloss.llm import chat, decontaminate, fingerprints, lexicon, licenses, linededup, pretokens, quality, queries
from opsloss.llm import simhash, tokenfile, toxicity
from opsloss.llm.components import components
from tests.llm.conftest import EDGE, SMALL, documents

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.token_file())


@pytest.mark.parametrize("module, label, mod, held, found, alarms",
                         [(quality, "quality", 4, 2, 0.95, 0.05), (toxicity, "toxic", 5, 0, 0.9, 0.02)])
def test_classifiers(spark, module, label, mod, held, found, alarms):
    """Of the held-out rows, the share of label 1 found and of label 0 taken for it; a constant answer fails one of them."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    known = [(r.doc_id, r[label]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % mod == held]
    assert all(out[d].held_out for d, _ in known) and len(out) == docs.count()
    assert np.mean([out[d].predicted for d, y in known if y == 1]) >= found
    assert np.mean([out[d].predicted for d, y in known if y == 0]) <= alarms
    edge = module.classify(documents(spark), labels.limit(0)).collect()
    assert len(edge) == len(EDGE) and all(r.score == 0.5 for r in edge)
    assert module.classify(documents(spark, []), labels).count() == 0
    one = spark.createDataFrame([(d, 1, 1) for d in range(20)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in module.classify(documents(spark), one).collect()} == {1}


def test_toxic_passage_at_every_offset(spark):
    rng = random.Random(2)
    calm = [f"calm{i}" for i in range(60)]
    bad = "you utter fool and hopeless liar".split()
    docs, y = [], []
    for i in range(200):
        words = rng.choices(calm, k=rng.randrange(40, 200))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = bad
        docs.append(" ".join(words))
        y.append(int(i % 4 == 0))
    model = toxicity.train(docs, np.array(y), [150, 50])
    for size in (100, 129, 1000):
        texts = [" ".join([*(w := rng.choices(calm, k=size))[:at], *bad, *w[at:]]) for at in range(0, size + 1, 1 if size < 200 else 7)]
        assert (toxicity.score_texts(texts, *model) >= 0.5).all()
        assert (toxicity.score_texts([" ".join(rng.choices(calm, k=size)) for _ in range(50)], *model) < 0.5).all()


def test_classifier_sample_is_cut_before_texts_are_fetched(spark):
    from opsloss.llm.common import labelled_sample

    rows = [(i, chr(97 + i % 26) * (10 + i)) for i in range(40)] + [(3, "other text, same id"), (None, "x"), (7, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (2, 5)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    x, y, counts = labelled_sample(docs, labels, "quality", 4, 2)
    learn = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert counts == [sum(i % 2 == 0 for i in learn), sum(i % 2 for i in learn)] and len(x) == len(learn)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {min((t or "" for d, t in rows if d == i), key=md5) for i in learn}
    assert set(x) == want
    small, _, _ = labelled_sample(docs, labels, "quality", 4, 2, size=120)
    assert 0 < sum(map(len, small)) <= 120 and set(small) <= want


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 10, "open", "user", None), (1, 1, 10, "delta", None, "he"), (1, 2, 10, "delta", None, "llo"),
           (1, 3, 11, "open", "assistant", None), (1, 4, 11, "delta", None, "bad"), (1, 5, 12, "open", "user", None),
           (1, 6, 12, "delta", None, "why"), (1, 7, 11, "regenerate", None, None), (1, 9, 11, "delta", None, "d"),
           (1, 8, 11, "delta", None, "goo"), (1, 10, 10, "edit", None, "bye"), (1, 11, 10, "delta", None, "!"),
           (1, 12, 13, "open", "user", None), (1, 13, 14, "open", "user", None), (1, 14, 14, "drop", None, None)]
    got = chat.reconstruct(spark.createDataFrame(log, chat.LOG)).orderBy("place").collect()
    assert [(r.place, r.role, r.text) for r in got] == [(0, "user", "bye!"), (3, "assistant", "good"), (12, "user", "")]


def fold(log):
    """One event after another: what is left of each conversation, as (place, role, text)."""
    out, place = {}, {}
    for c, q, m, kind, role, text in log:
        if kind == "open":
            place[c, m] = min(q, place.get((c, m), q))
    order = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3, "drop": 4}
    events = [e for e in log if e[3] in order]
    for c, q, m, *_ in events:
        if not any(e[3] == "open" and e[0] == c and e[2] == m for e in events):
            place[c, m] = min(e[1] for e in events if e[0] == c and e[2] == m)
    roles = {}
    for c, q, m, kind, role, text in sorted(events, key=lambda e: (e[1], e[4] or "")):
        if kind == "open" and q == place[c, m]:
            roles.setdefault((c, m), role or "")
    gone, texts = set(), {k: "" for k in place}
    for c, q, m, kind, role, text in sorted(events, key=lambda e: (e[1], order[e[3]], place[e[0], e[2]], e[5] or "")):
        if (c, m) in gone:
            continue
        if kind == "delta":
            texts[c, m] += text or ""
        elif kind == "edit":
            texts[c, m] = text or ""
        elif kind == "regenerate":
            texts[c, m] = ""
            gone |= {k for k in place if k[0] == c and place[c, m] < place[k] < q}
        elif kind == "drop":
            gone.add((c, m))
    return sorted((str(k[0]), place[k], roles.get(k, ""), texts[k]) for k in place if k not in gone)


def test_chat_fold_in_order(spark):
    """What the reviews asked for: a dropped message keeps what its regeneration took back; one that is gone takes nothing."""
    log = [(1, 0, 1, "open", "user", None), (1, 1, 2, "open", "assistant", None), (1, 2, 1, "regenerate", None, None), (1, 3, 1, "drop", None, None),
           (2, 0, 1, "open", "user", None), (2, 1, 2, "open", "assistant", None), (2, 2, 1, "regenerate", None, None),
           (2, 3, 3, "open", "user", None), (2, 4, 2, "regenerate", None, None), (2, 5, 3, "delta", None, "stays")]
    got = sorted((str(r.conv_id), r.place, r.role, r.text) for r in chat.reconstruct(spark.createDataFrame(log, chat.LOG)).collect())
    assert got == fold(log) == [("2", 0, "user", ""), ("2", 3, "user", "stays")]


def test_chat_fold_of_random_logs(spark):
    rng, log = random.Random(9), []
    for c in [None, *range(120)]:
        n = rng.randrange(1, 8)
        seqs = rng.sample(range(400), 40)
        opened = sorted(rng.sample(seqs, n))
        for m, q in enumerate(opened):
            if rng.random() < 0.95:
                log.append((c, q, m, "open", rng.choice(["user", "assistant", None]), "ignored"))
        for q in seqs:
            if q not in opened and (on := [m for m, o in enumerate(opened) if o < q]):
                kind = rng.choices(["delta", "edit", "regenerate", "drop", None, "noise"], [12, 3, 4, 1, 1, 1])[0]
                log.append((c, q, rng.choice(on), kind, None, rng.choice(["a", "bc", "", None])))
    rng.shuffle(log)
    got = sorted((str(r.conv_id), r.place, r.role, r.text) for r in
                 chat.reconstruct(spark.createDataFrame(log, chat.LOG).repartition(5)).collect())
    assert got == fold(log) and len(got) > 150


def test_chat_replay_has_all_kinds_and_leads_to_the_table(spark):
    rows = [(i % 40, i // 40, ("user", "assistant")[i // 40 % 2], "word " * (i * 7 % 300)) for i in range(400)]
    rows += [(None, None, None, None)] * 30 + [(7, None, "user", None)] * 5
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, seq int, message string")
    log = chat.replay(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate", "drop"}
    got = sorted(((r.conv_id, r.place // chat.STRIDE, r.role, r.text) for r in chat.reconstruct(log).collect()), key=str)
    assert got == sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows), key=str)


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", control), (-1, 1, "assistant", control), (None, None, None, None),
            (2, 0, "assistant", "~0~1<~2[ é"), (2, 0, "assistant", "~0~1<~2[ é"), (2, 1, "~<[ROLE]", "x" * 1000 + "</s>"),
            *[(3, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(200)], (4, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(out) == set(by)
    for c, v in by.items():
        v.sort()
        loss = "".join(x for _, r, x in v if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(v), sha("".join(f"{r}\n{x}\n" for _, r, x in v)))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_fingerprints(spark, docs, rows):
    order = sorted(rows, key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    for i, r in enumerate(order):
        n, after = len(r.text), order[(i + 1) % len(order)].text
        assert out[r.doc_id].edited_sha256 == sha(r.text[:n - n // 3] + after[:n // 3]) and out[r.doc_id].n_chars == n
    assert np.mean([r.near_edited > r.near_next for r in out.values()]) > 0.9
    whole, moved = fingerprints.fingerprint("a b\nc\nd"), fingerprints.fingerprint("d\na b\nc")
    assert fingerprints.encode(whole) == fingerprints.encode(moved) and fingerprints.likeness(whole, moved) == 1
    without = fingerprints.subtract(whole, fingerprints.fingerprint("c"))
    assert fingerprints.encode(without) == fingerprints.encode(fingerprints.fingerprint("a b\nd"))
    assert fingerprints.compare_edited(documents(spark)).count() == len(EDGE)
    assert fingerprints.compare_edited(documents(spark, [])).count() == 0
    assert fingerprints.compare_edited(documents(spark, EDGE[3:4])).first().near_next == 1


def test_fingerprints_of_long_repetitive_texts():
    """No lane wraps: a group repeated 70,000 times, against 90 % of it, a half and other groups."""
    of = lambda n, g="one two three four ": fingerprints.fingerprint(g * n)
    whole = of(70_000)
    for n in (63_000, 35_000, 7_000):
        a, b = 70_000.0, float(n)
        want = 1 - (a - b) ** 2 / (a * a + b * b)
        assert abs(fingerprints.likeness(whole, of(n)) - want) < 1e-9
    assert fingerprints.likeness(whole, of(70_000, "five six seven eight ")) < 0.4
    assert fingerprints.likeness(fingerprints.decode(fingerprints.encode(whole)), whole) == 1
    # a lane sum against one counted group by group
    few = of(3)
    assert (few[1].view(np.int32) == 3 * of(1)[1].view(np.int32)).all()


def test_line_dedup(spark, docs, rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for r in rows:
        for x in r.text.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(r.doc_id)
    want = {}
    for r in rows:
        lines = r.text.split("\n")
        stay = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)]) == r.doc_id]
        want[r.doc_id] = (len(lines), len(lines) - len(stay), sha("\n".join(stay)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digest(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0
    assert linededup.digest(documents(spark)).count() == len(EDGE)
    assert linededup.clean(documents(spark)).columns == ["doc_id", "text", "score", "fp"]
    assert linededup.digest(documents(spark, [])).count() == 0


def test_line_dedup_is_reversible(spark, docs):
    half = docs.filter("doc_id % 2 = 0")
    rest = docs.filter("doc_id % 2 = 1")
    state = linededup.holdings(half)
    both = linededup.insert(state, rest)
    back = linededup.delete(both, rest.select("doc_id"))
    as_set = lambda df: {tuple(r) for r in df.select("k1", "k2", "doc_id").collect()}
    assert as_set(back) == as_set(state) and as_set(both) == as_set(linededup.holdings(docs))
    often = lambda s: linededup.repeated(linededup.references(s)).select("k1", "k2")
    grown = linededup.update_filters(linededup.build_filters(often(state), 2), often(both).exceptAll(often(state)),
                                     often(state).limit(0), 2, often(both))
    shrunk = linededup.update_filters(grown, often(state).limit(0), often(both).exceptAll(often(state)), 2, often(state))
    for filters, s in ((grown, both), (shrunk, state)):
        want = as_set(s.join(often(s), ["k1", "k2"]))
        for salts in (1, 7):
            got = as_set(linededup.probe(s, filters, 2, salts))
            assert want <= got <= as_set(s)


def test_line_filters_grow(spark):
    """3,000 keys into filters built for 100: built anew, larger, with nothing left in the stash."""
    rng = np.random.default_rng(4)
    keys = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(-2**63, 2**63 - 1, (3100, 2))], "k1 long, k2 long")
    first, later = keys.limit(100), keys.exceptAll(keys.limit(100))
    filters = linededup.update_filters(linededup.build_filters(first, 3), later, later.limit(0), 3, keys)
    made = {r.shard: linededup.Cuckoo.from_bytes(bytes(r.filter)) for r in filters.collect()}
    assert set(made) == {0, 1, 2} and all(not f.stash and f.held() <= f.room() for f in made.values())
    where = keys.select("k1", linededup._shard(3).alias("shard")).collect()
    assert all(r.k1 in made[r.shard] for r in where)
    assert linededup.reshard(1, 60_000) == 1 and linededup.reshard(1, 500_000) == 10 and linededup.reshard(10, 100) == 1
    assert linededup.salts_for(10, 1) == 1 and linededup.salts_for(10**9, 100) == 100


def test_columns_of_any_name_pass_through(spark):
    """Names that the stages use inside, for the steps that keep all columns."""
    names = ["__lost", "__id", "__key", "__lines", "__keep", "__nth", "__digest", "lines", "lost", "row", "keep", "nth", "digest", "a.b"]
    line = "a line of text that repeats in documents"
    rows = [(i, f"{line}\nown {i} " + "word " * i, *range(len(names))) for i in range(8)] + [(3, line, *range(len(names))), (None, None, *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for step in (linededup.clean, simhash.keep):
        out = step(df)
        assert out.columns == df.columns
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())
    assert linededup.clean(df).count() == len(rows)


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    f = linededup.Cuckoo(len(keys))
    f.insert(keys)
    f = linededup.Cuckoo.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    full = linededup.Cuckoo(4)
    full.insert(keys[:100])
    assert full.contains(keys[:100]).all() and full.stash


def test_token_images(spark, docs, rows):
    tok, at = library(), 0
    more = [(10**6 + 2, "a<|endoftext|>b  \n"), (10**6, None), (10**6 + 2, " x"), (10**6 + 1, "it's 'quoted'\n\n\n 漢字")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = []
    for d, t in sorted([(r.doc_id, r.text) for r in rows] + [(d, t or "") for d, t in more]):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    for size in (tokenfile.IMAGE_IDS, 50):
        got = tokenfile.read_documents(spark, tokenfile.write_images(df, image_ids=size)).collect()
        assert sorted(map(tuple, got)) == want
    assert tokenfile.read_documents(spark, tokenfile.write_images(documents(spark, []))).count() == 0
    assert tokenfile.read_documents(spark, tokenfile.write_images(documents(spark))).count() == len(EDGE)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_bit_packing(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 70_001, dtype=np.uint64).astype(np.uint32)
    (tmp_path / "x").write_bytes(tokenfile.build_image(ids, np.array([5, 6]), np.array([0, 66_000]), bits))
    image = tokenfile.Image(np.memmap(tmp_path / "x", dtype=np.uint8, mode="r"))
    assert (image.document(1) == ids[66_000:]).all() and (image.ids(10, 65_999) == ids[10:65_999]).all()


@pytest.mark.parametrize("bits", [3, 11, 16])
def test_a_range_of_ids_unpacks_its_own_bytes(bits, monkeypatch):
    unpacked, unpack = [], tokenfile.unpack
    monkeypatch.setattr(tokenfile, "unpack", lambda raw, bits, n: unpacked.append(n) or unpack(raw, bits, n))
    ids = np.random.default_rng(bits).integers(0, 2**bits, 2 * tokenfile.BLOCK + 77, dtype=np.uint64).astype(np.uint32)
    image = tokenfile.Image(tokenfile.build_image(ids, np.array([1]), np.array([0]), bits))
    for edge in (0, 9, 1000, tokenfile.BLOCK, 2 * tokenfile.BLOCK, len(ids)):
        for lo in range(max(0, edge - 10), min(len(ids), edge + 10)):
            for n in (0, 1, 7, 8, 30):
                unpacked.clear()
                hi = min(lo + n, len(ids))
                assert (image.ids(lo, hi) == ids[lo:hi]).all() and sum(unpacked) <= hi - lo + 8
    assert (image.ids(5, len(ids)) == ids[5:]).all()


def test_token_cache_keeps_what_is_used(monkeypatch):
    tok, enc, learned = library(), tokenfile.LibraryEncoder(tokenfile.token_file(), cache=20), collections.Counter()
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda new: learned.update(new) or learn(new))
    rare = ["".join(chr(97 + int(c)) for c in f"{i:03}" * 3) for i in range(500)]
    for i in range(0, len(rare), 5):
        texts = ["the cat sat on the mat", "", " " + " ".join(rare[i:i + 5]), "the cat"]
        ids, cuts = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.pieces) <= 20 + 11
    assert len(learned) == 506 and set(learned.values()) == {1}
    monkeypatch.setattr(tokenfile, "CACHE_IDS", 200)
    for i in range(30):
        texts = ["the cat", rare[i] * 20, rare[i]]
        ids, cuts = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert enc.pieces.used() <= 200 + len(ids)


def test_simhash(spark, docs, rows):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {r.doc_id: brute(r.text) for r in rows}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], dtype=np.uint64)
    for radius, cell in ((4, simhash.CELL), (4, 3), (12, 10)):
        parent = list(range(len(ids)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, radius=radius, cell=cell).collect()}
        assert got == {d: (f"{fp[d]:016x}", ids[find(i)]) for i, d in enumerate(ids)}
    assert simhash.near_duplicates(documents(spark)).count() == len(EDGE)
    assert simhash.keep(documents(spark)).columns == ["doc_id", "text", "score", "fp"]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_pretokens_match_the_pattern(monkeypatch):
    import public_tokenizers
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    parts = list("ab's tredlvm  \n\t1 2'é漢٣  ½😀_-") + ["'s", "'re", "'ll ", " '", "  ", "\r\n", "'d"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    raw, offset, cuts = pretokens.split(texts)
    for k, t in enumerate(texts):
        assert [raw[offset[i]:offset[i + 1]].decode() for i in range(cuts[k], cuts[k + 1])] == pattern.findall(t)
    words, index = pretokens.distinct(raw, offset)
    assert [words[i] for i in index] == [raw[a:b] for a, b in zip(offset, offset[1:])] and len(set(words)) == len(words)
    with monkeypatch.context() as m:                        # pieces that share a hash are told apart
        m.setattr(pretokens.pd, "factorize", lambda h: (np.zeros(len(h), dtype=np.int64), h[:1]))
        words, index = pretokens.distinct(raw, offset)
    assert [words[i] for i in index] == [raw[a:b] for a, b in zip(offset, offset[1:])] and len(set(words)) == len(words)


def test_bpe_round_trip(spark, docs, rows):
    tok = library()
    more = [(10**6, "a<|endoftext|>b  \n"), (10**6 + 1, None), (10**6 + 2, "it's 'quoted'\n\n 漢字 😀"), (10**6 + 2, "<|endoftext|>")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = []
    for d, t in [(r.doc_id, r.text) for r in rows] + [(d, t or "") for d, t in more]:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    for size in (lexicon.LEXICON, 20):
        assert sorted(map(tuple, lexicon.round_trip(df, size=size).collect())) == sorted(want)
    got = {(r.doc_id, r.text) for r in lexicon.decode(lexicon.encode(df)).collect()}
    assert got == {(r.doc_id, r.text or "") for r in df.collect()}
    assert lexicon.round_trip(documents(spark)).count() == len(EDGE)
    assert lexicon.round_trip(documents(spark, []), with_ids=True).count() == 0


def test_bpe_long_words(spark):
    """Texts without blanks: one pre-token of a third of a million bytes, and words around the bound."""
    tok, rng = library(), random.Random(3)
    v = lexicon.vocabulary("byte_bpe_50k.json")
    for n in [*range(lexicon.WORD - 2, lexicon.WORD + 3), 300, 5000]:
        for alphabet in ("ab", "etaoinshrdlu", "é漢字ßx"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert v.merge(word.encode()) == v._merge_long([v.letters[b] for b in word.encode()]) or n > 1000
            assert v.merge(word.encode()) == tok.encode(word, add_special_tokens=False).ids
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.ids_sha256 for r in lexicon.round_trip(df).collect()}
    assert got == {i: sha(",".join(map(str, tok.encode(t, add_special_tokens=False).ids))) for i, t in
                   [(1, long), (2, long), (3, "x" * 100_000)]}


def test_words_merged_together_as_one_by_one():
    v, rng = lexicon.vocabulary("byte_bpe_50k.json"), random.Random(1)
    words = [bytes(rng.choice(b"aaaabbe nt\xc3\xa9 ") for _ in range(rng.randrange(1, 70))) for _ in range(1500)]
    words += [b"a" * n for n in range(1, 80)] + [rng.choice([b"international", b" the", b"\xff\xfe", b"aaaaaa"]) * rng.randrange(1, 6) for _ in range(300)]
    ids, size = v.merge_all(words)
    ends = np.cumsum(size)
    assert all(ids[e - n:e].tolist() == v.merge(w) for w, n, e in zip(words, size, ends)) and ends[-1] == len(ids)
    assert [len(x) for x in v.merge_all([])] == [0, 0]


def test_transducer_shares_suffixes():
    words = [w.encode() for w in ("tap", "taps", "top", "tops", "t", "stop", "stops", "é")]
    t = lexicon.Transducer.compile({w: [i, i + 1] for i, w in enumerate(words)})
    assert [sorted(words)[i] for i in t.find(words)] == words
    assert (t.find([b"", b"to", b"tapss", b"zz"]) == -1).all() and len(t.final) == 8


def test_decontamination(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, decontaminate.shingles(r.text)) for r in bench.collect()]
    want = sorted((r.doc_id, i, len(s & have), len(s)) for r in docs.collect() for have in [decontaminate.shingles(r.text)]
                  for i, s in items if s and len(s & have) >= 0.8 * len(s))
    for size in (decontaminate.ITEMS, 7):
        got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.search(docs, bench, items=size).collect())
        assert got == want and want
    assert decontaminate.keep(docs, bench).count() == docs.count() - len({w[0] for w in want})
    odd = spark.createDataFrame([(1, None), (2, "too short"), (3, "same words here again same words here again")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(documents(spark), odd).collect()} == {(9, 3)}
    one = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i} v{i}") for i in range(300)], "item_id long, text string")
    held = spark.createDataFrame([(i, f"a b c d e f {t} g h i j k l m n o") for i, t in one.collect()], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.search(held, one).collect()) == [(i, i) for i in range(300)]
    assert decontaminate.search(documents(spark, []), bench).count() == 0
    assert decontaminate.search(documents(spark), bench.limit(0)).count() == 0


def test_licenses(spark):
    t = dict(licenses.TEMPLATES)
    rows = [(1, f"word {t['MIT-grant']} end", "x", 1), (2, "# " + t["GPL-3.0"].upper(), "x", 1), (3, "nothing of the kind " * 9, "x", 1),
            (4, t["MIT"] + "\n" + t["MIT"], "x", 1), *EDGE]
    got = {(r.doc_id, r.license_id) for r in licenses.scan(documents(spark, rows), licenses.templates(spark)).collect()}
    assert got == {(1, "MIT-grant"), (2, "GPL-3.0"), (4, "MIT")}
    assert licenses.scan(documents(spark, []), licenses.templates(spark)).count() == 0
    assert licenses.scan(documents(spark), licenses.templates(spark).limit(0)).count() == 0


def test_simhash_keeps_rows_not_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (3, c), (None, a), (None, d), (None, d), (4, None), (5, "")]
    fps = {t: simhash.fingerprint(t or "") for _, t in rows}
    assert min((fps[x] ^ fps[y]).bit_count() for x in (a, b, c, d, "") for y in (a, b, c, d, "") if x != y) > simhash.RADIUS
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep(df).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, d), (4, None)], key=str)


def brute_licenses(rows, found):
    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    held, out = [(license_id, shingles(text)) for license_id, text in found], {}
    for doc_id, text in rows:
        have = shingles(text)
        for license_id, t in held:
            if t and 10 * len(t & have) >= 8 * len(t):
                new = (len(t & have) / len(t), len(t & have), len(t))
                out[doc_id, license_id] = max(out.get((doc_id, license_id), new), new)
    return {(*k, *v) for k, v in out.items()}


def scanned_licenses(docs, found):
    return {(r.doc_id, r.license_id, r.containment, r.n_shared, r.n_shingles) for r in licenses.scan(docs, found).collect()}


def test_licenses_with_edits_anywhere(spark, docs, rows):
    t = dict(licenses.TEMPLATES)
    word = re.findall(r"\S+", t["Apache-2.0-header"])
    texts = [(i, " ".join([*word[:i], "changed", *word[i + 1:]])) for i in range(len(word))]
    rng = random.Random(3)
    for i in range(200):
        a, b = rng.sample(range(len(word)), 2)
        texts.append((1000 + i, " ".join("changed" if j in (a, b) else w for j, w in enumerate(word))))
    far = " ".join(f"word{i}" for i in range(300))
    grant = t["MIT-grant"].split()
    texts += [(2000, " ".join([*grant[:20], far, *grant[20:45], far, *grant[45:]])), (2001, None), (None, t["GPL-3.0"]),
              (2002, t["MIT"]), (2002, t["MIT"]), (2002, t["MPL-2.0-header"]), (2002, t["MPL-2.0-header"][:200])]
    want = brute_licenses(texts, licenses.TEMPLATES)
    assert {k[:2] for k in want} >= {(i, "Apache-2.0-header") for i in (*range(60, 75), 2)} | {(2000, "MIT-grant")}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert scanned_licenses(df, licenses.templates(spark)) == want
    want = brute_licenses([(r.doc_id, r.text) for r in rows], licenses.TEMPLATES)
    assert want and scanned_licenses(docs, licenses.templates(spark)) == want


def test_licenses_long_lists_and_variants(spark):
    """A list cut into sets, two variants under one license_id, and each known license in its own text."""
    variants = [("two", "the first wording of this license has a number of words here"),
                ("two", "another text altogether that says the same thing in its way"), *licenses.TEMPLATES]
    rows = [(1, "x " + variants[0][1]), (2, variants[1][1] + " x"), (3, None),
            *[(10 + i, text) for i, (_, text) in enumerate(licenses.TEMPLATES)]]
    want = brute_licenses(rows, variants)
    assert {(1, "two"), (2, "two")} | {(10 + i, name) for i, (name, _) in enumerate(licenses.TEMPLATES)} <= {k[:2] for k in want}
    df, found = (spark.createDataFrame(x, s) for x, s in ((rows, "doc_id long, text string"), (variants, "license_id string, text string")))
    for size in (licenses.MAX_TEMPLATES, 5):
        got = {(r.doc_id, r.license_id, r.containment, r.n_shared, r.n_shingles) for r in licenses.scan(df, found, size).collect()}
        assert got == want


def test_license_recall_on_edited_texts(spark):
    """Random words replaced, inserted and taken out inside long documents: what is contained to 0.8 is found."""
    rng, texts = random.Random(11), []
    long = [(n, t) for n, t in licenses.TEMPLATES if 40 < len(t.split()) < 1500]
    for i in range(240):
        _, text = rng.choice(long)
        words, out = text.split(), []
        rate = rng.uniform(0, 0.06)
        for w in words:
            x = rng.random()
            out += ["edit"] if x < rate / 3 else [w, f"more{x}"] if x < 2 * rate / 3 else [] if x < rate else [w]
        around = [f"text{rng.randrange(5000)}" for _ in range(rng.randrange(400))]
        at = rng.randrange(len(around) + 1)
        texts.append((i, " ".join([*around[:at], *out, *around[at:]])))
    want = brute_licenses(texts, licenses.TEMPLATES)
    got = scanned_licenses(spark.createDataFrame(texts, "doc_id long, text string"), licenses.templates(spark))
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_every_query_has_sql_or_a_test():
    """Queries without SQL, and the test that compares each with brute force, a round trip or held-out labels."""
    from tests.llm.test_pipeline import test_pipeline_against_plain_python

    tested = {"op1_quality_classifier": test_classifiers, "op3_document_fingerprints": test_fingerprints,
              "op5_token_output": test_token_images, "op6_simhash_near_dedup": test_simhash,
              "op7_bpe_lexicon": test_bpe_round_trip, "op8_toxicity": test_classifiers,
              "pipeline": test_pipeline_against_plain_python}
    assert set(queries.queries()) - set(queries.oracle_sql()) == set(tested)


def test_native_queries_have_no_python(spark):
    for name in ("op2_chat_formatting", "op10_license_scan"):
        plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
