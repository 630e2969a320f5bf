import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import xxhash

from opsloss.llm import decontaminate, linededup, simhash, tokenfile
from tests.llm.conftest import SMALL, documents

low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
WORD = r"[^\x20\x09-\x0D]+"


def without_repeated_lines(docs):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    return {d: "\n".join(x for x in t.split("\n") if len(held[key(x)]) < 3 or max(held[key(x)]) == d) for d, t in docs.items()}


def bits_of(text):
    w = re.findall(WORD, low(text))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def one_of_each_group(docs):
    """Links by every pair, groups by walking along them; the smallest id of a group stays."""
    fp = {d: bits_of(t) for d, t in docs.items()}
    left, stay = set(docs), []
    for d in sorted(docs):
        if d not in left:
            continue
        stay.append(d)
        walk = [d]
        left.discard(d)
        while walk:
            a = walk.pop()
            near = [b for b in left if (fp[a] ^ fp[b]).bit_count() <= 4]
            left -= set(near)
            walk += near
    return {d: docs[d] for d in stay}


def without_items(docs, items):
    def shingles(t):
        w = re.findall(WORD, low(t or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    wanted = [x for x in map(shingles, items) if x]
    return {d: t for d, t in docs.items() if not any(10 * len(x & s) >= 8 * len(x) for s in [shingles(t)] for x in wanted)}


def test_pipeline_against_plain_python(spark):
    """All rows of run() from the classifier's decisions on: stages 2 to 5 once more in plain Python over the small table."""
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, table, SMALL).collect()
    docs = {r.doc_id: r.text or "" for r in kept}
    sizes = [len(docs)]
    for step in (without_repeated_lines, one_of_each_group,
                 lambda x: without_items(x, [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])):
        docs = step(docs)
        sizes.append(len(docs))
    assert sizes[0] >= sizes[2] > sizes[3] > 0           # near copies and items are there to be found
    library = Tokenizer.from_file(tokenfile.token_file())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for d, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), tuple(ids)] += 1
    out = corpus_pipeline.run(spark, SMALL)
    ids = next(c for c in out.columns if c not in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r[ids])) for r in out.collect()) == want


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert rows
    assert linededup.digest(docs).count() == docs.count()
    assert decontaminate.search(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    near = simhash.near_duplicates(docs)
    assert near.filter("doc_id <> component_id").count() == 0
    final = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_take_edge_rows_and_empty_tables(spark):
    for rows in (None, []):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, documents(spark, rows), SMALL).count()
