"""Registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from opsloss.llm import chat, decontaminate, exactdedup, fingerprints, lexical, lexicon, licenses, linededup, phrases, quality
from opsloss.llm import simhash, tokenfile, toxicity
from opsloss.llm.common import read_table

CONTROL = "</s>[INST] ok [/INST]"


def op1_quality_classifier(spark, sf_dir):
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark, sf_dir):
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(table.unionByName(extra)))


def op3_document_fingerprints(spark, sf_dir):
    return fingerprints.compare_edited(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return linededup.digest(read_table(spark, sf_dir, "documents"))


def op5_token_output(spark, sf_dir):
    return tokenfile.read_documents(spark, tokenfile.write_images(read_table(spark, sf_dir, "documents")))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark, sf_dir):
    return lexicon.round_trip(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.templates(spark))


def op11_exact_dedup(spark, sf_dir):
    return exactdedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op12_phrase_mining(spark, sf_dir):
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = (op1_quality_classifier, op2_chat_formatting, op3_document_fingerprints, op4_line_dedup, op5_token_output,
           op6_simhash_near_dedup, op7_bpe_lexicon, op8_toxicity, op9_benchmark_decontamination, op10_license_scan,
           op11_exact_dedup, op12_phrase_mining, op13_lexical_search, pipeline)
    return {f.__name__: f for f in ops}


# ------------------------------------------------------------------ SQL

OP2 = f"""
WITH c AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
w AS (SELECT *, replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2') AS r,
             replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(r) + length(t) + 20) AS bigint) AS formatted_chars
FROM w GROUP BY conv_id"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(generate_series(1, len(lines))) AS i
    FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id < h.last AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id"""


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT {key}, w, unnest(generate_series(1, len(w) - 4)) AS i FROM (
      SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM {table}))"""


OP9 = f"""
WITH q AS ({_shingles("benchmark", "item_id")}), d AS ({_shingles("documents", "doc_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles"""


def _words(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT {key}, w, unnest(generate_series(1, len(w) - 4)) AS i FROM (
      SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"""


_TEMPLATES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.TEMPLATES)
OP10 = f"""
WITH templates(license_id, text) AS (VALUES {_TEMPLATES}),
t AS ({_words("templates", "license_id")}), d AS ({_words("documents", "doc_id")}),
n AS (SELECT license_id, count(*) AS n_shingles FROM t GROUP BY license_id),
m AS (SELECT doc_id, license_id, count(*) AS n_shared FROM d JOIN t USING (s) GROUP BY doc_id, license_id)
SELECT doc_id, license_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM m JOIN n USING (license_id) WHERE n_shared >= 0.8 * n_shingles"""

OP11 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP12 = f"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, cast(sum(len(w)) AS bigint) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
      SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, generate_series(1, 5) AS s(k)))
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
sub AS (
  SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT lang, w, a, z, unnest(generate_series(1, len(w) - z + 1)) AS i FROM c, generate_series(2, 4) AS s(z) WHERE z < k)
  GROUP BY ALL),
open AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM open, generate_series(1, 4) AS s(cut) WHERE cut < k),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, n, cut, h.a AS l, t.a AS r,
    cast((1000 * cast(cut.a AS hugeint) * n) // (cast(h.a AS hugeint) * t.a) AS bigint) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail
  JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""

OP13 = f"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS row FROM documents),
dt AS (
  SELECT row, term, count(*) AS tf FROM (
    SELECT row, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{lexical.PATTERN}')) AS term FROM d)
  GROUP BY row, term),
len AS (SELECT row, cast(sum(tf) AS bigint) AS n FROM dt GROUP BY row),
tot AS (SELECT count(*) AS nn, cast(sum(n) AS bigint) AS ll FROM len),
m AS (SELECT row, 75 + (25 * n * nn) // ll AS m FROM len, tot),
w AS (
  SELECT term, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS bigint) AS w
  FROM (SELECT term, count(*) AS df FROM dt GROUP BY term), tot),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{lexical.PATTERN}')) AS term
    FROM benchmark) GROUP BY item_id, term),
s AS (
  SELECT item_id, row, cast(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS bigint) AS score
  FROM q JOIN w USING (term) JOIN dt USING (term) JOIN m USING (row) GROUP BY item_id, row)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score
FROM s JOIN d USING (row) WHERE score > 0 QUALIFY rank <= 20"""


def oracle_sql():
    out = {"op2_chat_formatting": OP2, "op4_line_dedup": OP4, "op9_benchmark_decontamination": OP9, "op10_license_scan": OP10,
           "op11_exact_dedup": OP11, "op12_phrase_mining": OP12, "op13_lexical_search": OP13}
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
