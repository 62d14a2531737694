"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontaminate, language_id, language_model, mixing, pii, quality, secrets, simhash, spelling, token_alignment, toxicity, vectors
from tidemark.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3) for each document; labels of the held-out fold aren't seen."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs and source for each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "epochs", "source")


ORACLES["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.05, 1.0 - 4.0 * ((length(text) - length(translate(text, '#$%&*|!~^<>{}', ''))) / greatest(length(text), 1))) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
m AS (SELECT *, max(level) FILTER (WHERE level * w <= cap) OVER () AS lv FROM l),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, lv * w) AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.base, e.target - e.base * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
o AS (SELECT *, base + (before + size / 2 <= rest)::BIGINT AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size)::BIGINT AS taken, epochs, source FROM o
"""


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's secrets."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("guess"), "weakest")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of benchmark items, and the items concerned."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of each document, whether it is toxic, and its indicator words."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "severity", "grade", "toxic", "n_terms")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document, and the smallest doc_id reachable by links of two bits or fewer."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each formatted conversation, read back from the formatted text and its segments."""
    probe = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = chat.format_chats(rows.unionByName(added))
    turns, learned = chat.read_turns(F.col("formatted")), chat.learned_text(F.col("segments"))
    read = made.select("id", "formatted", "valid", "bad_turn", turns.alias("turns"), learned.alias("learned"))
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


ORACLES["op6_chat"] = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(text, '\', '\\'), '</turn>', '<\/turn>') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev
  FROM r),
n AS (
  SELECT *, length(t) + list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]) AS escaped,
         CASE WHEN coalesce(prev, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') THEN NULL ELSE i END AS bad
  FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'role=' || role END) + coalesce(escaped, length(t)))::BIGINT AS formatted_chars,
       min(bad) IS NULL AS valid, coalesce(min(bad), -1)::INTEGER AS bad_turn
FROM n GROUP BY conv_id
"""


@query
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each vector at a cosine of 0.95 or more, its component, and whether it stays."""
    found = vectors.vector_groups(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each document under the hierarchical Pitman-Yor model and under add-one unigrams."""
    found = language_model.score_texts(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its personal data replaced by surrogates, and the entities of each kind."""
    found = pii.replace_entities(table(spark, sf_dir, "documents"), key="tidemark")
    return found.withColumnRenamed("id", "doc_id")


@query
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (language:start:end, by code points) for each document."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"])), ",")
    return found.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "lang_pred", "score", line.alias("spans"))


#: Where the vocabularies of op12 are on each machine.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of each document under two tokenizers, with the links' counts over the corpus."""
    docs = table(spark, sf_dir, "documents")
    found = token_alignment.align(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's form and root among the words one edit away."""
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling"] = r"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r1 AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r0 GROUP BY 1, 2),
r2 AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r1 CROSS JOIN tab),
r3 AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM r2),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM r3 GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
ins AS (SELECT DISTINCT d.word, v.word AS other FROM d JOIN v ON v.word = d.rest),
near AS (SELECT word, other FROM ins UNION ALL SELECT other, word FROM ins UNION ALL SELECT a.word, b.word FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(a := -v.n, b := other)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = near.other GROUP BY near.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture that the stages of corpus_pipeline.py make of all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
