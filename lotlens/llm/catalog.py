"""One query per operator over its whole table, and its SQL twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import bpe, chat, decontaminate, hardneg, jaccard, langid, lattice, neighbours, spelling, superminhash, tokenfile, toxicity, warc
from lotlens.llm.common import held_out, shared_folder, table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply as a preference pair against its neighbour's reply."""
    done = chat.format_preferences(chat.mismatched_replies(table(spark, sf_dir, "conversations")))
    spans = {f"{c}_spans": F.array_join(F.transform(f"{c}_spans", lambda x: F.concat_ws("-", x.start.cast("string"), x.end.cast("string"))), ",") for c in ("chosen", "rejected")}
    return done.withColumns(spans)


OP1_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM rows),
last AS (SELECT conv_id, max(i) AS last FROM numbered WHERE role = 'assistant' GROUP BY 1),
chosen AS (SELECT n.conv_id, i, role, text FROM numbered n JOIN last l ON n.conv_id = l.conv_id AND n.i <= l.last),
rejected AS (SELECT n.conv_id, i, role, text FROM numbered n JOIN last l ON n.conv_id = l.conv_id AND n.i < l.last
  UNION ALL SELECT l.conv_id, l.last, n.role, n.text FROM last l JOIN last o ON o.conv_id = xor(l.conv_id, 1) JOIN numbered n ON n.conv_id = o.conv_id AND n.i = o.last),
cut AS (SELECT l.conv_id, coalesce(min(c.i) - 1, any_value(l.last)) AS cut_at FROM last l LEFT JOIN
  (SELECT c.conv_id, c.i FROM chosen c LEFT JOIN rejected r USING (conv_id, i) WHERE r.conv_id IS NULL OR c.role <> r.role OR c.text <> r.text) c USING (conv_id) GROUP BY 1),
parts AS (SELECT 'c' AS side, * FROM chosen UNION ALL SELECT 'r', * FROM rejected),
drawn AS (SELECT p.*, cut_at, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole FROM parts p JOIN cut USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY side, conv_id, i > cut_at ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
done AS (SELECT conv_id, side, cut_at,
  coalesce(string_agg(whole, '' ORDER BY i) FILTER (WHERE i <= cut_at), '') AS prompt, coalesce(string_agg(whole, '' ORDER BY i) FILTER (WHERE i > cut_at), '') AS body,
  coalesce(string_agg((before + length(head))::BIGINT::VARCHAR || '-' || (before + length(whole) - 1)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (WHERE i > cut_at AND role = 'assistant'), '') AS spans
  FROM placed GROUP BY 1, 2, 3)
SELECT c.conv_id, CAST(c.cut_at AS INTEGER) AS prompt_turns, c.prompt, c.body AS chosen_text, c.spans AS chosen_spans, coalesce(r.body, '') AS rejected_text, coalesce(r.spans, '') AS rejected_spans,
  (c.body = '' AND coalesce(r.body, '') = '') AS tie
FROM (SELECT * FROM done WHERE side = 'c') c LEFT JOIN (SELECT * FROM done WHERE side = 'r') r USING (conv_id)
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document: how many, the smallest id and the fewest edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), "found")
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").alias("n_items"),
                        F.array_min(F.col("found.item_id")).alias("item_id"), F.array_min(F.col("found.edits")).alias("edits"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id", 4)))
    return docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), langid.identify(docs, model).alias("s")).select("doc_id", "held_out", "s.*")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.coded(F.col("text"), MULTI_RANKS).alias("c")).select("doc_id", "c.*")


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text under the lattice model and the add-one word model, learned from six sevenths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7).alias("held_out"))
    return lattice.score(docs, lattice.vocabulary(PIECES))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 85 % Jaccard similarity of 4-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def severity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 0 for clean labels, 1 for toxic ones, 2 for toxic ones of low quality."""
    labels = table(spark, sf_dir, "labels").where("toxic is not null")
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).otherwise(F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))


def op7_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxic severity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, severity_grades(spark, sf_dir))
    return docs.select("doc_id", toxicity.grade(docs, model).alias("s")).select("doc_id", "s.*")


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the files written: where they start, how many, and their crc32."""
    files = tokenfile.write(table(spark, sf_dir, "documents"), shared_folder(spark), BYTES_JSON)
    return tokenfile.read(tokenfile.index(files)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives written."""
    return warc.read(warc.write(table(spark, sf_dir, "pages"), shared_folder(spark))).drop("payload", "url")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id 100 divides."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 100 = 0"))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document under links of 85 % Jaccard similarity of 5-word shingles, and whether it is the one kept."""
    return superminhash.groups(table(spark, sf_dir, "documents"), width=5, percent=85)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of `documents` with the spelling it is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each positive of every vector whose id 50 divides; every seventh label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hardneg.mine(rows, rows.where("vec_id % 50 = 0"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


QUERIES = {f.__name__: f for f in [op1_preference_format, op2_decontaminate, op3_language_id, op4_byte_bpe, op5_lattice_score, op6_ngram_jaccard, op7_toxicity_severity,
                                  op8_token_frames, op9_warc, op10_cross_polytope, op11_superminhash, op12_spelling_variants, op13_hard_negatives]}
SQL = {"op1_preference_format": OP1_SQL, "op9_warc": OP9_SQL, "op13_hard_negatives": OP13_SQL}
