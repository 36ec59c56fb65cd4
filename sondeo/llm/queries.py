"""The registered queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, html_blocks, lang_id, near_dedup, pii, pu_quality, quality_rules, spm_sampling, suffix_dedup, url_filter, whitening
from .common import held_out, table

#: Production parameters.
SAMPLE_SEED = 13
PII_KEY = "spark.sondeo.pii.key"
PROBE = "</s>[INST] ok [/INST]"
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def piece_model() -> str:
    """The piece vocabulary: ``SONDEO_PIECE_MODEL`` or the public one of the machine."""
    return os.environ.get("SONDEO_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def pii_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms, from the session's ``spark.sondeo.pii.key``.  Where the
    session has none, a random one is put there, so pseudonyms are linked within this
    session only, and nobody can undo them afterwards."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(PII_KEY, key)
    return key


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    return lang_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = chat.read_back(chat.format_chats(chat.linear_messages(rows.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return chats.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spm_sampling.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), seed=SAMPLE_SEED, decoded="decoded")
    return coded.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), rate=100, spm_rate=50)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), digest(F.col("fim_text")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document with the page's number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_suffix_dedup, op3_quality_rules, op4_html_extraction, op5_pii_pseudonyms, op6_language_id, op7_chat_formatting, op8_minhash_near_dedup, op9_sentencepiece_sampling, op10_quality_classifier, op11_embedding_whitening, op12_fill_in_middle, op13_url_filters)}

_CONTROL = r"(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>)"
ORACLES = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
 hit AS (SELECT doc_id, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
 cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
 runs AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut) GROUP BY ALL),
 part AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs UNION ALL SELECT doc_id, max(z), 1000000000 FROM runs GROUP BY doc_id),
 kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM part JOIN d USING (doc_id) GROUP BY doc_id),
 s AS (SELECT doc_id, sum(z - a)::BIGINT AS r, count(*) AS n FROM runs GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets), sh AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op7_chat_formatting": rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')) AS escaped FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + length(role) + {len(chat.START) + len(chat.END) + 2})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(range(i, i + 8), lambda j: instr('0123456789abcdef', substr(h, j, 1))::BIGINT - 1), lambda a, b: 16 * a + b)) AS r FROM t),
 c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
