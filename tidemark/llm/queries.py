"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, ctw, fim, neighbours, packing, quality, simhash, substring, suffixes, vectors, warc, whiten
from tidemark.llm.common import session


#: Words that a worker of op2_packing remembers in each generation; in the pipeline its memory is shared with more, so it keeps the default.
REMEMBERED = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, remember=REMEMBERED)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_examples(turns.unionByName(own)))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.where("kept").select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_packing, op3_embedding_dedup, op4_bpe, op5_chat, op6_language_model, op7_quality, op8_neighbours,
        op9_suffixes, op10_substring, op11_warc, op12_fill_in_middle, op13_whitening,
    )
}

#: Only what plain SQL can state over whole tables; the other queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_substring": r"""
      WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
      pos AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
      first AS (SELECT win, min(doc_id) AS least FROM pos GROUP BY win),
      bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM pos JOIN first USING (win) WHERE least < doc_id),
      gone AS (SELECT doc_id, list(place) AS ats FROM bad GROUP BY doc_id),
      kept AS (SELECT doc_id, len(ws) AS n, len(coalesce(ats, [])) AS cut,
                      list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains(coalesce(ats, []), i) THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) AS k
               FROM w LEFT JOIN gone USING (doc_id))
      SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(cut AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
    """,
    "op11_warc": r"""
      WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
      f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p),
      r AS (SELECT *, payload_bytes >= 100 AND coalesce(page_id > least, least IS NOT NULL) AS again FROM f)
      SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
             CASE WHEN again THEN least END AS refers_to
      FROM r
    """,
    "op12_fill_in_middle": r"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha FROM documents),
      u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                   CAST('0x' || sha[1:8] AS BIGINT) AS h1, CAST('0x' || sha[9:16] AS BIGINT) AS h2, CAST('0x' || sha[17:24] AS BIGINT) AS h3, CAST('0x' || sha[25:32] AS BIGINT) AS h4 FROM d),
      c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
      s AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
      SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
             sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
             sha256(t) AS restored_sha256
      FROM s
    """,
}
