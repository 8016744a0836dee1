"""The operators applied to their whole tables, and the same in SQL where SQL can say it."""

from pyspark.sql import functions as F

from pagetrove.llm import (chat, exact_dedup, fingerprints, licenses, mixing, neighbours, periods, pitman_yor, quality, repeats,
                           segmentation, simhash, spelling)

QUERIES = {}
ORACLES = {}


def _query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@_query("op1_chat_windows")
def op1(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return chat.read_back(chat.windows(turns.unionByName(added)))


@_query("op2_simhash_groups")
def op2(spark, sf):
    return simhash.near_report(_documents(spark, sf))


@_query("op3_quality_perplexity")
def op3(spark, sf):
    return quality.quality_report(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@_query("op4_version_sketches")
def op4(spark, sf):
    return fingerprints.fingerprint_report(_documents(spark, sf))


@_query("op5_exact_dedup", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, length(text) AS n, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS body FROM t),
w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""")
def op5(spark, sf):
    return exact_dedup.dedup_report(_documents(spark, sf))


@_query("op6_piece_segmentation")
def op6(spark, sf):
    return segmentation.encode_rows(_documents(spark, sf), digests=True, keep=["doc_id"])


@_query("op7_repeated_passages", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t) a),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS body, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)""")
def op7(spark, sf):
    return repeats.remove_repeats(_documents(spark, sf))


@_query("op8_mixed_sources")
def op8(spark, sf):
    return mixing.mix_report(_documents(spark, sf))


@_query("op9_pitman_yor_scores")
def op9(spark, sf):
    return pitman_yor.score(_documents(spark, sf))


@_query("op10_license_notices")
def op10(spark, sf):
    return licenses.scan(_documents(spark, sf)).withColumns(
        {c: F.array_join(c, " ") for c in ("added", "missing")})


@_query("op11_spelling_variants")
def op11(spark, sf):
    return spelling.variant_forms(_documents(spark, sf), typo=spelling.TYPO)


@_query("op12_periodic_runs")
def op12(spark, sf):
    return periods.run_report(_documents(spark, sf))


@_query("op13_top_vectors", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op13(spark, sf):
    return neighbours.top_matches(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
