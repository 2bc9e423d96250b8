"""The queries of this subpackage: one thin query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brinewave.llm import bpe, conversations, frames, mixing, pitman_yor, sanitising, simhash, stable_projections, suffixes, toxicity, va_file, vector_blocks, warc, wavelet
from brinewave.plans.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_mixing(t: Tables) -> DataFrame:
    return mixing.mix(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@query(
    sql="""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
               FROM embeddings),
         s AS (SELECT a.vec_id AS query_id, b.vec_id,
                      CAST(list_sum(list_transform(list_zip(a.w, b.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
               FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """
)
def op4_va_file(t: Tables) -> DataFrame:
    vectors = vector_blocks.vectors_of(t.embeddings, "vec_id", "embedding")
    return va_file.search(vectors, F.col("id") % 50 == 0, 5)


@query()
def op10_stable_projections(t: Tables) -> DataFrame:
    vectors = vector_blocks.vectors_of(t.embeddings, "vec_id", "embedding", nonzero=True)
    return stable_projections.search(vectors, F.col("id") % 20 == 0, 20)


@query()
def op7_simhash(t: Tables) -> DataFrame:
    found = simhash.near_duplicates(t.documents)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op2_bpe(t: Tables) -> DataFrame:
    coded = bpe.encode(t.documents.select("doc_id", "text"), raw="decoded")
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_wavelet(t: Tables) -> DataFrame:
    return wavelet.write_and_read(t.documents).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op6_toxicity(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    z = toxicity.train(docs, t.labels)
    rows = toxicity.scored(docs, z).select("doc_id", toxicity.held_out().alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def _kind(kind: str):
    return lambda span: span["kind"] == kind


@query()
def op8_sanitising(t: Tables) -> DataFrame:
    found = sanitising.find(t.documents, keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", _kind(k))).cast("long").alias(f"n_{k}") for k in sanitising.KINDS]
    return found.select("doc_id", *counts, F.sha2(sanitising.described(base), 256).alias("base_sha256"), sanitising.described(F.col("spans")).alias("spans"))


@query()
def op3_suffixes(t: Tables) -> DataFrame:
    found = suffixes.repeated(t.documents)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        F.col("key").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op5_pitman_yor(t: Tables) -> DataFrame:
    return pitman_yor.score(t.documents)


@query(
    sql="""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
         g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                      CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
         c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
         s AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS z FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                            ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM s
    """
)
def op11_frames(t: Tables) -> DataFrame:
    made = frames.fill_in_middle(frames.store(t.documents.select("doc_id", "text")))
    digests = [frames.digest("filled").alias("output_sha256"), frames.restored_digest("filled", "form").alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query()
def op12_hirschberg(t: Tables) -> DataFrame:
    found = conversations.repair(conversations.damage(t.conversations)).conversations
    return found.select(F.col("conv").alias("conv_id"), *conversations.COUNTS, "audit", F.col("digest").alias("repaired_sha256"))


@query(
    sql="""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
         b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      CAST((CAST('0x' || substring(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS d,
                      row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN k > 1 THEN first END AS refers_to
    FROM b
    """
)
def op13_warc(t: Tables) -> DataFrame:
    return warc.write_and_read(t.pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
