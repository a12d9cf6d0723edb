"""Queries of this folder: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.language import fold, predict, train

    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(fold("doc_id", 4) != 2))
    return predict(documents, model).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))


@query("op5_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         h AS (SELECT html, max(page_id) AS head FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
    SELECT page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS payload_digest,
           CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN head <> page_id THEN head END AS refers_to
    FROM p LEFT JOIN h ON p.html = h.html""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> bytes:
    """A tokenizer's file, read on the driver; tasks get it as a broadcast of its size (1 to 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabloom.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode())


@query("op4_token_output")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.token_output import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode())


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.language import fold
    from tabloom.llm.toxicity import score, train

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.where(fold("doc_id", 5) != 0))
    return score(documents, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.html_text import main_text, train

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages))


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n_links=True)


@query("op11_hard_negatives", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
                      list_inner_product(a.x, o.x)::BIGINT AS score
               FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
         p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
         n AS (SELECT p.*, other_id AS negative_id, score AS negative_score,
                      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
               FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_line_dedup", """
    WITH l AS (SELECT doc_id, pos, line,
                      translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
               FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
                     FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
         r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
         m AS (SELECT l.*, r.first IS NOT NULL AND l.doc_id <> r.first AS gone FROM l LEFT JOIN r ON l.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
