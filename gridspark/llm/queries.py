"""The registered queries of this subpackage, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm import best_fit, byte_bpe, crf_pii, debruijn, exact_dedup, fill_middle, license_scan, masked_lm, merkle, packing, pigeonhole, prob_minhash, quality

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_exact_dedup", """
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
    FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), path, pattern), path, pattern)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_near_dedup", """
    WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(words[s:s + 4], ' ') AS shingle FROM (
        SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS s FROM split WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
    links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE c.n >= 0.8::DOUBLE * (x.n + y.n - c.n)),
    reached(a, b) AS (SELECT doc_id, doc_id FROM split UNION SELECT l.a, r.b FROM reached r JOIN links l ON l.b = r.a),
    least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
    SELECT s.doc_id, l.b AS class_id, s.doc_id = l.b AS kept, coalesce(z.n, 0)::INT AS n_shingles FROM split s JOIN least l ON l.a = s.doc_id LEFT JOIN sizes z ON z.doc_id = s.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_dedup(documents(spark, sf_dir))


@query("op4_embedding_dedup", """
    WITH RECURSIVE good AS (
        SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS length FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.9),
    reached(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT l.a, r.b FROM reached r JOIN links l ON l.b = r.a),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
    SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.b, e.vec_id) AS component_id, e.vec_id = coalesce(c.b, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least c ON c.a = e.vec_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op5_substring_dedup", """
    WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    windows AS (SELECT doc_id, s, array_to_string(words[s:s + 34], ' ') AS spelled FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM split)),
    repeated AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY spelled) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS place FROM repeated),
    placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT s.doc_id, len(s.words) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = crf_pii.find_pii(docs, crf_pii.train())
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.withColumn("base", F.filter("spans", lambda s: s["base"])).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in crf_pii.KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op7_license_scan", license_scan.DOCUMENTS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir).select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(documents(spark, sf_dir))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op11_fill_middle", """
    WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
                          sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (SELECT doc_id, text, tokens, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                          WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM words),
    cut AS (SELECT *, array_to_string(tokens[1:least(a, b)], '') AS prefix, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
                   array_to_string(tokens[greatest(a, b) + 1:n], '') AS suffix FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM cut""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


@query("op12_best_fit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op13_merkle", merkle.MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))
