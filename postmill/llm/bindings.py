"""The registered queries of this package, each beside its SQL where SQL can say the same."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality
from .bpe import encode_texts
from .common import Scratch, held_out
from .exact_dedup import exact_duplicates
from .fill_middle import fill_in_middle, restored
from .knn_join import top_k
from .line_chunks import remove_repeated_chunks
from .packing import pack_documents
from .piece_bpe import encode_pieces
from .simhash import near_duplicates
from .substring import remove_repeats
from .token_counts import section_tokens
from .vector_codes import encode_vectors, train_codebooks, with_total

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    return str(public_tokenizers.path(name))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~fold))
    return quality.score(docs, model).select(
        "doc_id", fold.alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op2_voronoi_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(
           CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, CAST(row_number() OVER (
         PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(
        table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10,
    ).withColumnRenamed("id", "vec_id")


@query("op3_simhash_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_bpe_codec")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_line_dedup", """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
rolled AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_lines,
         md5(coalesce(lag(md5(line)) OVER (PARTITION BY doc_id ORDER BY i), '') || md5(line)) AS r
  FROM line),
valued AS (SELECT *, CAST('0x' || substr(r, 1, 8) AS BIGINT) AS v FROM rolled),
cut AS (
  SELECT *, CASE WHEN i = n_lines OR (i > 1 AND i < n_lines - 1 AND v < lag(v) OVER w AND v < lead(v) OVER w)
                 THEN 1 ELSE 0 END AS stop
  FROM valued WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, sum(stop) OVER (PARTITION BY doc_id ORDER BY i) - stop AS c FROM cut),
chunk AS (
  SELECT doc_id, c, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t
  FROM numbered GROUP BY doc_id, c),
marked AS (
  SELECT doc_id, c, n > 1 AND row_number() OVER (PARTITION BY t ORDER BY n = 1, doc_id, c) > 1 AS gone
  FROM chunk)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM numbered JOIN marked USING (doc_id, c) GROUP BY doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_chunks(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))), tokenizer("piece_bpe_32k.model"))
    return language.predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_exact_dedup", """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer(), size=2048)


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_sentencepiece_codec")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_pieces(docs, tokenizer("piece_bpe_32k.model")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_fill_in_middle", r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS d,
         regexp_extract_all(coalesce(text, ''),
           '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
h AS (
  SELECT *, len(tokens) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(tokens) + 1) AS a,
         CAST('0x' || d[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (
  SELECT *, array_to_string(tokens[1:least(a, b)], '') AS prefix,
         array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(tokens[greatest(a, b) + 1:], '') AS suffix
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), seed=42).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    """Every round as two more tables: the nearest entries, then the moved ones."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, p, min({{'away': CAST(list_dot_product(s, s) - 2 * list_dot_product(s, c)
           + list_dot_product(c, c) AS BIGINT), 'k': k}}) AS m
  FROM part JOIN k{i} USING (p) GROUP BY vec_id, p)""")
        if i < rounds:
            steps.append(f"""
u{i} AS (
  SELECT p, k, j, CAST(sum(v) AS BIGINT) AS total, count(*) AS n
  FROM (SELECT vec_id, p, m.k AS k, unnest(s) AS v, generate_subscripts(s, 1) AS j
        FROM part JOIN a{i} USING (vec_id, p)) GROUP BY p, k, j),
k{i + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(moved, c) AS c FROM k{i} LEFT JOIN (
    SELECT p, k, list(CAST((total - ((total % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS moved
    FROM u{i} GROUP BY p, k) USING (p, k))""")
    return f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS MATERIALIZED (
  SELECT vec_id, CAST(p AS INTEGER) AS p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS s
  FROM x, range(4) AS r(p)),
k0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, s AS c
  FROM part WHERE vec_id IN (SELECT vec_id FROM x ORDER BY vec_id LIMIT 256)),{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code,
         CAST(sum(m.away) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
book AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256
  FROM (SELECT p, k, unnest(c) AS v, generate_subscripts(c, 1) AS j FROM k{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       codebooks_sha256
FROM coded JOIN x USING (vec_id), book
"""


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train_codebooks(vectors, parts=4, entries=256, rounds=4, scale=1024)
    listed = ",".join(map(str, books.listed()))
    coded, _ = Scratch(spark, "codes").cut(encode_vectors(vectors, books, keep=["label"]))
    return with_total(coded, of="error", by="label", name="label_error", key="vec_id").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))
