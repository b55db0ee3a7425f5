"""The registered queries of the subpackage, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, token_files
from tidemark.llm.centroids import cluster_vectors
from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.pii import KINDS, find_pii, spans_text
from tidemark.llm.resampling import resample
from tidemark.llm.suffix_dedup import cut_repeats
from tidemark.llm.tiling import find_leaks
from tidemark.llm.topk import quantized, top_k
from tidemark.llm.toxicity import score_toxicity
from tidemark.llm.url_filter import judge_urls
from tidemark.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
    WITH lines AS (
      SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
      FROM documents
    ), keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM lines
    ), judged AS (
      SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed
    )
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
           CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of at least 10 characters stays in the first document that holds it."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@query(
    r"""
    WITH rules(h, p, v) AS (
      VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
             ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), rests AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
             row_number() OVER () AS n
      FROM pages
    ), sites AS (
      SELECT page_id, n,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM rests
    ), fits AS (
      SELECT s.*, h || p AS rule, v,
             row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS place
      FROM sites s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    )
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE place = 1
    """
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the longest rule that fits its url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from three quarters of the labelled documents, predicted for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    trees = language.train(docs.where(fold != 2))
    found = language.identify(docs.select("doc_id", "text"), trees, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to byte-level BPE ids and back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern, packed=True, keep=["doc_id"])
    ids = ids.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    back = bpe.decode(ids, ranks, pattern, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, each with an end id, written and read back."""
    folder = shared_dir(spark, "token-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(docs, folder, path, end_id=1, special_tokens=True)
    return token_files.with_crc32(
        token_files.read_tokens(spark, folder), keep=["doc_id", "start", "n_tokens"]
    )


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, in one piece or in several, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by its nearest labelled examples from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = score_toxicity(docs, labels)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query(
    """
    WITH vectors AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
      FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM scores
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """
)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches of every hundredth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", quantized(F.col("embedding")).alias("vector")
    )
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


@query()
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, at a Jaccard similarity of 0.75 of word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the 50-byte strings that an earlier document holds."""
    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _rounds_sql(rounds: int) -> str:
    """Lloyd's rounds one after the other, each as three common table expressions."""
    text = ""
    for n in range(rounds + 1):
        text += f"""
        a{n} AS MATERIALIZED (
          SELECT vec_id, v, min(struct_pack(far := list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), c := c)) AS best
          FROM kept, c{n} GROUP BY n, vec_id, v
        ),"""
        if n < rounds:
            text += f"""
        m{n} AS (
          SELECT c, list(mean ORDER BY d) AS w FROM (
            SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (
              SELECT best.c AS c, d, sum(v[d]) AS s, count(*) AS n FROM a{n}, range(1, 65) AS dims(d) GROUP BY best.c, d
            )
          ) GROUP BY c
        ),
        c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.w, c{n}.w) AS w FROM c{n} LEFT JOIN m{n} USING (c)),"""
    return text


@query(
    f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, row_number() OVER () AS n,
             list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v AS w FROM kept
      QUALIFY c < 8
    ), {_rounds_sql(10)}
    last AS (SELECT vec_id, best.c AS cluster, CAST(best.far AS BIGINT) AS distance FROM a10)
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
    FROM last JOIN c10 ON cluster = c
    """
)
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in eight clusters after ten rounds."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )


@query(
    r"""
    WITH crcs AS MATERIALIZED (
      SELECT list_transform(range(256), lambda x:
        list_reduce(range(8), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS crc
    ), words AS MATERIALIZED (
      SELECT n, doc_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM (SELECT row_number() OVER () AS n, doc_id, text FROM documents
            UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark)
    ), bytes AS (
      SELECT word, list_transform(range(0, CAST(length(h) AS BIGINT), 2), lambda i:
               (instr('0123456789ABCDEF', h[i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 2]) - 1) AS b
      FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words))
    ), buckets AS (
      SELECT word, xor(4294967295, list_reduce(b, lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]), 4294967295)) % 10000 AS bucket
      FROM bytes, crcs
    ), features AS MATERIALIZED (SELECT n, doc_id, bucket FROM words JOIN buckets USING (word)),
    counts AS (
      SELECT bucket, CAST(count(*) FILTER (n > 0) AS DOUBLE) AS s, CAST(count(*) FILTER (n < 0) AS DOUBLE) AS t
      FROM features GROUP BY bucket
    ), gains AS (
      SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
      FROM counts
    ), weights AS (
      SELECT n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total
      FROM features JOIN gains USING (bucket) WHERE n > 0 GROUP BY n
    ), scores AS (
      SELECT doc_id, coalesce(n_features, 0) AS n_features,
             coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
      FROM (SELECT row_number() OVER () AS n, doc_id FROM documents) LEFT JOIN weights USING (n)
    ), scored AS (
      SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scores
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (n_features >= 20) OVER () AS many
      FROM scored
    )
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
           CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN CAST(place AS BIGINT) END AS rank
    FROM ranked
    """
)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn by how much they read like the benchmark."""
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all texts: base patterns, and what the labelers' votes add."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(number(kind) for kind in KINDS),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )
