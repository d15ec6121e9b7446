"""The training-data operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.bitplanes import round_trip
from veriloom.llm.chat import rotate
from veriloom.llm.common import documents
from veriloom.llm.exact_dedup import exact_dedup
from veriloom.llm.language import identify
from veriloom.llm.licenses import scan
from veriloom.llm.mixing import mix
from veriloom.llm.near_dedup import near_dedup
from veriloom.llm.negatives import hard_negatives
from veriloom.llm.packing import pack
from veriloom.llm.prefixes import prefix_trie
from veriloom.llm.quality import classify
from veriloom.llm.repeats import without_repeats
from veriloom.llm.tokens import vocabulary
from veriloom.llm.topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end=0, held=700_000)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, language and thousand of ids."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(documents(spark, sf_dir).withColumn("path", path))


def op4_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=1, held=500_000)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_mixing": op2_mixing,
        "op3_licenses": op3_licenses,
        "op4_bitplanes": op4_bitplanes,
        "op5_near_dedup": op5_near_dedup,
        "op6_topk": op6_topk,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_chat": op10_chat,
        "op11_substrings": op11_substrings,
        "op12_negatives": op12_negatives,
        "op13_prefixes": op13_prefixes,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_topk": """
            WITH usable AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
                FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
            )
            SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
            FROM scored WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
        """,
        "op12_negatives": """
            WITH usable AS (
                SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                       list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                       CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
                FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
            ), positives AS (
                SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
            )
            SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
            FROM positives JOIN scored n USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
            WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY rank <= 5
        """,
        "op13_prefixes": """
            WITH lists AS (
                SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
                FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
            ), summed AS (
                SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for k in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS sum
                FROM lists
            ), rebuilt AS (
                SELECT c.conv_id, coalesce(b.turns[1:xor(c.sum, 4294967295) % 9], []) || c.turns[xor(c.sum, 4294967295) % 9 + 1:] AS turns
                FROM summed c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 5
            ), prefixes AS (
                SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
            ), nodes AS (
                SELECT turns[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                       sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
                FROM prefixes GROUP BY ALL
            ), kids AS (
                SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
            ), sized AS (
                SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(key[depth].t) END AS saved
                FROM nodes LEFT JOIN kids USING (key, depth)
            )
            SELECT a.conv_id, a.depth, any_value(p.conv_id) AS parent_conv_id, a.n_convs, a.n_children,
                   count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
            FROM sized a JOIN sized b ON b.depth >= a.depth AND b.key[1:a.depth] = a.key
            LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.key = a.key[1:a.depth - 1]
            GROUP BY a.key, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends_sha256
        """,
        "op9_exact_dedup": r"""
            WITH normal AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
            ), grouped AS (
                SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY norm
            )
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
            FROM normal JOIN grouped USING (norm)
        """,
        "op10_chat": r"""
            WITH said AS (
                SELECT conv_id, turn, coalesce(nullif(regexp_replace(coalesce(role, ''), '[\r\n<>]', ' ', 'g'), ''), 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text
                FROM conversations
            ), rotated AS (
                SELECT s.*, p.perspective,
                       CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
                FROM said s JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system') p
                  ON s.conv_id IS NOT DISTINCT FROM p.conv_id
            ), headed AS (
                SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM rotated
            ), sized AS (
                SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM headed
            ), placed AS (
                SELECT *, row_number() OVER told - 1 AS pos,
                       CAST(sum(length(rendered)) OVER (told ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
                FROM sized
                WINDOW told AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
            )
            SELECT conv_id, perspective, pos, turn, speaker, chat_role, rendered, char_end - length(rendered) AS char_start, char_end,
                   CASE WHEN chat_role = 'assistant' THEN char_end - length(rendered) + length(head) END AS mask_start,
                   CASE WHEN chat_role = 'assistant' THEN char_end - 1 END AS mask_end
            FROM placed
        """,
    }
