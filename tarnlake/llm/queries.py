"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tarnlake.llm import bitsliced, html_text, licenses, line_dedup, lm, merkle, mixing, negatives, ngram_join, packing, quality_model, quality_rules, suffix_dedup
from tarnlake.llm.common import read
from tarnlake.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query(
    "op1_mix_sources",
    """
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
    ),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (
        SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
        FROM s
    ),
    -- sources in the order in which they reach their cap; the level if all before are at their cap
    r AS (
        SELECT *, 3.0 * source_size / weight AS reach,
            (sum(source_size) OVER ())::DOUBLE AS total,
            coalesce(sum(3.0 * source_size) OVER o, 0)::DOUBLE AS capped,
            (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS left_weight
        FROM w
        WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    level AS (SELECT arg_min((total - capped) / left_weight, reach) AS level FROM r WHERE (total - capped) / left_weight <= reach),
    t AS (
        SELECT source, source_size, least(3.0 * source_size, (SELECT level FROM level) * weight)::DOUBLE AS target FROM w
    ),
    p AS (
        SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
            coalesce(sum(d.size) OVER (
                PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id), d.doc_id, d.size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
            ), 0)::BIGINT AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
        CASE WHEN source_size = 0 THEN 0 ELSE
            (budget // source_size) * size + greatest(0, least(size, budget % source_size - before))
        END::BIGINT AS taken
    FROM p
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op2_pack_documents")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer())


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op4_ngram_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_groups(read(spark, sf_dir, "documents"), n=4, percent=85)


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op7_topk_bitsliced",
    """
    WITH e AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    p AS (
        SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), tokenizer())


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(*columns)


#: Levels that the SQL of the manifest can climb in each of its two trees: 8 ** 9 leaves.
SQL_LEVELS = 9


def manifest_sql() -> str:
    """Leaf, proof and fold of every document, level by level; a tree that is done passes a level unchanged."""
    fields = lambda text: " || ".join(
        f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    )
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(range(8)::UBIGINT[], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(c, b))"
    bytes_ = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1)))::UBIGINT[]"
    crc = f"xor(list_reduce({bytes_}, lambda c, b: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"

    def climb(tree: str) -> str:
        parts = []
        for k in range(SQL_LEVELS):
            parts.append(f"""
    {tree}_runs{k} AS MATERIALIZED (
        SELECT g, pos // 8 AS run, any_value(n) AS n, list(node ORDER BY pos) AS nodes FROM {tree}{k} GROUP BY g, pos // 8
    ),
    {tree}{k + 1} AS MATERIALIZED (
        SELECT g, run AS pos, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node, (n + 7) // 8 AS n
        FROM {tree}_runs{k}
    ),
    {tree}_path{k + 1} AS MATERIALIZED (
        SELECT id, p.g, run AS place,
            CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string(nodes[1:(place % 8)], '') || fold || array_to_string(nodes[(place % 8 + 2):8], '')) END AS fold,
            CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(nodes[1:(place % 8)], '') || array_to_string(nodes[(place % 8 + 2):8], '') END AS proof
        FROM {tree}_path{k} p JOIN {tree}_runs{k} r ON p.g = r.g AND p.place // 8 = r.run
    ),""")
        return "".join(parts)

    return f"""
    WITH hashed AS MATERIALIZED (
        SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({fields("text")}) AS leaf,
            CASE WHEN {crc} % 3 = 0 THEN sha256({fields(lowered)}) END AS claim
        FROM documents
    ),
    placed AS MATERIALIZED (
        SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY g) AS n
        FROM hashed
    ),
    tree0 AS (SELECT g, pos, leaf AS node, n FROM placed),
    tree_path0 AS (SELECT id, g, pos AS place, coalesce(claim, leaf) AS fold, '' AS proof FROM placed),{climb("tree")}
    subroots AS MATERIALIZED (SELECT g AS name, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree{SQL_LEVELS}),
    top0 AS (SELECT 0 AS g, pos, subroot AS node, n FROM subroots),
    top_path0 AS (SELECT id, 0 AS g, pos AS place, fold, proof FROM tree_path{SQL_LEVELS} p JOIN subroots s ON p.g = s.name),{climb("top")}
    root AS (SELECT node AS root FROM top{SQL_LEVELS})
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
    FROM placed d JOIN subroots s ON d.g = s.name JOIN top_path{SQL_LEVELS} p ON p.id = d.id CROSS JOIN root
    """


@query("op11_merkle_manifest", manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(read(spark, sf_dir, "documents"))


@query("op12_html_extract")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query(
    "op13_hard_negatives",
    """
    WITH e AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS MATERIALIZED (
        SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
        FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
    ),
    p AS (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE same
        QUALIFY place <= 5
    ),
    n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
        FROM p JOIN s ON p.row = s.row AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
