"""Vector, keyword and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.text import chunk_text
from tarnlake.operators import search, vectors
from tarnlake.operators.cells import CellIndex
from tarnlake.operators.collections import Collection
from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path, shared_path
from tarnlake.sources.tables import Lakehouse, fingerprint

QUERY = "The letter is with them, reth and hant"
TERMS = search.query_terms(QUERY)

_COSINE = (
    "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
    "(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
    "sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) + 1e-9)"
)
_DENSE_SQL = f"""
    q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
    dense AS (SELECT vec_id AS doc_id, round({_COSINE.format(a="embedding", b="qv")}, 4) AS score
              FROM embeddings, q)
"""


@query("embed_collection")
def embed_collection(spark, sf_dir):
    """Hashed TF-IDF vectors of every document, described by size and length."""
    made = vectors.embed_texts(table(spark, sf_dir, "documents"), "doc_id", "text", dimensions=128)
    return made.select(
        "doc_id",
        F.size("vector").alias("dimensions"),
        F.round(vectors.norm(F.col("vector")), 4).alias("length"),
    )


@query(
    "collection_put",
    """
    SELECT vec_id AS id, len(embedding) AS dimensions,
           round(CAST(embedding[1] AS DOUBLE) * CASE WHEN label = 3 THEN 2 ELSE 1 END, 4) AS first_component,
           (SELECT count(*) FROM embeddings) AS vectors
    FROM embeddings
    """,
)
def collection_put(spark, sf_dir):
    """All embeddings stored as a collection, then those of one label doubled and put again by key."""
    embeddings = table(spark, sf_dir, "embeddings")
    held = Collection(Lakehouse(spark, scratch_path(spark, "collection")), "embeddings")
    held.replace(embeddings, "vec_id", "embedding")
    doubled = embeddings.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    status = held.put(doubled, "vec_id", "embedding")
    return held.read().select(
        "id", F.size("vector").alias("dimensions"), F.round(F.col("vector")[0].cast("double"), 4).alias("first_component"),
        F.lit(status["vectors"]).cast("bigint").alias("vectors"),
    )


def _query_vector(spark, sf_dir):
    first = table(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id"))
    return first.scalar()


@query(
    "vector_topk",
    f"WITH {_DENSE_SQL} SELECT doc_id AS vec_id, score FROM dense ORDER BY score DESC, vec_id LIMIT 10",
)
def vector_topk(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return vectors.top_similar(
        embeddings, "vec_id", "embedding", _query_vector(spark, sf_dir), k=10
    )


@query(
    "vector_knn",
    f"""
    WITH pairs AS (
      SELECT a.vec_id AS query_id, b.vec_id AS item_id,
             round({_COSINE.format(a="a.embedding", b="b.embedding")}, 4) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
    FROM pairs QUALIFY rank <= 20
    """,
)
def vector_knn(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return vectors.nearest_neighbours(embeddings, embeddings, "vec_id", "embedding", k=20)


@query("vector_knn_lsh")
def vector_knn_lsh(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return vectors.nearest_neighbours_lsh(
        embeddings, embeddings, "vec_id", "embedding", dimensions=64, k=20, planes=3, tables=16
    )


def _cells(spark, sf_dir):
    """The stored cell index of the embeddings, built once for the files as they are."""
    files = f"{sf_dir.rstrip('/')}/embeddings.parquet"
    index = CellIndex(Lakehouse(spark, shared_path(spark, f"cells-{fingerprint(spark, files)}")), "embeddings")
    if not index.exists():
        index.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=20)
    return index


@query("vector_knn_cells")
def vector_knn_cells(spark, sf_dir):
    """The 20 nearest rows of every row from the cells near it; tests measure its recall."""
    return _cells(spark, sf_dir).search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=20)


@query(
    "vector_cells_report",
    f"""
    WITH pairs AS (
      SELECT a.vec_id AS query_id, {_COSINE.format(a="a.embedding", b="b.embedding")} AS score, b.vec_id AS item_id
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    best AS (
      SELECT query_id FROM pairs
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, item_id) <= 20)
    SELECT (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM best) AS true_pairs,
           (SELECT count(*) FROM pairs) AS all_pairs, TRUE AS recall_reached, TRUE AS fewer_compared
    """,
)
def vector_cells_report(spark, sf_dir):
    """Recall and compared pairs of the cell index against exact search over all rows."""
    embeddings = table(spark, sf_dir, "embeddings")
    index = _cells(spark, sf_dir)
    found = index.search(embeddings, "vec_id", "embedding", k=20).select("query_id", "item_id", F.lit(1).alias("_hit"))
    true = vectors.nearest_neighbours(embeddings, embeddings, "vec_id", "embedding", k=20)
    hits = true.join(found, ["query_id", "item_id"], "left").agg(F.count("*").alias("true_pairs"), F.count("_hit").alias("_hits"))
    rows = embeddings.agg(F.count("*").alias("indexed"))
    compared = index.compared(embeddings, "vec_id", "embedding")
    all_pairs = F.col("indexed") * (F.col("indexed") - 1)
    return rows.join(hits).select(
        "indexed", "true_pairs", all_pairs.alias("all_pairs"),
        (F.col("_hits") >= 0.9 * F.col("true_pairs")).alias("recall_reached"),
        (F.lit(compared) < all_pairs).alias("fewer_compared"),
    )


@query(
    "chunk_documents",
    """
    WITH n AS (
      SELECT doc_id, text, unnest(generate_series(0,
        CAST(greatest(ceil((length(text) - 512) / 448.0), 0) AS INTEGER))) AS chunk_no
      FROM documents WHERE length(text) > 0)
    SELECT doc_id, chunk_no, length(substring(text, chunk_no * 448 + 1, 512)) AS chars,
           md5(substring(text, chunk_no * 448 + 1, 512)) AS content
    FROM n
    """,
)
def chunk_documents(spark, sf_dir):
    chunks = chunk_text(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "text", size=512, overlap=64
    )
    return chunks.select(
        "doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("content")
    )


def _bm25_sql() -> str:
    terms = ", ".join(f"('{t}')" for t in TERMS)
    return f"""
    words AS (
      SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w
      FROM documents),
    terms(term) AS (VALUES {terms}),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM words),
    tf AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS f
           FROM words, terms),
    df AS (SELECT term, count(*) FILTER (f > 0) AS d FROM tf GROUP BY 1),
    keyword AS (
      SELECT doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2
               / (f + 1.2 * (0.25 + 0.75 * dl / mean_len))), 6) AS score,
             count(*) FILTER (f > 0) AS matched
      FROM tf JOIN df USING (term), st GROUP BY 1 HAVING count(*) FILTER (f > 0) > 0)
    """


def _keyword(spark, sf_dir):
    """Scores from the stored index of the documents, which is built once for the files as they are."""
    texts = f"{sf_dir.rstrip('/')}/documents.parquet"
    lake = Lakehouse(spark, shared_path(spark, f"index-{fingerprint(spark, texts)}"))
    index = search.TermIndex(lake, "documents")
    if not lake.exists("documents_sizes"):
        index.add(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.search(QUERY, "doc_id")


@query(
    "bm25_topk",
    f"WITH {_bm25_sql()} SELECT doc_id, score, matched FROM keyword ORDER BY score DESC, doc_id LIMIT 20",
)
def bm25_topk(spark, sf_dir):
    return search.best(_keyword(spark, sf_dir), "doc_id", 20)


@query(
    "hybrid_rrf",
    f"""
    WITH {_bm25_sql()}, {_DENSE_SQL},
    a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM dense QUALIFY r <= 50),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM keyword QUALIFY r <= 50)
    SELECT doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 8) AS rrf
    FROM a FULL JOIN b USING (doc_id) ORDER BY rrf DESC, doc_id LIMIT 10
    """,
)
def hybrid_rrf(spark, sf_dir):
    dense = vectors.top_similar(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 50
    ).withColumnRenamed("vec_id", "doc_id")
    keyword = _keyword(spark, sf_dir).select("doc_id", "score")
    return search.fuse_ranks([dense, keyword], "doc_id", depth=50, k=10)


@query(
    "rerank_topk",
    f"""
    WITH {_bm25_sql()},
    c AS (SELECT * FROM keyword ORDER BY score DESC, doc_id LIMIT 50)
    SELECT doc_id, score, matched, round(matched / {len(TERMS)}.0, 6) AS coverage FROM c
    ORDER BY coverage DESC, score DESC, doc_id LIMIT 10
    """,
)
def rerank_topk(spark, sf_dir):
    candidates = search.best(_keyword(spark, sf_dir), "doc_id", 50)
    return search.rerank(candidates, "doc_id", len(TERMS), 10)


@query(
    "doc_assembly",
    """
    SELECT p_partkey, p_name || ' ($' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)
           || ', size ' || p_size || '): ' || coalesce(nullif(p_type, 'PROMO'), '-')
           || ' by ' || p_brand AS doc_text
    FROM part
    """,
)
def doc_assembly(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    kind = F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("-"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.format_string(
            "%s ($%s, size %d): %s by %s", "p_name", price, "p_size", kind, "p_brand"
        ).alias("doc_text"),
    )


@query(
    "collection_status",
    """
    SELECT 'label-' || label AS collection, max(vec_id) >= 300 AND label < 7 AS is_built,
           CASE WHEN label < 7 THEN count(*) ELSE 0 END AS vectors,
           CASE WHEN label < 7 THEN max(len(embedding)) ELSE 0 END AS dimensions
    FROM embeddings GROUP BY label
    """,
)
def collection_status(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").withColumn(
        "collection", F.concat(F.lit("label-"), F.col("label").cast("string"))
    )
    configured = embeddings.select("collection").distinct()
    built = embeddings.filter("label < 7").select("collection", F.col("embedding").alias("vector"))
    return vectors.collection_status(configured, built)
