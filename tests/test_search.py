import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions.text import chunk_text, spaced_words, term_count, word_count
from tarnlake.operators import search, vectors
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Batch, Lakehouse

from .conftest import rows

TEXTS = [
    "the cat sat on the mat", "The dog. THE DOG!", "", "cat", None, "été the-cat thecat cat",
    "  spaced   out  ", "a1 b2 a1a1 a1",
]


def words(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def test_word_and_term_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = df.select("id", spaced_words(F.col("t")).alias("s")).select(
        "id", word_count(F.col("s")), term_count(F.col("s"), "the"), term_count(F.col("s"), "a1")
    )
    for i, n, the, a1 in got.collect():
        if TEXTS[i] is not None:
            w = words(TEXTS[i])
            assert (n, the, a1) == (len(w), w.count("the"), w.count("a1")), TEXTS[i]


def brute_bm25(texts, query):
    docs = {i: words(t) for i, t in enumerate(texts) if t is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    terms = search.query_terms(query)
    out = {}
    for i, d in docs.items():
        score, hit = 0.0, False
        for t in terms:
            df = sum(t in e for e in docs.values())
            tf = d.count(t)
            hit = hit or tf > 0
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        if hit:
            out[i] = round(score, 6)
    return out


def test_bm25_matches_brute_force(spark):
    texts = [t for t in TEXTS if t is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["score"] for r in search.bm25(df, "id", "t", "The cat, the a1").collect()}
    assert got == pytest.approx(brute_bm25(texts, "The cat, the a1"))
    with pytest.raises(ValueError):
        search.bm25(df, "id", "t", " ?! ")


def test_index_matches_the_scan_over_batches(spark):
    texts = [t for t in TEXTS if t is not None] * 2 + ["The cat sat", ""]
    rows_ = list(enumerate(texts)) + [(3, texts[3])]  # a repeated row is a document of its own
    df = spark.createDataFrame(rows_, "id int, t string")
    lake = Lakehouse(spark, scratch_path(spark, "index"))
    index = search.TermIndex(lake, "texts", buckets=8)
    index.add(df.where("id % 3 = 0"), "id", "t")
    index.add(df.where("id % 3 > 0"), "id", "t")
    for question in ("The cat, the a1", "nowhere to be found", "cat"):
        want = sorted(tuple(r) for r in search.bm25(df, "id", "t", question).collect())
        got = sorted(tuple(r) for r in index.search(question).collect())
        assert [(i, m) for i, _, m in got] == [(i, m) for i, _, m in want]
        assert [s for _, s, _ in got] == pytest.approx([s for _, s, _ in want], abs=2e-6)
    with pytest.raises(ValueError):
        index.search(" ?! ")


def test_search_opens_only_the_buckets_of_its_terms(spark):
    df = spark.range(300).selectExpr("id", "concat('w', id, ' common') AS t")
    lake = Lakehouse(spark, scratch_path(spark, "index"))
    index = search.TermIndex(lake, "texts", buckets=16)
    index.add(df, "id", "t")
    assert len(lake.parts("texts_postings")) == 16
    opened = index.search("w7").inputFiles()
    assert {f.rsplit("/", 2)[1] for f in opened} == {f"__bucket={index._parts(['w7'])[0].bucket}"}
    assert [r["id"] for r in index.search("w7").collect()] == [7]
    files = set(lake.parts("texts_postings"))
    index.add(df.limit(1), "id", "t")
    assert files < set(lake.parts("texts_postings"))


def test_index_dies_halfway_and_is_built_again(spark, monkeypatch):
    lake = Lakehouse(spark, scratch_path(spark, "index"))
    index = search.TermIndex(lake, "texts", buckets=4)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    with monkeypatch.context() as patched, pytest.raises(OSError):
        patched.setattr(Batch, "stage", lambda *_: (_ for _ in ()).throw(OSError()))
        index.add(df, "id", "t")
    assert lake.manifest().version == 0
    index.add(df, "id", "t")
    assert [(r["id"], r["matched"]) for r in index.search("B c").collect()] == [(1, 1)]


def test_chunks(spark):
    texts = ["", "abc", "abcde", "abcdef", "abcdefgh", "abcdefghi", "日本語テキスト長い"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in chunk_text(df, "t", size=5, overlap=2).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    want = {}
    for i, t in enumerate(texts):
        at = 0
        while t:
            want.setdefault(i, []).append(t[at : at + 5])
            if at + 5 >= len(t):
                break
            at += 3
    assert got == want
    with pytest.raises(ValueError):
        chunk_text(df, "t", 4, 4)


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.1)], "id int, score double")
    b = spark.createDataFrame([(3, 7.0), (1, 6.0)], "id int, score double")
    got = search.fuse_ranks([a, b], "id", depth=2, k=5).collect()
    want = {1: 1 / 61 + 1 / 62, 2: 1 / 62, 3: 1 / 61}
    assert [r["id"] for r in got] == [1, 3, 2]
    assert {r["id"]: r["rrf"] for r in got} == pytest.approx(want, abs=1e-8)
    c = spark.createDataFrame([(1, 9.0, 1), (2, 1.0, 2)], "id int, score double, matched int")
    assert [r["id"] for r in search.rerank(c, "id", 2, 2).collect()] == [2, 1]


# --- vectors --------------------------------------------------------------------


def points(n=60, dims=6, seed=3):
    pick = random.Random(seed)
    data = [(i, [float(pick.randrange(-2, 3)) for _ in range(dims)]) for i in range(n)]
    if n > 5:
        data[5] = (5, [0.0] * dims)
    return data


def brute_knn(data, k):
    vecs = np.array([v for _, v in data])
    size = np.linalg.norm(vecs, axis=1)
    sims = np.round(vecs @ vecs.T / (np.outer(size, size) + 1e-9), 4)
    out = {}
    for i in range(len(data)):
        order = sorted((j for j in range(len(data)) if j != i), key=lambda j: (-sims[i, j], j))
        out[i] = order[:k]
    return out


def test_postings_are_counted_without_a_shuffle(spark, monkeypatch):
    plans, stage = [], Batch.stage_buckets

    def seen(self, df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        counted = sorted((r["id"], r["len"], r["term"], r["tf"]) for r in df.collect())
        assert counted == [(1, 3, "a", 2), (1, 3, "b", 1), (4, 1, "a", 1), (4, 1, "a", 1)]
        return stage(self, df, *args, **options)

    monkeypatch.setattr(Batch, "stage_buckets", seen)
    texts = [(1, "a B a"), (2, ""), (3, None), (4, "a"), (4, "a")]
    index = search.TermIndex(Lakehouse(spark, scratch_path(spark, "terms")), "t")
    index.add(spark.createDataFrame(texts, "id bigint, text string"), "id", "text")
    assert len(plans) == 1 and "Exchange" not in plans[0]


@pytest.mark.parametrize("block", [7, 1000])
def test_exact_neighbours_in_any_blocking(spark, block):
    data = points()
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    got = vectors.nearest_neighbours(df, df, "id", "v", k=4, block_rows=block)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["item_id"])
    assert found == brute_knn(data, 4)


def test_fewer_items_than_neighbours(spark):
    df = spark.createDataFrame(points(3), "id bigint, v array<float>")
    assert vectors.nearest_neighbours(df, df, "id", "v", k=10).count() == 6


def test_bucketed_neighbours(spark):
    data = points(80)
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    # Without planes everything shares one bucket, cut into blocks: the exact answer.
    same = vectors.nearest_neighbours_lsh(df, df, "id", "v", 6, k=3, planes=0, tables=1, block_rows=9)
    exact = vectors.nearest_neighbours(df, df, "id", "v", k=3)
    assert rows(same.select("query_id", "item_id")) == rows(exact.select("query_id", "item_id"))
    near = vectors.nearest_neighbours_lsh(df, df, "id", "v", 6, k=3, planes=2, tables=12, block_rows=9)
    hits = near.join(exact, ["query_id", "item_id"]).count()
    assert hits / exact.count() >= 0.9


def test_a_search_copies_no_vector_per_block(spark):
    df = spark.createDataFrame(points(), "id bigint, v array<float>")
    for found in (
        vectors.nearest_neighbours(df, df, "id", "v", k=4, block_rows=7),
        vectors.nearest_neighbours_lsh(df, df, "id", "v", 6, k=4, planes=1, tables=4, block_rows=7),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "explode" not in plan and "Generate" not in plan


def test_items_without_a_direction_hide_no_neighbour(spark):
    data = [(i, [1.0, i / 10, 0.0]) for i in range(6)]
    odd = [(10, [float("nan"), 1.0, 0.0]), (11, [float("inf"), 1.0, 0.0]), (12, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data + odd, "id bigint, v array<float>")
    got = vectors.nearest_neighbours(df.where("id < 6"), df, "id", "v", k=6)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["item_id"])
    plain = [d for d in data] + [(6, [0.0, 0.0, 0.0])]
    true = brute_knn(plain, 6)
    assert found == {q: [12 if i == 6 else i for i in true[q]] for q in range(6)}


def test_many_copies_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)], "id bigint, v array<float>")
    got = vectors.nearest_neighbours(df, df, "id", "v", k=3, block_rows=16)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    assert found == {q: [(i, 1.0) for i in range(4) if i != q][:3] for q in range(90)}


@pytest.mark.parametrize("planes", [2, 6])
def test_buckets_give_the_same_pairs_in_one_pass_and_apart(spark, planes):
    data = points(80)
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    normals = np.random.default_rng(42).standard_normal((2, planes, 6))
    points_ = np.array([v for _, v in data], dtype=np.float32).astype(float)
    codes = np.stack([((points_ @ n.T) > 0) @ (2 ** np.arange(planes)) for n in normals], axis=1)
    size = np.linalg.norm(points_, axis=1)
    sims = np.round(points_ @ points_.T / (np.outer(size, size) + 1e-9), 4)
    want = set()
    for q in range(80):
        near = [i for i in range(80) if i != q and (codes[i] == codes[q]).any()]
        want |= {(q, i) for i in sorted(near, key=lambda i: (-sims[q, i], i))[:3]}
    got = vectors.nearest_neighbours_lsh(df, df, "id", "v", 6, k=3, planes=planes, tables=2, block_rows=9)
    assert {(r["query_id"], r["item_id"]) for r in got.collect()} == want


def test_top_similar(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<float>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert [tuple(r) for r in vectors.top_similar(df, "id", "v", query, 2).collect()] == [(1, 1.0), (3, 0.7071)]


def test_embedding_function_and_default(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "ccc")], "id bigint, t string")
    own = vectors.embed_texts(df, "id", "t", embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert rows(own) == [(1, [3.0, 1.0]), (3, [3.0, 1.0])]
    made = vectors.embed_texts(df, "id", "t", dimensions=16)
    assert all(len(r["vector"]) == 16 for r in made.collect()) and made.count() == 2


def test_collection_status(spark):
    configured = spark.createDataFrame([("a",), ("b",)], "collection string")
    built = spark.createDataFrame([("a", [1.0, 2.0])], "collection string, vector array<float>")
    assert rows(vectors.collection_status(configured, built)) == [("a", True, 1, 2), ("b", False, 0, 0)]
