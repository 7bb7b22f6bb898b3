"""The manifest against one built in memory, level by level."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tarnlake.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        out.append((nodes[first:at], nodes[at + 1 : first + 8]))
        at //= 8
    return out


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            steps = path(trees[g], k) + path(top, i)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf_of({**r, "text": lower(r["text"])}) if hit else leaf_of(r)
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], root, sha("".join("".join(a + b) for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in merkle.tampered_proofs(df, **more).collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, node string"


def rows_of(n, langs):
    return [(k * 7 % 1009 if k % 13 else None, None if k % 11 == 0 else f"Té{k % 90}x" * (k % 5), langs[k % len(langs)], "S" if k % 3 else None, k, "a", 1, "b") for k in range(n)]


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_every_leaf_and_proof(spark, partitions, stride):
    rows = rows_of(700, ["en", "en", "en", "de", None, "", "é", "z" * 300])
    rows += [rows[5]] * 30  # repeated rows
    rows += [(9, "Alone", "xx", "s", 5, "a", 1, "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = by_hand([r.asDict() for r in df.collect()])
    assert found(df, stride=stride) == want
    if stride == 3:
        for _ in partitions():
            assert found(df) == want


def test_many_trees(spark):
    df = spark.createDataFrame([(k, "A", f"l{k:03}", "s", 1, "", 0, "") for k in range(80)], SCHEMA)
    assert found(df) == by_hand([r.asDict() for r in df.collect()])


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    one = spark.createDataFrame([(None, None, None, None, None, "", 0, "")], SCHEMA)
    ((doc, leaf, subroot, root, proof, folded, verified),) = found(one)
    assert (doc, leaf, subroot, root) == (None, sha("-----"), leaf, leaf)
    assert (proof, folded, verified) == (sha(""), root, True)


def test_one_row_many_times(spark):
    df = spark.createDataFrame([(3, "Same", "en", "s", 4, "", 0, "")], SCHEMA).selectExpr("*", "explode(sequence(1, 10000)) AS again")
    got = found(df)
    assert len(got) == 10_000 and got == by_hand([r.asDict() for r in df.collect()])


def test_paths_fold_to_the_root(spark, docs):
    leaves = docs.selectExpr("cast(doc_id AS string) AS id", "source AS grp", "unhex(sha2(coalesce(text, ''), 256)) AS node")
    rows = merkle.proofs(merkle.build(leaves), paths=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert merkle.fold(bytes.fromhex(r["leaf"]), r["path"]) == r["root"] == r["folded_root"] and r["verified"]
        assert merkle.proof_digest(r["path"]) == r["proof_sha256"]
