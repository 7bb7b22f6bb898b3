"""Merkle manifest of a table: one tree per group, one over the groups; only every few levels are stored."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import running_sums, saved

#: Children of a node.
ARITY = 8
#: Levels from one stored level to the next: a subtree between them has at most ARITY ** STRIDE leaves.
STRIDE = 3


def digest(*parts: bytes) -> bytes:
    """Digests enter as lowercase hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def leaf_hash(columns: list[Column]) -> Column:
    """sha256 over the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def levels_above(nodes: list[bytes], n: int, stride: int) -> list[list[bytes]]:
    """``nodes`` of one aligned subtree and the levels above them, up to the next stored one or the tree's top.

    ``n`` is the whole tree's width at the level of ``nodes``; a tree stops where one node is left.
    """
    levels = [nodes]
    while n > 1 and len(levels) <= stride:
        nodes = [digest(*nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
        levels.append(nodes)
        n = -(-n // ARITY)
    return levels


def siblings(levels: list[list[bytes]], at: int) -> list[str]:
    """Hex of the run's nodes left and right of ``at``, in turn, level by level up to the subtree's top."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % ARITY
        out.append("".join(x.hex() for x in nodes[run:at]))
        out.append("".join(x.hex() for x in nodes[at + 1 : run + ARITY]))
        at //= ARITY
    return out


def fold(node: bytes, path: list[str]) -> str:
    """The root that a leaf and its siblings give, in hex."""
    text = node.hex()
    for left, right in zip(path[::2], path[1::2], strict=True):
        text = hashlib.sha256((left + text + right).encode()).hexdigest()
    return text


def proof_digest(path: list[str]) -> str:
    return hashlib.sha256("".join(path).encode()).hexdigest()


@dataclass
class Manifest:
    """Stored levels, lowest first, of the groups' trees and of the tree over the groups.

    A level holds g (tree), n (the tree's width there), pos and node; a tree ends at the level where n = 1.
    The lowest level of ``groups`` also holds each leaf's id and claim, that of ``top`` each group's name.
    """

    groups: list[DataFrame]
    top: list[DataFrame]
    stride: int


def _block(level: DataFrame, stride: int, *more: str) -> DataFrame:
    """Aligned subtrees of at most ARITY ** stride nodes."""
    return level.select("g", "n", "pos", "node", *more, F.expr(f"pos div {ARITY**stride}").alias("block"))


def _climb(lowest: DataFrame, stride: int, label: str) -> list[DataFrame]:
    """The stored levels over ``lowest``: the top of every aligned subtree, each built in one group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        levels = levels_above(table["node"].to_pylist(), n, stride)
        for _ in levels[1:]:
            n = -(-n // ARITY)
        return pa.table({"g": table["g"][:1], "n": pa.array([n], pa.int64()), "pos": table["block"][:1], "node": pa.array(levels[-1], pa.binary())})

    levels = [lowest]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        above = _block(levels[-1].where("n > 1"), stride).groupBy("g", "block").applyInArrow(run, "g string, n long, pos long, node binary")
        levels.append(saved(above, label))
    return levels


def _ends(levels: list[DataFrame]) -> DataFrame:
    """g, node, at: the top of every tree and the stored level that holds it."""
    out = None
    for k, level in enumerate(levels):
        ends = level.where("n = 1").select("g", "node", F.lit(k).alias("at"))
        out = ends if out is None else out.unionByName(ends)
    return out


def build(leaves: DataFrame, stride: int = STRIDE) -> Manifest:
    """The manifest of ``leaves``: id, grp (string), node (binary) and, if present, claim (see ``proofs``).

    Leaves of a group ascend by id (null first), equal ids by hash; groups ascend bytewise, null first.
    Every ARITY consecutive nodes (fewer in the last run) become one while a tree has more than one.
    Places come from range-sorted prefix counts, so a group of any size spans many tasks. Of the levels
    above the leaves only every ``stride``-th is written. Repeated rows are leaves of their own; without
    leaves the levels are empty.
    """
    claim = F.col("claim") if "claim" in leaves.columns else F.lit(None).cast("binary")
    # The first character tells null from any name; the last key spreads one leaf repeated many times.
    named = leaves.select(
        F.coalesce(F.concat(F.lit("1"), "grp"), F.lit("0")).alias("g"), "id", "node", claim.alias("claim"),
        F.monotonically_increasing_id().alias("_copy"), F.lit(1).alias("_one"),
    )
    placed = running_sums(named, ["g", "id", "node", "_copy"], "_one", "pos", group="g")
    sizes = placed.groupBy("g").agg(F.count("*").alias("n"))
    groups = _climb(saved(placed.join(sizes, "g").select("g", "n", "pos", "node", "id", "claim"), "leaves"), stride, "nodes")
    ends = running_sums(_ends(groups).withColumn("_one", F.lit(1)), ["g"], "_one", "pos")
    top = ends.select(F.lit("").alias("g"), F.lit(ends.count()).cast("long").alias("n"), "pos", "node", F.col("g").alias("name"), "at")
    return Manifest(groups, _climb(saved(top, "subroots"), stride, "nodes"), stride)


def _descend(level: DataFrame, above: DataFrame, stride: int, more: list[str], make, schema: str) -> DataFrame:
    """``make`` for every aligned subtree of a level, with the path (and subroot, root) of the subtree's top."""

    def run(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels = levels_above(table["node"].to_pylist(), table["n"][0].as_py(), stride)
        rest = parent["path"][0].as_py()
        paths = (siblings(levels, k) + rest for k in range(table.num_rows))
        return make(table, paths, parent["subroot"][0].as_py(), parent["root"][0].as_py())

    parents = above.select("g", F.col("pos").alias("block"), "subroot", "root", "path").groupBy("g", "block")
    return _block(level, stride, *more).groupBy("g", "block").cogroup(parents).applyInArrow(run, schema)


def _keep_paths(table: pa.Table, paths, subroot: bytes, root: bytes) -> pa.Table:
    n = table.num_rows
    same = {"subroot": pa.array([subroot] * n, pa.binary()), "root": pa.array([root] * n, pa.binary())}
    return pa.table({"g": table["g"], "pos": table["pos"], **same, "path": pa.array(list(paths), pa.list_(pa.string()))})


PATHS = "g string, pos long, subroot binary, root binary, path array<string>"


def _parents(levels: list[DataFrame], ends: DataFrame, stride: int) -> DataFrame:
    """Paths to hand to the lowest level. ``ends``: g, at, subroot, root and the path from the tree's top on."""
    tops = ends.withColumn("pos", F.lit(0).cast("long"))
    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = tops.where(F.col("at") == k).select("g", "pos", "subroot", "root", "path")
        above = here if above is None else above.unionByName(here)
        if k:
            above = saved(_descend(levels[k], above, stride, [], _keep_paths, PATHS), "paths")
    return above


def proofs(manifest: Manifest, paths: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified (digests in hex) for every leaf.

    Going down from the top, each group of rows rebuilds the interior of one aligned subtree from its
    stored nodes, emits its nodes' siblings and forgets it. ``proof_sha256`` is taken over the siblings
    from the leaf's run up to the root. ``folded_root`` starts from the leaf's ``claim`` where it has
    one, else from the leaf; ``verified`` says whether it is the root. With ``paths`` the siblings are
    returned too, as texts left and right of the node in its run, in turn.
    """
    top = _ends(manifest.top).select(
        "g", "at", F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<string>").alias("path")
    )

    def of_groups(table: pa.Table, found, _: bytes, root: bytes) -> pa.Table:
        roots = pa.array([root] * table.num_rows, pa.binary())
        return pa.table({"g": table["name"], "at": table["at"], "subroot": table["node"], "root": roots, "path": pa.array(list(found), pa.list_(pa.string()))})

    ends = _descend(
        manifest.top[0], _parents(manifest.top, top, manifest.stride), manifest.stride, ["name", "at"], of_groups,
        "g string, at int, subroot binary, root binary, path array<string>",
    )

    def of_leaves(table: pa.Table, found, subroot: bytes, root: bytes) -> pa.Table:
        proof, folded, kept = [], [], []
        for node, claim, path in zip(table["node"].to_pylist(), table["claim"].to_pylist(), found, strict=True):
            proof.append(proof_digest(path))
            folded.append(fold(node if claim is None else claim, path))
            if paths:
                kept.append(path)
        n = table.num_rows
        out = {
            "id": table["id"], "leaf": [x.hex() for x in table["node"].to_pylist()], "subroot": [subroot.hex()] * n,
            "root": [root.hex()] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == root.hex() for x in folded],
        }
        return pa.table(out | ({"path": pa.array(kept, pa.list_(pa.string()))} if paths else {}))

    kind = manifest.groups[0].schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    above = _parents(manifest.groups, saved(ends, "tops"), manifest.stride)
    return _descend(manifest.groups[0], above, manifest.stride, ["id", "claim"], of_leaves, schema + (", path array<string>" if paths else ""))


#: What a document's leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered_proofs(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    One tree per lang, leaves by doc_id. Where 3 divides crc32 of the decimal doc_id, A-Z of the text are
    lower-cased after the manifest was built: such a row proves its altered leaf with the old siblings.
    A null in any column is ``-`` in the leaf (an empty text is ``0:``); a null doc_id is not tampered
    with and comes first in its tree; rows alike are leaves of their own; an empty table gives no rows.
    Columns beyond the five are not read, whatever their names.
    """
    source = [F.col(c) for c in FIELDS]
    lowered = [*source[:-1], F.translate("text", UPPER, UPPER.lower())]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("grp"), leaf_hash(source).alias("node"),
        F.when(hit, leaf_hash(lowered)).alias("claim"),
    )
    return proofs(build(leaves, stride)).withColumnRenamed("id", "doc_id")
