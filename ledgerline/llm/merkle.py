"""Merkle manifest of a dataset: a digest tree per source, proofs and their folding, superblock by superblock."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, remainder, table
from ledgerline.operators.ordering import BLOCK, ROW, order_rows
from ledgerline.operators.skew import attach
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

FANOUT = 16  # nodes of a run
LOCAL_LEVELS = 2  # a superblock holds FANOUT ** LOCAL_LEVELS leaves: what a task reads of one group
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 (32 bytes) of the values one after the other, each `-` if null, else its UTF-8 length, `:` and itself."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*[told(c) for c in columns]).cast("binary"), 256))


def _digest(hexes: str) -> str:
    return hashlib.sha256(hexes.encode("ascii")).hexdigest()


def _levels(n: Column) -> Column:
    """Nodes that a level of ``n`` nodes becomes; a single one stays."""
    return F.when(n > 1, F.floor((n + FANOUT - 1) / FANOUT)).otherwise(n)


def _runs(nodes: DataFrame) -> DataFrame:
    """tree, p, n, hashes of each run of up to FANOUT nodes of the trees that still have several."""
    own = nodes.filter("n > 1").withColumn("p", F.floor(F.col("i") / FANOUT))
    run = F.array_sort(F.collect_list(F.struct("i", "h")))
    return own.groupBy("tree", "p").agg(F.first("n").alias("n"), run.getField("h").alias("hashes"))


def _parents(runs: DataFrame) -> DataFrame:
    h = F.sha2(F.array_join("hashes", "").cast("binary"), 256)
    return runs.select("tree", F.col("p").alias("i"), _levels(F.col("n")).alias("n"), h.alias("h"))


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of each level upwards, and the single nodes in which trees end at each level (also before the first run)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, ends = [], [nodes.filter("n = 1")]
    while most > 1:
        levels.append(materialize(_runs(nodes)))
        nodes = _parents(levels[-1])
        ends.append(nodes.filter("n = 1"))
        most = -(-most // FANOUT)
    return levels, ends


def _paths_down(levels: list[DataFrame], ends: list[DataFrame], of_end: DataFrame, keep: Sequence[str]) -> DataFrame:
    """tree, i, path and the ``keep`` columns of the lowest nodes: siblings from the node's own level up to the root.

    ``of_end`` has tree, path and the kept columns of the node in which each tree ends.
    """
    found = ends[-1].select("tree", "i").join(of_end, "tree")
    for runs, end in zip(reversed(levels), reversed(ends[:-1])):
        above = found.select("tree", F.col("i").alias("p"), F.col("path").alias("_up"), *keep)
        at = runs.join(above, ["tree", "p"]).select("*", F.posexplode("hashes").alias("k", "_h"))
        siblings = F.struct(
            F.array_join(F.slice("hashes", 1, F.col("k")), "").alias("before"),
            F.array_join(F.slice("hashes", F.col("k") + 2, FANOUT), "").alias("after"),
        )
        below = at.select("tree", (F.col("p") * FANOUT + F.col("k")).alias("i"), F.concat(F.array(siblings), "_up").alias("path"), *keep)
        found = below.unionByName(end.select("tree", "i").join(of_end, "tree"))
    return found


def finish_superblock(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Digest tree of one superblock, and of each of its leaves the proof and the root that its tampered form folds to.

    ``leaves`` has doc_id, i, n (leaves of its tree), leaf and tampered (or null); ``outer`` the one row of
    what lies above: path, subroot, root.
    """
    leaves = leaves.sort_values("i", kind="stable")
    above = [(step["before"], step["after"]) for step in outer["path"].iloc[0]]
    subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
    level, n, inner = [b.hex() for b in leaves["leaf"]], int(leaves["n"].iloc[0]), []
    while n > 1 and len(inner) < LOCAL_LEVELS:
        inner.append(level)
        level = [_digest("".join(level[j : j + FANOUT])) for j in range(0, len(level), FANOUT)]
        n = -(-n // FANOUT)
    outside = "".join(before + after for before, after in above)
    folds: dict[str, str] = {}

    def fold_outside(node: str) -> str:
        if node not in folds:
            up = node
            for before, after in above:
                up = _digest(before + up + after)
            folds[node] = up
        return folds[node]

    own, proofs, folded = [b.hex() for b in leaves["leaf"]], [], []
    for k, (leaf, tampered) in enumerate(zip(own, leaves["tampered"])):
        node, at, siblings = leaf if tampered is None else tampered.hex(), k, []
        for nodes in inner:
            first, place = at - at % FANOUT, at % FANOUT
            before, after = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])
            siblings += [before, after]
            node, at = _digest(before + node + after), at // FANOUT
        proofs.append(_digest("".join(siblings) + outside))
        folded.append(fold_outside(node))
    return pd.DataFrame(
        {"doc_id": leaves["doc_id"].array, "leaf": own, "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded}
    )


def merkle_proofs(leaves: DataFrame, tree: str = "tree_key", doc_id: str = "doc_id", leaf: str = "leaf", tampered: str = "tampered") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``leaves`` has a digest (32 bytes) per row, the one to verify instead (or null) and the key of its
    tree, not null. In a tree rows ascend by id (null first), equal ids by digest; runs of FANOUT nodes
    become one until one is left. The ends of the trees, by key, are the leaves of the last tree.
    Rows are numbered by a distributed sort, so a tree of any weight is cut into superblocks of
    FANOUT ** LOCAL_LEVELS leaves. They are first reduced to their outer nodes, which grow to the roots by one small
    table a level; then each superblock meets the siblings above it and is finished in one group.
    Repeated rows are leaves of their own; an empty table gives no row.
    """
    narrow = leaves.select(F.col(tree).alias("key"), F.col(doc_id).alias("doc_id"), F.col(leaf).alias("leaf"), F.col(tampered).alias("tampered"))
    ordered = order_rows(materialize(narrow), ["key", "doc_id", "leaf", "tampered"])
    trees = ordered.groupBy("key").agg(F.min(ROW).alias("first"), F.count("*").alias("n"))
    trees = materialize(order_rows(trees, ["key"]).select("key", "first", "n", F.col(ROW).alias("tree")))
    of_block = FANOUT**LOCAL_LEVELS
    placed = attach(ordered, trees, ["key"], BLOCK).withColumn("i", F.col(ROW) - F.col("first"))
    placed = placed.select("tree", F.floor(F.col("i") / of_block).alias("block"), "i", "n", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered")  # text: pandas has no whole numbers with nulls

    # the exchange on (tree, block) serves every level of the local reduction
    local = placed.select("tree", "block", "i", "n", F.lower(F.hex("leaf")).alias("h")).repartition("tree", "block")
    for _ in range(LOCAL_LEVELS):
        run = F.array_sort(F.collect_list(F.struct("i", "h"))).getField("h")
        up = local.groupBy("tree", "block", F.floor(F.col("i") / FANOUT).alias("p")).agg(F.first("n").alias("n"), run.alias("hashes"))
        h = F.when(F.col("n") > 1, F.sha2(F.array_join("hashes", "").cast("binary"), 256)).otherwise(F.get("hashes", F.lit(0)))
        local = up.select("tree", "block", F.col("p").alias("i"), _levels(F.col("n")).alias("n"), h.alias("h"))
    outer = materialize(local.select("tree", F.col("block").alias("i"), "n", "h"))

    levels, ends = _grown(outer)
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.unionByName(end)
    subroots = materialize(subroots.select(F.col("tree").alias("i"), "h"))
    n_trees = subroots.count()
    last = subroots.select(F.lit(-1).cast("bigint").alias("tree"), "i", F.lit(n_trees).cast("bigint").alias("n"), "h")
    top_levels, top_ends = _grown(last)
    top = top_ends[-1].select("tree", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("h").alias("root"))
    of_tree = _paths_down(top_levels, top_ends, top, ["root"]).select("i", "path", "root")
    of_tree = of_tree.join(subroots, "i").select(F.col("i").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    above = _paths_down(levels, ends, materialize(of_tree), ["subroot", "root"])

    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    meeting = placed.groupBy("tree", "block").cogroup(above.withColumnRenamed("i", "block").groupBy("tree", "block"))
    found = meeting.applyInPandas(finish_superblock, out).withColumn("doc_id", F.col("doc_id").cast(leaves.schema[doc_id].dataType))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree_key, doc_id, leaf, tampered of every row of a table like ``documents``.

    The key orders a null source first and others bytewise. Tampering lower-cases A-Z of the text where 5 divides
    the crc32 of the id; a null id or text stays as it is.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.translate("text", UPPER, LOWER)
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree_key"),
        "doc_id",
        leaf_digest([*fields, F.col("text")]).alias("leaf"),
        F.when(remainder("doc_id", 5) == 0, leaf_digest([*fields, changed])).alias("tampered"),
    )


# crc32 of the id bit by bit: -1 stands for one step of the register, other numbers are bytes that enter it
SQL = """
WITH RECURSIVE d AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(
            [[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(doc_id::VARCHAR, '')])),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 5 = 0 AS marked,
        COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
            || COALESCE(strlen(lang) || ':' || lang, '-') || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS changed
    FROM documents
), hashed AS (
    SELECT doc_id, source, sha256(head || COALESCE(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN marked THEN sha256(head || COALESCE(strlen(changed) || ':' || changed, '-')) END AS tampered
    FROM d
), leaves AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
    FROM hashed
), nodes AS (
    SELECT 0 AS level, tree, i, n, leaf AS h FROM leaves
    UNION ALL
    SELECT level + 1, tree, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, tree, i // 16
), subroots AS MATERIALIZED (
    SELECT tree, h FROM nodes WHERE n = 1
), top AS (
    SELECT 0 AS level, -1::BIGINT AS tree, tree AS i, count(*) OVER () AS n, h FROM subroots
    UNION ALL
    SELECT level + 1, tree, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, tree, i // 16
), every AS MATERIALIZED (
    SELECT * FROM nodes UNION ALL SELECT * FROM top
), siblings AS MATERIALIZED (
    SELECT a.level, a.tree, a.i, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
        COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
    FROM every a JOIN every b ON a.level = b.level AND a.tree = b.tree AND a.i // 16 = b.i // 16
    WHERE a.n > 1 GROUP BY a.level, a.tree, a.i
), climbed AS (
    SELECT tree AS of, i AS leaf_no, 0 AS level, tree, i, COALESCE(tampered, leaf) AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT c.of, c.leaf_no, c.level + 1, c.tree, c.i // 16, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
    FROM climbed c JOIN siblings s ON c.level = s.level AND c.tree = s.tree AND c.i = s.i
), at_top AS (
    SELECT of, leaf_no, 0 AS level, -1::BIGINT AS tree, of AS i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climbed GROUP BY of, leaf_no
    UNION ALL
    SELECT c.of, c.leaf_no, c.level + 1, c.tree, c.i // 16, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
    FROM at_top c JOIN siblings s ON c.level = s.level AND c.tree = s.tree AND c.i = s.i
), ended AS (
    SELECT of, leaf_no, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM at_top GROUP BY of, leaf_no
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN ended e ON e.of = l.tree AND e.leaf_no = l.i JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""


@case("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return merkle_proofs(document_leaves(table(spark, sf_dir, "documents")))
