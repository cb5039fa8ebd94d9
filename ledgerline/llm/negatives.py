"""Hard negatives from embeddings: stored angles to reference directions bound scores, only overlapping rows are scored."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.base import case, map_rows, table
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

REFERENCES = 8  # directions to which every row's angle is stored
SAMPLE_ROWS = 2000  # bound of the rows among which the references are chosen; they only guide the pruning
BLOCK_ROWS = 2048  # rows of a block (about)
ANCHOR_BLOCKS = 16  # row blocks whose anchors are searched together
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
SLACK = 1e-6  # radians; beyond the rounding of a stored angle
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = 2.0**53  # up to here sums of whole doubles are exact


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, q (bigints) of the rows that take part, one per id.

    Out: a null id, label or vector, a null, NaN or infinite component. Of rows of one id
    the one with the least label, then vector, takes part. Whole parts beyond a long count as its limit.
    """
    own = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull()).filter(finite)
    whole = F.transform("_v", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    one = own.select("vec_id", F.struct("label", whole.alias("q")).alias("_row")).groupBy("vec_id").agg(F.min("_row").alias("_row"))
    return one.select("vec_id", "_row.label", "_row.q")


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers; shorter ones end in zeros, longer ones are cut."""
    if all(len(v) == width for v in vectors):
        return np.array(vectors).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), vectors[0].dtype)
    for row, v in zip(out, vectors):
        row[: min(len(v), width)] = v[:width]
    return out


def choose_references(sample: list[list[int]], n: int = REFERENCES) -> list[list[float]]:
    """Unit vectors of the sample that lie far from each other: each next one has the greatest angle to the nearest so far."""
    vectors = [np.array(v, float) for v in sample if any(v)]
    if not vectors:
        return []
    m = matrix(vectors, max(map(len, vectors)))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    taken, nearest = [0], m @ m[0]
    while len(taken) < min(n, len(m)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, m @ m[taken[-1]])
    return m[taken].tolist()


def _measured(rows: DataFrame, references: list[list[float]]) -> DataFrame:
    """The rows with norm, angles (to each reference) and cell (the nearest reference; 0 of a zero vector)."""

    def measure():
        directions = [np.array(r) for r in references]

        def work(batch):
            vectors = [np.array(v, float) for v in batch.column(2).to_pylist()]
            norms = [float(np.sqrt(v @ v)) for v in vectors]
            width = max([len(d) for d in directions], default=0)
            m, d = matrix(vectors, width), matrix(directions, width) if directions else np.zeros((0, 0))
            safe = np.maximum(np.array(norms), 1e-300)[:, None]
            angles = np.arccos(np.clip((m / safe) @ d.T, -1.0, 1.0))
            cells = angles.argmin(axis=1) if len(directions) else np.zeros(len(vectors), int)
            same = {"vec_id": batch.column(0), "label": batch.column(1), "q": batch.column(2)}
            yield same | {"norm": norms, "angles": list(angles), "cell": cells.astype(np.int32)}

        return work

    return map_rows(rows, measure, "vec_id bigint, label bigint, q array<bigint>, norm double, angles array<double>, cell int")


def store(rows: DataFrame, n_references: int = REFERENCES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, label, q, norm, angles, block: written once. Blocks split each cell by a hash of the id, by its measured size."""
    rows = materialize(rows)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("q").limit(SAMPLE_ROWS)
    measured = materialize(_measured(rows, choose_references([r.q for r in sample.collect()], n_references)))
    cells = {r["cell"]: r["count"] for r in measured.groupBy("cell").count().collect()}  # one row per reference
    first, parts, at = {}, {}, 0
    for cell, n in sorted(cells.items()):
        first[cell], parts[cell] = at, -(-n // block_rows)
        at += parts[cell]
    of_cell = lambda values: F.create_map(*[F.lit(v) for pair in (values or {0: 1}).items() for v in pair])[F.col("cell")]
    block = of_cell(first) + F.pmod(F.xxhash64("vec_id"), of_cell(parts)).cast("int")
    return measured.withColumn("block", block).drop("cell")


def _extent(rows: DataFrame, block: str, *more: Column) -> DataFrame:
    """Per block the least and greatest norm and angles."""
    at = F.posexplode("angles").alias("r", "angle")
    angles = rows.select(block, at).groupBy(block, "r").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    angles = angles.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("r", "low", "high"))).alias("around"))
    norms = rows.groupBy(block).agg(F.min("norm").alias("short"), F.max("norm").alias("long"), *more)
    return norms.join(angles, block, "left").withColumn("around", F.coalesce("around", F.array().cast("array<struct<r:int,low:double,high:double>>")))


def _score_bounds(low: Column, high: Column, shortest: Column, longest: Column) -> tuple[Column, Column]:
    """Least and greatest score of vectors at an angle in [low, high] whose norms' product lies in [shortest, longest]."""
    near = F.cos(F.greatest(F.lit(0.0), low - SLACK))
    far = F.cos(F.least(F.lit(np.pi), high + SLACK))
    slack = longest * 1e-9 + 1
    return (
        F.when(far < 0, far * longest).otherwise(far * shortest) - slack,
        F.when(near > 0, near * longest).otherwise(near * shortest) + slack,
    )


def _pairs(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """anchor_block, block, home of the pairs of blocks in which some score may lie between the least and the greatest bound asked."""
    lows = F.expr("array_min(transform(windows, w -> w.low))")
    highs = F.expr("array_max(transform(windows, w -> w.high))")
    anchors = _extent(asked, "anchor_block", F.min(lows).alias("least"), F.max(highs).alias("most")).withColumnRenamed("around", "mine")
    blocks = _extent(stored, "block").select("block", F.col("short").alias("s"), F.col("long").alias("l"), F.col("around").alias("theirs"))
    n = stored.agg(F.max("block")).first()[0]
    every = F.explode(F.sequence(F.lit(0), F.lit(0 if n is None else n))).alias("block")
    met = anchors.select("*", every).join(blocks, "block")
    apart = F.zip_with("mine", "theirs", lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"], F.lit(0.0)))
    away = F.zip_with("mine", "theirs", lambda a, b: a["high"] + b["high"])
    low, high = F.coalesce(F.array_max(apart), F.lit(0.0)), F.coalesce(F.array_min(away), F.lit(np.pi))
    least, most = _score_bounds(low, high, F.col("short") * F.col("s"), F.col("long") * F.col("l"))
    met = met.withColumn("_from", least).withColumn("_to", most)
    overlap = (F.col("_to") >= F.col("least")) & (F.col("_from") <= F.col("most"))
    return met.filter(overlap).select("anchor_block", "block")


def scores_of(q: np.ndarray, anchor: np.ndarray) -> np.ndarray | list[int]:
    """Exact inner products: in doubles while these are exact, else in unbounded whole numbers cut to a long."""
    width = min(q.shape[1], len(anchor))
    a, b = q[:, :width], anchor[:width]
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(width, 1)
    if bound < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(row, b)) for row in a]
    return np.array([min(max(s, LEAST), MOST) for s in whole], np.int64)


def search_blocks(anchors: dict, rows: dict, same_label: bool, k: int) -> list[tuple[int, int, int, int]]:
    """(anchor_id, window, vec_id, score) of the first ``k`` rows of the block in each anchor's windows.

    The angle of two vectors lies between the difference and the sum of their angles to any
    reference; times the norms this bounds the score. Rows whose bounds meet no window are not scored.
    """
    out = []
    for anchor, label, q, norm, angles, windows in zip(*[anchors[c] for c in ("vec_id", "label", "q", "norm", "angles", "windows")]):
        fit = ((rows["label"] == label) == same_label) & (rows["vec_id"] != anchor)
        if len(angles):
            apart = np.maximum(np.abs(rows["angles"] - angles).max(axis=1) - SLACK, 0.0)
            away = np.minimum((rows["angles"] + angles).min(axis=1) + SLACK, np.pi)
        else:
            apart, away = np.zeros(len(fit)), np.full(len(fit), np.pi)
        product = rows["norm"] * norm
        slack = product * 1e-9 + 1
        greatest, least = product * np.cos(apart) + slack, product * np.cos(away) - slack
        meets = [fit & (greatest >= w["low"]) & (least <= w["high"]) for w in windows]
        chosen = np.flatnonzero(np.logical_or.reduce(meets))
        if not len(chosen):
            continue
        scores, ids = scores_of(rows["q"][chosen], q), rows["vec_id"][chosen]
        order = np.lexsort((ids, ~scores))  # ~ turns the order and cannot overflow
        scores, ids = scores[order], ids[order]
        for w in windows:
            inside = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))[:k]
            out += [(anchor, w["name"], i, s) for i, s in zip(ids[inside].tolist(), scores[inside].tolist())]
    return out


def _searched(asked: DataFrame, stored: DataFrame, pairs: DataFrame, same_label: bool, k: int) -> DataFrame:
    """anchor_id, name, vec_id, score: per pair of blocks the first ``k`` rows in each window; a group holds two blocks."""
    columns = ["vec_id", "label", "q", "norm", "angles"]

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        def taken(t: pa.Table) -> dict:
            q = [np.array(v, np.int64) for v in t.column("q").to_pylist()]
            return {
                "vec_id": t.column("vec_id").to_numpy(), "label": t.column("label").to_numpy(), "norm": t.column("norm").to_numpy(),
                "q": q, "angles": np.array(t.column("angles").to_pylist(), float).reshape(len(q), -1),
            }

        found = []
        if mine.num_rows and theirs.num_rows:
            anchors, rows = taken(mine), taken(theirs)
            anchors["vec_id"], anchors["windows"] = anchors["vec_id"].tolist(), mine.column("windows").to_pylist()
            rows["q"] = matrix(rows["q"], max(map(len, rows["q"])))
            found = search_blocks(anchors, rows, same_label, k)
        parts = list(zip(*found)) or [()] * 4
        return pa.table({n: pa.array(p, pa.int64()) for n, p in zip(("anchor_id", "name", "vec_id", "score"), parts)})

    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  (both sides stem from one table)
    key = ["anchor_block", "block"]
    mine = asked.join(pairs, "anchor_block").select(*own(*key, "windows", *columns))
    theirs = stored.select("block", *columns).join(pairs, "block").select(*own(*key, *columns))
    return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(search, "anchor_id bigint, name bigint, vec_id bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "name").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_in_windows(anchors: DataFrame, stored: DataFrame, same_label: bool, k: int) -> DataFrame:
    """anchor_id, name, vec_id, score, rank: for every window of every anchor its first ``k`` rows by score, then id.

    ``anchors`` are stored rows with anchor_block and windows (name, low, high of scores, both included). First
    the anchors meet one block of their own neighbourhood; the k-th score found there raises each window's low end, which
    prunes the other pairs of blocks and the rows in them. Nothing that can be among the first is left out.
    """
    home = materialize(anchors.select("anchor_block", "block").groupBy("anchor_block").agg(F.mode("block", deterministic=True).alias("block")))
    found = materialize(_first(_searched(anchors.drop("block"), stored, home, same_label, k), k))
    raised = found.filter(F.col("rank") == k).select(F.col("anchor_id").alias("vec_id"), "name", F.col("score").alias("_low"))
    window = anchors.select("vec_id", F.inline("windows")).join(raised, ["vec_id", "name"], "left")
    window = window.groupBy("vec_id").agg(
        F.collect_list(F.struct("name", F.coalesce("_low", "low").alias("low"), "high")).alias("windows")
    )
    asked = materialize(anchors.drop("block", "windows").join(window, "vec_id"))
    pairs = materialize(_pairs(asked, stored).join(home, ["anchor_block", "block"], "left_anti"))
    rest = _searched(asked, stored, pairs, same_label, k)
    return _first(found.drop("rank").unionByName(rest), k)


def hard_negatives(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_rows: int = BLOCK_ROWS,
    n_references: int = REFERENCES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); a score is the exact inner product, of vectors of different length over the
    common part. Anchors are the rows whose id ``every`` divides. Their positives are the first rows of their label, by
    score and then id; the negatives of each are the first rows of other labels whose score lies between 0.3 and
    0.9 of the positive's (none if that is negative). Rows without id, label or vector, or with a component that is null
    or not finite, take no part; of rows of one id one does. Scores beyond a long count as its limit.
    An empty table gives no row. Every row is searched; angles to references only spare scoring.
    """
    stored = store(usable(rows, vec_id, vector, label), n_references, block_rows)
    anchors = stored.filter(F.col("vec_id") % every == 0)
    anchors = anchors.withColumn("anchor_block", F.floor(F.col("block") / ANCHOR_BLOCKS).cast("int"))
    window = lambda name, low, high: F.struct(name.alias("name"), low.alias("low"), high.alias("high"))
    whole = window(F.lit(0).cast("bigint"), F.lit(LEAST).cast("bigint"), F.lit(MOST).cast("bigint"))
    best = first_in_windows(materialize(anchors.withColumn("windows", F.array(whole))), stored, True, positives)
    best = materialize(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    tens, ones = F.expr("positive_score div 10"), F.col("positive_score") % 10
    low = tens * 3 + F.ceil(ones * 3 / 10)  # 30 p <= 100 n <= 90 p, without large products
    high = tens * 9 + F.floor(ones * 9 / 10)
    windows = best.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"))
    windows = windows.agg(F.collect_list(window(F.col("positive_id"), low, high)).alias("windows"))
    found = first_in_windows(materialize(anchors.join(windows, "vec_id")), stored, False, negatives)
    found = found.select("anchor_id", F.col("name").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(best, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH whole AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@case("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row; the label of every seventh is shifted by one first."""
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted))
