"""Fuzzy joins of names inside blocks, without emitting all pairs of a block."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.similarity import char_signature, may_reach, ratio_at_most, similarity
from ledgerline.functions.text import fraction, normalise_name, squash
from ledgerline.storage import materialize


_EPS = 1e-9
SPLIT_ROWS = 2000  # names that share a key and are joined by one task


def _spoiled(threshold: float) -> tuple[float, float]:
    """Pairs of neighbouring characters, per character of the shorter and of the longer name, that need not be common.

    A deletion spoils two pairs of the shorter name and an insertion one. Both bounds are linear in the gap of
    the lengths, so they are largest at equal lengths or at the widest gap.
    """
    t = threshold
    return max(3 * (1 - t), 2 * (1 - t) / t), max(3 * (1 - t), 4 * (1 - t) / (2 - t))


def _gram_length(threshold: float) -> int | None:
    """From which length on a name keeps a pair of characters that its edits cannot spoil; None if never."""
    share = _spoiled(threshold)[0]
    if share >= 1:
        return None
    last = int(2 / (1 - share)) + 2
    return max((n for n in range(1, last + 1) if n - 1 < int(share * n + _EPS) + 1), default=0) + 1


def _tokens(name: Column) -> Column:
    """(kind, text, occurrence) of all characters (kind 1) and pairs of neighbouring characters (kind 2) of a name."""

    def of_size(size: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(name, i, size))
        parts = F.when(F.length(name) >= size, parts).otherwise(F.array().cast("array<string>"))
        earlier = lambda t, i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda u: u == t))
        return F.transform(parts, lambda t, i: F.struct(F.lit(size).alias("kind"), t.alias("text"), earlier(t, i).alias("nth")))

    return F.concat(of_size(1), of_size(2))


def rarest_tokens(names: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """(block, name, bits, kind, keys): the tokens of each distinct name as hashes, the rarest of all names first, and its signature.

    Written once: the order must be the same on both sides of a join. Kinds that no pair of
    the name needs are left out.
    """
    grams = _gram_length(threshold)
    length = F.length("name")
    reach = (2 - threshold) / threshold
    needs_chars = F.lit(True) if grams is None else length <= F.lit(int((grams - 1) * reach + _EPS))
    needs_grams = F.lit(False) if grams is None else length >= grams
    tokens = names.select(*block, "name", F.inline(_tokens(F.col("name"))))
    tokens = tokens.filter(F.when(F.col("kind") == 1, needs_chars).otherwise(needs_grams))
    seen = tokens.groupBy("kind", "text").agg(F.count("*").alias("_seen"))
    rare_first = F.array_sort(F.collect_list(F.struct("_seen", "text", "nth")))  # at most the length of a name
    sorted_ = tokens.join(seen, ["kind", "text"]).groupBy(*block, "name", "kind").agg(rare_first.alias("_sorted"))
    keys = F.transform("_sorted", lambda t: F.xxhash64(F.col("kind"), t["text"], t["nth"]))
    return materialize(sorted_.select(*block, "name", char_signature("name").alias("bits"), "kind", keys.alias("keys")))


def _keys(tokens: DataFrame, block: Sequence[str], threshold: float, short_side: bool, name: str) -> DataFrame:
    """(block, name, its signature, _key): so many of the rarest tokens that any pair within its edit budget shares one.

    Long names use pairs of neighbouring characters, of which all but the spoiled ones are common; the
    others characters, of which t (s + l) / 2 are common. Two sets that share c tokens share one
    among the first size - c + 1 of each. No name has more than about one key per character and side.
    """
    grams, n = _gram_length(threshold), F.length("name")
    shortest = F.ceil(n * threshold / (2 - threshold) - _EPS)
    if short_side:
        chars = n - F.ceil(n * threshold - _EPS) + 1
        pairs = F.floor(n * _spoiled(threshold)[0] + _EPS) + 1
        wanted = F.col("kind") == (F.lit(1) if grams is None else F.when(n >= grams, 2).otherwise(1))
    else:
        chars = n - F.ceil((shortest + n) * (threshold / 2) - _EPS) + 1
        pairs = F.floor(n * _spoiled(threshold)[1] + _EPS) + 1
        wanted = F.lit(True)
    many = F.when(F.col("kind") == 1, chars).otherwise(pairs).cast("int")
    bits = F.col("bits").alias(f"_bits_{name}")
    return tokens.filter(wanted).select(*block, F.col("name").alias(name), bits, F.explode(F.slice("keys", F.lit(1), many)).alias("_key"))


def _meet(short: DataFrame, long: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """Pairs (block, s, l) that share a key and may reach the threshold: by their characters, then by edits.

    Keys of many names are dealt to several tasks.
    """
    on = [*block, "_key"]
    hot = long.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > SPLIT_ROWS)
    hot = materialize(hot.select(*on, F.ceil(F.col("_n") / SPLIT_ROWS).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = short.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    right = long.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64("l"), parts).cast("int")).drop("_parts")
    lengths = F.length("s"), F.length("l")
    alike = ratio_at_most(F.col("_bits_s"), lengths[0], F.col("_bits_l"), lengths[1]) >= threshold
    met = left.join(right, [*on, "_salt"]).filter((lengths[0] <= lengths[1]) & alike & may_reach(F.col("s"), F.col("l"), threshold))
    return met.select(*block, "s", "l").distinct()


def similar_pairs(
    names: DataFrame,
    block: Sequence[str],
    name: str,
    threshold: float,
    method: str = "indel",
) -> DataFrame:
    """All pairs of distinct names of one block with similarity >= threshold.

    Returns block columns, ``name_a`` < ``name_b`` and ``similarity``. Pairs
    meet on shared rare tokens (exact, no pair is lost) and are bounded by edit
    distance inside the join, before anything is written. Rows without a value in a block column pair with none.
    """
    limit = fraction(threshold)
    if not 0.0 < limit <= 1.0:
        raise ValueError("threshold must be above 0")
    distinct = names.select(*block, F.col(name).alias("name")).filter("name <> ''").distinct()
    tokens = rarest_tokens(distinct, block, limit)
    short, long = _keys(tokens, block, limit, True, "s"), _keys(tokens, block, limit, False, "l")
    pairs = _meet(short, long, block, limit).filter("s <> l")
    pairs = pairs.select(*block, F.least("s", "l").alias("name_a"), F.greatest("s", "l").alias("name_b")).distinct()
    # one score per distinct surviving pair
    scored = pairs.withColumn("similarity", similarity("name_a", "name_b", method))
    return scored.filter(F.col("similarity") * 100.0 >= limit * 100.0)


def closest_to(
    candidates: DataFrame,
    candidate: str,
    position: str,
    expected: str,
    threshold: float = 0.65,
    method: str = "difflib",
    clean: Callable[[Column], Column] = squash,
) -> DataFrame:
    """J8 for one expected name: one row with ``matched`` (null below the threshold) and the best ``score``.

    One scan scores every distinct candidate once; the first one in
    ``position`` order wins ties.
    """
    limit = fraction(threshold)
    names = candidates.filter(F.col(candidate).isNotNull()).groupBy(candidate)
    names = names.agg(F.min(position).alias("_pos"))
    scored = names.withColumn("_score", similarity(clean(F.col(candidate)), clean(F.lit(expected)), method))
    best = scored.agg(
        F.min(F.struct((-F.col("_score")).alias("s"), "_pos", F.col(candidate).alias("n"))).alias("b")
    )
    score = F.coalesce(-F.col("b.s"), F.lit(0.0))
    return best.select(
        F.lit(expected).alias("expected"), F.when(score >= limit, F.col("b.n")).alias("matched"), score.alias("score")
    )


def best_match(
    left: DataFrame,
    candidates: DataFrame,
    block: Sequence[str],
    name: str,
    candidate: str,
    position: str,
    threshold: float,
    method: str = "indel",
    clean: Callable[[Column], Column] = normalise_name,
) -> DataFrame:
    """For each distinct (block, name) the most similar candidate of its block.

    The first candidate in ``position`` order wins ties. Returns block, name,
    ``matched`` (null below the threshold) and ``score`` (best score among the
    candidates that can reach the threshold, else null). Candidates meet on
    shared tokens as in ``similar_pairs``: below the threshold there is
    nothing to report, so nothing is paired.
    """
    limit = fraction(threshold)
    wanted = left.select(*block, name).distinct().withColumn("_w", clean(F.col(name)))
    offered = candidates.select(*block, F.col(candidate).alias("_cand"), F.col(position).alias("_pos"))
    offered = offered.withColumn("_c", clean(F.col("_cand")))
    offered_keys = offered.select(*block, "_c").filter("_c <> ''").distinct()
    wanted_keys = wanted.select(*block, "_w").filter("_w <> ''").distinct()

    both = wanted_keys.withColumnRenamed("_w", "name").unionByName(offered_keys.withColumnRenamed("_c", "name")).distinct()
    tokens = rarest_tokens(both, block, limit)
    mine = tokens.join(wanted_keys.withColumnRenamed("_w", "name"), [*block, "name"], "left_semi")
    theirs = tokens.join(offered_keys.withColumnRenamed("_c", "name"), [*block, "name"], "left_semi")
    short = _meet(_keys(mine, block, limit, True, "s"), _keys(theirs, block, limit, False, "l"), block, limit)
    long = _meet(_keys(theirs, block, limit, True, "s"), _keys(mine, block, limit, False, "l"), block, limit)
    pairs = short.select(*block, F.col("s").alias("_w"), F.col("l").alias("_c"))
    pairs = pairs.unionByName(long.select(*block, F.col("l").alias("_w"), F.col("s").alias("_c"))).distinct()
    pairs = pairs.withColumn("score", similarity("_w", "_c", method))
    pairs = pairs.filter(F.col("score") * 100.0 >= limit * 100.0)
    ranked = pairs.join(offered, [*block, "_c"]).groupBy(*block, "_w")
    best = ranked.agg(F.min(F.struct((-F.col("score")).alias("s"), "_pos", "_cand")).alias("_best"))
    best = best.select(*block, "_w", F.col("_best._cand").alias("matched"), (-F.col("_best.s")).alias("score"))
    return wanted.join(best, [*block, "_w"], "left").select(*block, name, "matched", "score")
