"""Stable ranks, hash splits, round robin, the greedy balanced sample, quotas and rotations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.numbers import hash_share


def holdout(key: Column, salt: str, parts: int = 5) -> Column:
    """eval for one part in `parts`, by the key's hash."""
    return F.when(hash_share(F.concat(F.lit(salt), key)) % parts == 0, "eval").otherwise("train")


def stable_rank(seed: str, space: str, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.lit(space), key), 256)


def round_robin(rows: DataFrame, pool: str, order: list[Column | str], limit: int, keys: list[str]) -> DataFrame:
    """Rows of the pools of each key in turn: first of every pool, then second, until `limit`."""
    turn = F.row_number().over(W.Window.partitionBy(*keys, pool).orderBy(*order))
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy("_turn", pool))
    return rows.withColumn("_turn", turn).withColumn("place", place).where(F.col("place") <= limit).drop("_turn")


def guarded_holdout(rows: DataFrame, key: str, salt: str, order: list[str], parts: int = 5) -> DataFrame:
    """With `split`: eval for one part in `parts` by the key's hash; where that takes no row, the last one in `order`."""
    drawn = rows.withColumn("split", holdout(F.col(key), salt, parts))
    # one row, whatever the table
    state = drawn.agg(F.sum((F.col("split") == "eval").cast("int")).alias("_e"), F.max(F.struct(*order)).alias("_last"))
    last = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_last.{c}")) for c in order])
    return drawn.join(F.broadcast(state)).withColumn("split", F.when((F.col("_e") == 0) & last, "eval").otherwise(F.col("split"))).drop("_e", "_last")


def rotated(rows: DataFrame, keys: list[str], pos: str, offset: str, n: int) -> DataFrame:
    """With `place`: the rows of each key in the order of `pos`, beginning at the key's `offset` modulo n."""
    turn = F.pmod(F.col(pos) - F.col(offset), F.lit(n))
    return rows.withColumn("place", F.row_number().over(W.Window.partitionBy(*keys).orderBy(turn)))


def quotas(rows: DataFrame, group: str, wanted: dict[str, int], strata: list[str], key: str, seed: str = "") -> DataFrame:
    """A balanced sample of each group of the size wanted; a group with fewer rows is an error that says by how many."""
    have = {r[group]: r["n"] for r in rows.where(F.col(group).isin(*wanted)).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as quotas
    short = {g: n - have.get(g, 0) for g, n in wanted.items() if have.get(g, 0) < n}
    if short:
        raise ValueError("short by " + ", ".join(f"{n} of {g}" for g, n in sorted(short.items())))
    samples = [balanced_sample(rows.where(F.col(group) == g), [group], strata, key, n, seed, f"quota-{g}") for g, n in sorted(wanted.items())]
    return reduce(DataFrame.unionByName, samples)


def halves(n: int) -> dict[str, int]:
    """Quotas of answers and refusals: one more answer if n is odd."""
    return {"OK": n // 2 + n % 2, "REFUSAL": n // 2}


def reserve(rows: DataFrame, group: str, wanted: dict[str, int], strata: list[str], key: str, fits, seed: str = "", salts: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(reserved, others): a balanced sample of each group whose removal leaves rows for which `fits` holds; salts are tried in turn."""
    for salt in range(salts):
        taken = quotas(rows, group, wanted, strata, key, f"{seed}|{salt}")
        left = rows.join(taken.select(key), key, "left_anti")
        if fits(left):
            return taken, left
    raise ValueError("no reservation leaves enough rows")


def block_sample(rows: DataFrame, strata: str, each: int, seed: str, key: str) -> DataFrame:
    """The first `each` rows of each stratum by stable rank (a secondary sample, one block a stratum)."""
    place = F.row_number().over(W.Window.partitionBy(strata).orderBy(stable_rank(seed, strata, F.col(key).cast("string")), key))
    return rows.withColumn("place", place).where(F.col("place") <= each)


def balanced_sample(rows: DataFrame, group: list[str], strata: list[str], key: str, n: int, seed: str | None = None, space: str = "") -> DataFrame:
    """Greedy: each pick brings the most strata values not yet seen, then the rarest ones, then the least stable rank (without a seed: key), then the key.

    The state after each pick decides the next one, so a group is one task's work: O(rows * n). Rows
    that agree on all strata are interchangeable but for their key, so only the n least of each such
    class go in, and the group's size is bounded by n times the classes.
    """
    rank = F.lit("") if seed is None else stable_rank(seed, space, F.col(key).cast("string"))
    rows = rows.withColumn("_rank", rank)
    least = F.row_number().over(W.Window.partitionBy(*group, *strata).orderBy("_rank", key))
    rows = rows.withColumn("_l", least).where(F.col("_l") <= n).drop("_l")

    def pick(frame):
        left = frame.sort_values(["_rank", key]).to_dict("records")
        seen: dict = {}
        out = []
        while left and len(out) < n:
            best = min(left, key=lambda r: (-sum((s, r[s]) not in seen for s in strata), -sum(1_000_000 // (seen.get((s, r[s]), 0) + 1) for s in strata), r["_rank"], r[key]))
            left.remove(best)
            out.append({**best, "pick": len(out) + 1})
            for s in strata:
                seen[s, best[s]] = seen.get((s, best[s]), 0) + 1
        return type(frame)(out, columns=[*frame.columns, "pick"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*group).applyInPandas(pick, f"{kinds}, pick int").drop("_rank")
