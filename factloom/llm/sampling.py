"""Problem 1: a sample whose category shares follow target proportions."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX = 3  # digits of the hash that name a bucket: 4096 buckets a category


@dataclass(frozen=True)
class Sample:
    rows: DataFrame  #: plan_id, id, scope
    report: DataFrame  #: a row per plan and category


def category_key(c: Column, missing: str = "other") -> Column:
    """Category without regard to case, spaces, hyphens and underscores; null counts as `missing`."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"(?U)[\s\-_]+", ""), F.lit(missing))


def seats(size: int, categories: list[tuple[str, int, int, int]]) -> dict[str, int]:
    """Seats of (name, target, floor, available): the `size` records of smallest priority (rank - 0.5) / target, floor
    records first, ties by name. Seats that a category can't fill go to the others. Floors hold even beyond `size`."""
    got = {n: min(f, a) for n, _, f, a in categories}
    size = max(size, sum(got.values()))
    open_ = [c for c in categories if c[1] > 0 and c[3] > got[c[0]]]
    at = lambda v, t, f, a: min(a, max(f, int(v * t + 0.5)))  # noqa: E731  ranks with (rank - 0.5) / t <= v
    low, high = 0.0, float(max((a for *_, a in open_), default=0)) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(got.values()) + sum(at(mid, t, got[n], a) - got[n] for n, t, _, a in open_) <= size:
            low = mid
        else:
            high = mid
    low -= low * 1e-9  # the last few seats go one by one, by the same comparison that the priorities define
    for n, t, _, a in open_:
        got[n] = at(low, t, got[n], a)
    queue = [((got[n] + 0.5) / t, n, t, a) for n, t, _, a in open_ if got[n] < a]
    heapq.heapify(queue)
    left = size - sum(got.values())
    while queue and left > 0:
        _, n, t, a = heapq.heappop(queue)
        got[n] += 1
        left -= 1
        if got[n] < a:
            heapq.heappush(queue, ((got[n] + 0.5) / t, n, t, a))
    return got


def sample(df: DataFrame, targets: DataFrame, key: str = "row_id", category: str = "scope", score: str = "quality_score", seed: str = "1") -> Sample:
    """For each plan of `targets` (plan_id, category, target_pct, min_rows, sample_pct, min_quality) a sample of `df`.

    Size: floor(all rows x sample_pct / 100). Eligible: non-null score >= min_quality and the plan's category; rows
    with null key are left out, null category counts as Other. Within a category the order is that of
    md5(seed|key), key: a random order that any engine repeats. Repeated keys are separate rows in an unspecified
    order. needed = max(min_rows, ceil(target_pct x size / 100)); a category with fewer eligible rows than needed is
    reported as short. Empty table: size 0, each category with min_rows > 0 is short.
    Ranks are never computed over a whole category: counts by hash bucket give each category's boundary bucket, only
    that bucket is ranked.
    """
    goal = targets.select("plan_id", F.col(category).alias("scope"), category_key(F.col(category)).alias("cat"), "target_pct", "min_rows", "sample_pct", "min_quality").dropDuplicates(["plan_id", "cat"])
    total = df.count()
    rows = df.select(F.col(key).alias("id"), category_key(F.col(category)).alias("cat"), F.col(score).alias("score")).filter("score is not null and id is not null")
    hit = rows.join(goal.select("plan_id", "cat", "min_quality"), "cat").filter("score >= min_quality")
    hit = hit.withColumn("h", F.md5(F.concat(F.lit(seed + "|"), F.col("id").cast("string"))))
    hit = hit.select("plan_id", "cat", "id", "h", F.substring("h", 1, HEX).alias("b"))
    hist = hit.groupBy("plan_id", "cat", "b").agg(F.count("*").alias("n"))
    have = hist.groupBy("plan_id", "cat").agg(F.sum("n").alias("eligible"))
    plan = goal.join(have, ["plan_id", "cat"], "left").fillna(0, ["eligible"])
    plan = plan.withColumn("sample_size", F.expr(f"{total}L * sample_pct div 100")).withColumn("needed", F.greatest(F.col("min_rows").cast("long"), F.expr("(target_pct * sample_size + 99) div 100")))
    found = plan.collect()  # a row per target
    given = {}
    for p in {r.plan_id for r in found}:
        own = [r for r in found if r.plan_id == p]
        got = seats(own[0].sample_size, [(r.scope, r.target_pct, r.min_rows, r.eligible) for r in own])
        given |= {(p, r.cat): got[r.scope] for r in own}
    cuts = df.sparkSession.createDataFrame([(r.plan_id, r.scope, r.cat, r.target_pct, r.sample_size, r.eligible, r.needed, given[r.plan_id, r.cat]) for r in found], "plan_id int, scope string, cat string, target_pct int, sample_size long, eligible long, needed long, seats long")
    cum = hist.join(cuts.select("plan_id", "cat", "seats"), ["plan_id", "cat"]).withColumn("upto", F.sum("n").over(Window.partitionBy("plan_id", "cat").orderBy("b")))
    edge = cum.filter("upto - n < seats and upto >= seats").select("plan_id", "cat", F.col("b").alias("edge"), (F.col("seats") - F.col("upto") + F.col("n")).alias("left"))
    near = hit.join(edge, ["plan_id", "cat"]).filter("b <= edge")
    ranked = near.filter("b = edge").withColumn("rank", F.row_number().over(Window.partitionBy("plan_id", "cat", "b").orderBy("h", "id"))).filter("rank <= left")
    kept = near.filter("b < edge").select("plan_id", "cat", "id").unionByName(ranked.select("plan_id", "cat", "id"))
    kept = kept.join(cuts.select("plan_id", "cat", "scope"), ["plan_id", "cat"]).select("plan_id", F.col("id").alias(key), F.col("scope").alias(category))
    share = F.round(100 * F.col("seats") / F.greatest(F.lit(1), F.sum("seats").over(Window.partitionBy("plan_id"))), 4)
    report = cuts.withColumn("actual_pct", share).withColumn("short", F.col("eligible") < F.col("needed")).select("plan_id", F.col("scope").alias(category), "target_pct", "sample_size", "eligible", "needed", "seats", "actual_pct", "short")
    return Sample(kept, report)
