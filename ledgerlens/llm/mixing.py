"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources they belong
to) and seeded bucket; only pattern totals reach the driver.  There token
capacity is routed from patterns to source quotas.  A pattern's first epoch
costs 0 for each token, its second 1, and so on (convex), so the cheapest flow
is found by opening one epoch after another and augmenting along shortest
paths; an earlier route is moved to another source of its pattern where that
frees a quota.  Each pattern then takes its whole epochs from every document
and the remainder from the documents that come first by a seeded hash: whole
buckets below the boundary bucket, and an ordered prefix inside that one.  No
window or task ever holds more of a pattern than one bucket.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import word_count
from ledgerlens.session import materialize

BUCKET_BITS = 16


def source_order(source: str | None) -> tuple:
    """By code point, null last."""
    return (source is None, source or "")


def share_targets(
    sizes: Mapping[str | None, int], weights: Sequence[float], share: float, most: float
) -> dict[str | None, float]:
    """Targets that share ``share`` x all sizes by weight, none above ``most`` x
    its source's size; what a full source leaves goes to the others by weight."""
    names = sorted(sizes, key=source_order)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, found, free = share * sum(sizes.values()), {}, names
    while free:
        all_weights = sum(weight[s] for s in free)
        part = {s: left * weight[s] / all_weights for s in free}
        above = [s for s in free if part[s] > most * sizes[s]]
        if not above:
            return found | part
        found |= {s: most * float(sizes[s]) for s in above}
        left = share * sum(sizes.values()) - sum(found.values())
        free = [s for s in free if s not in found]
    return found


def route(
    capacity: Mapping[tuple, int], quotas: Mapping[str | None, int], epochs: int
) -> dict[tuple, dict[str | None, int]]:
    """Tokens that each pattern gives to each of its sources: a maximum flow of
    least cost, epoch r of a pattern costing r for each token."""
    patterns = sorted(capacity, key=lambda p: [source_order(s) for s in p])
    flow = {p: {s: 0 for s in p if s in quotas} for p in patterns}
    members: dict[str | None, list[tuple]] = {s: [p for p in patterns if s in flow[p]] for s in quotas}
    need, spare = dict(quotas), dict.fromkeys(patterns, 0)
    for _ in range(epochs):
        for p in patterns:
            spare[p] += capacity[p]
        for start in patterns:
            while spare[start]:
                came: dict[str | None, tuple] = {}  # source -> (pattern, source before it)
                queue, seen, end = deque([(start, None, False)]), {start}, None
                while queue and end is None:
                    p, before, moved = queue.popleft()
                    for s in flow[p]:
                        if s in came:
                            continue
                        came[s] = (p, before, moved)
                        if need[s] > 0:
                            end = (s,)
                            break
                        for q in members[s]:
                            if q not in seen and flow[q][s] > 0:
                                seen.add(q)
                                queue.append((q, s, True))
                if end is None:
                    break
                path, s = [], end[0]
                while True:
                    p, before, moved = came[s]
                    path.append((p, s, before, moved))
                    if not moved:
                        break
                    s = before
                amount = min([spare[start], need[end[0]], *(flow[p][b] for p, _, b, moved in path if moved)])
                for p, s, before, moved in path:
                    flow[p][s] += amount
                    if moved:
                        flow[p][before] -= amount
                spare[start] -= amount
                need[end[0]] -= amount
    return flow


def pattern_of(sources: Column) -> Column:
    return F.to_json(F.sort_array(F.array_distinct(sources)))


def mix(
    documents: DataFrame,
    sources: Column,
    weights: Sequence[float],
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
    bucket_bits: int = BUCKET_BITS,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep``, pattern, size, source_size, target, taken for each document.

    ``sources`` is an array column: the sources a document belongs to (null is a
    source of its own).  ``source_size`` and ``target`` are those of the first of
    them.  ``taken`` counts the words that the mix takes, between 0 and ``most``
    x size.  Only the last document of a pattern's seeded order may be taken in
    part, so the words taken from a pattern are exactly those routed from it.
    A null text has size 0 and is never taken.  Repeated rows count each; ties
    in the hash are ordered by id and size.  An empty table gives no rows.  The
    driver holds one row for each pattern: a mix is over a list of sources that
    somebody weighs, not over keys that grow with the documents.
    """
    spark = documents.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    narrow = materialize(
        documents.select(
            *keep,
            pattern_of(sources).alias("pattern"),
            word_count(F.col("text")).alias("size"),
            order.alias("__order"),
            F.shiftrightunsigned(order, 64 - bucket_bits).alias("__bucket"),
        ),
        "mix",
    )
    buckets = materialize(
        narrow.groupBy("pattern", "__bucket").agg(F.sum("size").alias("tokens")), "mix-buckets"
    )
    total = {r["pattern"]: r["tokens"] for r in buckets.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    names = {key: tuple(sorted(json.loads(key), key=source_order)) for key in total}
    sizes: dict[str | None, int] = {}
    for key, members in names.items():
        for s in members:
            sizes[s] = sizes.get(s, 0) + total[key]
    targets = share_targets(sizes, weights, share, most)
    flow = route({names[k]: n for k, n in total.items()}, {s: round(t) for s, t in targets.items()}, most)
    plan = []
    for key, members in names.items():
        given = sum(flow[members].values())
        whole, rest = divmod(given, total[key]) if total[key] else (0, 0)
        plan.append((key, sizes[members[0]], float(targets[members[0]]), whole, rest))
    plan_df = spark.createDataFrame(
        plan, "pattern string, source_size long, target double, whole long, rest long"
    )
    before = Window.partitionBy("pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        buckets.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .join(F.broadcast(plan_df.select("pattern", "rest")), "pattern")
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
        .select("pattern", F.col("__bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("edge_rest"))
    )
    # one row for each pattern, as the plan itself
    edge_rows = spark.createDataFrame(edges.collect(), "pattern string, edge long, edge_rest long")
    decided = narrow.join(F.broadcast(plan_df.join(F.broadcast(edge_rows), "pattern", "left")), "pattern")
    at_edge = F.coalesce(F.col("__bucket") == F.col("edge"), F.lit(False))
    below = F.coalesce(F.col("__bucket") < F.col("edge"), F.lit(False))
    whole = F.col("size") * F.col("whole")
    plain = decided.where(~at_edge).withColumn("taken", whole + F.when(below, F.col("size")).otherwise(0))
    ordered = Window.partitionBy("pattern").orderBy("__order", *keep, "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("edge_rest") - F.coalesce(F.sum("size").over(ordered), F.lit(0))
    last = decided.where(at_edge).withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return plain.unionByName(last).select(*keep, "pattern", "size", "source_size", "target", "taken")


def repeat_documents(documents: DataFrame, sources: Column, weights: Sequence[float], **options) -> DataFrame:
    """Each document as many times as the mix takes it, whole rows and whole texts.

    A document that the mix takes in part is taken whole where that part is at
    least half of it, so a pattern's words differ from the routed ones by at
    most half of one document.
    """
    keyed = documents.withColumn("__key", F.xxhash64("text")).withColumn("__sources", sources)
    mixed = mix(keyed, F.col("__sources"), weights, keep=("doc_id", "__key"), **options)
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    plan = (
        mixed.where(F.col("taken") > 0)
        .groupBy(F.col("doc_id").alias("__id"), "__key", F.col("pattern").alias("__pattern"))
        .agg(F.sum(times).cast("int").alias("__times"))
        .where(F.col("__times") > 0)
    )
    # rows repeated as they are share their takes: one of them stands for all
    rows = keyed.withColumn("__pattern", pattern_of(F.col("__sources"))).withColumn("__id", F.col("doc_id"))
    same = Window.partitionBy("__id", "__key", "__pattern").orderBy("__id")
    first = rows.withColumn("__row", F.row_number().over(same)).where(F.col("__row") == 1)
    equal = [first[c].eqNullSafe(plan[c]) for c in ("__id", "__key", "__pattern")]
    chosen = first.join(plan, equal[0] & equal[1] & equal[2])
    return chosen.select(*documents.columns, F.explode(F.sequence(F.lit(1), "__times")).alias("__nth")).drop("__nth")
