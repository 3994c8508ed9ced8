"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that have them). The flow routes token capacity from patterns to
source quotas; using a pattern's documents again costs more each time (convex repetition costs), so nothing is repeated before
everything else that fits is used. The total is the largest at which every present source reaches its share within its cap, or what the
caller asks for. Documents are then selected by a seeded hash: a pattern's documents stand in hash order on a line of tokens, and those
before the flow's end are used.

Defined results: documents without a source, or of sources without a target, are not used; sources without documents get nothing, and
the shares of the others keep their proportions; a document of no tokens is not used; repeated rows of a key count once, and a key seen
in several sources belongs to all of them; no document is used more often than the largest cap of its sources.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import materialise

BUCKETS = 4096
_STEPS = 60


@dataclass
class Flow:
    """Successive shortest paths over a small graph with real capacities."""

    edges: list[list] = field(default_factory=list)  # [to, capacity, cost]; edge k's reverse is k ^ 1
    out: dict = field(default_factory=dict)

    def add(self, a, b, capacity: float, cost: float) -> int:
        k = len(self.edges)
        self.edges += [[b, float(capacity), cost], [a, 0.0, -cost]]
        self.out.setdefault(a, []).append(k)
        self.out.setdefault(b, []).append(k + 1)
        return k

    def run(self, s, t, tiny: float) -> float:
        total = 0.0
        while True:
            dist, via = {s: 0.0}, {}
            for _ in range(len(self.out)):
                changed = False
                for a in list(dist):
                    for k in self.out.get(a, ()):
                        b, capacity, cost = self.edges[k]
                        if capacity > tiny and dist[a] + cost < dist.get(b, float("inf")) - 1e-9:
                            dist[b], via[b], changed = dist[a] + cost, k, True
                if not changed:
                    break
            if t not in dist:
                return total
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.edges[via[b] ^ 1][0]
            room = min(self.edges[k][1] for k in path)
            for k in path:
                self.edges[k][1] -= room
                self.edges[k ^ 1][1] += room
            total += room


def route(patterns: dict[tuple, float], targets: dict[str, tuple[float, int]], total: float) -> tuple[float, dict[tuple, float]]:
    """(tokens routed, tokens by (pattern, source)) towards ``total``; ``targets`` has share and cap of each source."""
    flow, legs = Flow(), {}
    for p, tokens in patterns.items():
        for r in range(max(targets[s][1] for s in p)):
            flow.add("start", ("pattern", p), tokens, float(r))
        for s in p:
            legs[p, s] = flow.add(("pattern", p), ("source", s), tokens * targets[s][1], 0.0)
    for s, (share, _) in targets.items():
        flow.add(("source", s), "end", share * total, 0.0)
    routed = flow.run("start", "end", total * 1e-12 + 1e-9)
    return routed, {k: flow.edges[e ^ 1][1] for k, e in legs.items()}


def plan(patterns: dict[tuple, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[tuple, float]]:
    """The total and the tokens by (pattern, source). ``total`` None: the largest at which all present sources reach their shares."""
    present = {s for p in patterns for s in p if patterns[p] > 0}
    use = {s: x for s, x in targets.items() if s in present and x[0] > 0 and x[1] > 0}
    patterns = {q: sum(t for p, t in patterns.items() if tuple(s for s in p if s in use) == q and t > 0) for q in {tuple(s for s in p if s in use) for p in patterns}}
    patterns = {p: t for p, t in patterns.items() if p and t > 0}
    whole = sum(x[0] for x in use.values())
    if not patterns or not whole:
        return 0.0, {}
    use = {s: (share / whole, cap) for s, (share, cap) in use.items()}
    if total is None:
        low, high = 0.0, sum(t * max(use[s][1] for s in p) for p, t in patterns.items())
        for _ in range(_STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if route(patterns, use, middle)[0] >= middle * (1 - 1e-9) else (low, middle)
        total = low
    return total, route(patterns, use, total)[1]


def mix(documents: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selected, report). ``documents`` has one row for each key and source with its tokens; ``targets`` source, target_share, max_repeats.

    selected: (key, source, uses, n_tokens), a row for each source a document is used for. report: a row for each source on either side.
    The driver receives a row for each target and each membership pattern, no documents."""
    spark, kind = documents.sparkSession, dict(documents.dtypes)[key]
    rows = documents.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(source)).alias("of"), F.max(tokens).alias("n_tokens"))
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.filter("source is not null").collect()}
    known = F.array(*map(F.lit, sorted(wanted))) if wanted else F.array().cast("array<string>")
    usable = [s for s, x in wanted.items() if x[0] > 0 and x[1] > 0]
    rows = materialise(rows.withColumn("pattern", F.array_intersect("of", known)))
    sums = rows.filter("size(pattern) > 0 and n_tokens > 0").groupBy("pattern").agg(F.sum("n_tokens").alias("t")).collect()
    patterns: dict[tuple, float] = {}
    for r in sums:
        p = tuple(s for s in r.pattern if s in usable)
        if p:
            patterns[p] = patterns.get(p, 0) + r.t
    reached, legs = plan(patterns, wanted, total)
    stretches = []  # each pattern's line of tokens, again and again, given to its sources one after another
    for p in patterns:
        at = 0.0
        for s in p:
            if (t := legs.get((p, s), 0.0)) > 0:
                stretches.append((list(p), s, at, at + t, float(patterns[p])))
                at += t
    table = F.broadcast(spark.createDataFrame(stretches, "pattern array<string>, source string, since double, until double, lap double"))
    pool = rows.filter("n_tokens > 0").withColumn("pattern", F.array_intersect("pattern", F.array(*map(F.lit, usable)) if usable else F.array().cast("array<string>"))).filter("size(pattern) > 0")
    pool = pool.withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    # Places on the line: whole buckets first, then the documents of a bucket; no window holds more than a bucket or all bucket sums.
    sizes = pool.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("b"))
    before = F.sum("b").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("b")
    pool = pool.join(sizes.select("pattern", "bucket", before.alias("before")), ["pattern", "bucket"])
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("h", "key")) - F.col("n_tokens")
    placed = pool.select("key", "pattern", "n_tokens", (F.col("before") + inside).cast("double").alias("place"))
    # The document is used for a source once for each lap that brings its place into the source's stretch.
    uses = F.ceil((F.col("until") - F.col("place")) / F.col("lap")) - F.greatest(F.lit(0), F.ceil((F.col("since") - F.col("place")) / F.col("lap")))
    chosen = placed.join(table, "pattern").withColumn("uses", F.greatest(uses, F.lit(0)).cast("int")).filter("uses > 0")
    selected = materialise(chosen.select(F.col("key").cast(kind).alias(key), "source", "uses", "n_tokens"))
    held = rows.select(F.explode("of").alias("source"), "n_tokens").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    used = selected.groupBy("source").agg(F.count("*").alias("documents_used"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    goal = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    report = goal.join(held, "source", "full").join(used, "source", "left").fillna(0, ["documents", "tokens", "documents_used", "tokens_used", "most_uses"])
    all_used = selected.agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("all_used"))
    report = report.join(F.broadcast(all_used)).withColumn("actual_share", F.coalesce(F.col("tokens_used") / F.nullif(F.col("all_used"), F.lit(0)), F.lit(0.0))).drop("all_used")
    return selected, report
