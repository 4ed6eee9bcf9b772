"""Mixing sources to target weights by Poisson replication.

A document's uniform number u is a hash of its id and the seed. At a source's repetition rate it has as many copies as the
inverse of the Poisson distribution of that mean gives at u, cut at the source's cap: copy k is there if P(X >= k) >= u.
The tails P(X >= k) are one short array per source, so counts are column expressions and a document is exploded only by
its own count. The rate that meets the target is found for all sources at once: a histogram of u brackets it, and passes
over the documents whose count still differs between the ends of the bracket narrow it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.session import cut_table

#: Cells of the histogram of u per source.
BINS = 4096
#: Parts into which a pass cuts the bracket, and the number of passes: rates are told apart to about one part in 2**30.
PARTS, PASSES = 64, 3


def _tails(rate: float, cap: int) -> np.ndarray:
    """P(X >= k) for k = 1 .. cap, X Poisson of this mean, as far as it is above 2**-54, the least u; computed in logarithms, so that any cap and mean will do."""
    if rate <= 0:
        return np.zeros(0)
    if math.isinf(rate):
        return np.ones(cap)
    n = int(min(cap, math.ceil(rate + 12 * math.sqrt(rate) + 60)))
    j = np.arange(n)
    logs = -rate + j * math.log(rate) - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n)))))[:n]
    tail = 1 - np.cumsum(np.exp(logs))
    return np.minimum.accumulate(tail[tail > 2.0**-54])


def _copies(u: Column, tails: Column) -> Column:
    """How many copies there are at ``u``: the tails that reach it."""
    return F.size(F.filter(tails, lambda x: x >= u))


def _bracket(cells: np.ndarray, goal: float, cap: int) -> tuple[float, float]:
    """Rates between which the tokens pass ``goal``, from the tokens per cell of u."""
    upto = np.concatenate(([0], np.cumsum(cells)))
    least = lambda rate: upto[np.floor(_tails(rate, cap) * BINS).astype(int)].sum()
    most = lambda rate: upto[np.minimum(BINS, np.ceil(_tails(rate, cap) * BINS).astype(int) + 1)].sum()
    limit = cap + 12 * math.sqrt(cap) + 60
    top = 1.0
    while top < limit and least(top) <= goal:
        top *= 2

    def border(passes) -> tuple[float, float]:
        lo, hi = 0.0, top
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if passes(mid) else (mid, hi)
        return lo, hi

    return border(lambda r: most(r) > goal)[0], border(lambda r: least(r) > goal)[1]


def mix_sources(docs: DataFrame, targets: DataFrame, *, id: str, source: str, size: str, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The selection (``id``, copy, source, ``size``, place) in globally shuffled order, and the shares reached.

    ``targets`` (source, target_share, max_repeats) is a table of few rows: one per source. ``total`` is the size of the
    selection; by default the largest at which no source that has documents runs out, so each reaches its share; with a
    larger one, sources that run out give all they have and fall short. The share of a source without documents is split
    over the others in proportion. Sources are compared trimmed and lower-cased. Documents whose source is null or no
    target, and those with a null id or without any size, are not selected; an id counts once. Empty tables give an empty selection.
    """
    goals = [r for r in targets.where("source IS NOT NULL").select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).collect()]
    wanted = docs.where(F.col(id).isNotNull() & (F.col(size) > 0)).select(F.col(id).alias("id"), F.lower(F.trim(source)).alias("source"), F.col(size).cast("long").alias("size"))
    wanted = wanted.where(F.col("source").isin([r["source"] for r in goals])).groupBy("id").agg(F.min(F.struct("source", "size")).alias("x")).select("id", "x.*")
    wanted = cut_table(wanted)
    held = {r["source"]: r["held"] for r in wanted.groupBy("source").agg(F.sum("size").alias("held")).collect()}
    live = [r for r in goals if held.get(r["source"]) and r["target_share"] > 0 and r["max_repeats"] > 0]
    whole = sum(r["target_share"] for r in live)
    share = {r["source"]: r["target_share"] / whole for r in live}
    room = {r["source"]: held[r["source"]] * r["max_repeats"] for r in live}
    budget = min((room[s] / share[s] for s in share), default=0.0) if total is None else float(total)
    goal = {s: float(min(share[s] * budget, room[s])) for s in share}
    session = docs.sparkSession
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    docs_u = wanted.withColumn("u", uniform)
    cells: dict[str, np.ndarray] = {s: np.zeros(BINS) for s in share}
    for r in docs_u.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("size").alias("n")).collect():  # BINS per source at most
        if r["source"] in cells:
            cells[r["source"]][min(r["bin"], BINS - 1)] += r["n"]
    cap = {r["source"]: r["max_repeats"] for r in live}
    rates = {s: (math.inf, math.inf) if goal[s] >= room[s] else _bracket(cells[s], goal[s], cap[s]) for s in share}
    rows = lambda named: session.createDataFrame([(s, *x) for s, x in named.items()], "source string, lo array<double>, hi array<double>, mids array<array<double>>")
    for _ in range(PASSES):
        steps = {s: np.linspace(lo, hi, PARTS + 1) for s, (lo, hi) in rates.items() if lo < hi}
        if not steps:
            break
        state = rows({s: (_tails(x[0], cap[s]).tolist(), _tails(x[-1], cap[s]).tolist(), [_tails(r, cap[s]).tolist() for r in x[1:-1]]) for s, x in steps.items()})
        known = docs_u.join(F.broadcast(state), "source").withColumn("n", _copies(F.col("u"), F.col("lo")))
        # One number per midpoint is collected, and only documents whose count differs over the bracket are laid against them.
        base = {r["source"]: r["n"] for r in known.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()}
        moving = known.where(_copies(F.col("u"), F.col("hi")) > F.col("n")).select("source", "size", "u", "n", F.posexplode("mids").alias("at", "tails"))
        more = {(r["source"], r["at"]): r["n"] for r in moving.groupBy("source", "at").agg(F.sum(F.col("size") * (_copies(F.col("u"), F.col("tails")) - F.col("n"))).alias("n")).collect()}
        for s, x in steps.items():
            tokens = [base.get(s, 0) + more.get((s, i), 0) for i in range(PARTS - 1)]
            at = int(np.searchsorted(tokens, goal[s] + 1e-9, side="right"))  # tokens grow with the rate
            rates[s] = (float(x[at]), float(x[at + 1]))
    final = session.createDataFrame([(s, _tails(lo, cap[s]).tolist()) for s, (lo, _) in rates.items()], "source string, tails array<double>")
    chosen = docs_u.join(F.broadcast(final), "source").withColumn("n", _copies(F.col("u"), F.col("tails"))).where("n > 0")
    chosen = chosen.select("id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    place = F.xxhash64("id", "copy", F.lit(seed + 1))
    selection = chosen.select(F.col("id").alias(id), "copy", "source", F.col("size").alias(size), place.alias("place")).orderBy("place", id, "copy")
    got = chosen.groupBy("source").agg(F.sum("size").alias("tokens"), F.countDistinct("id").alias("documents"), F.count("*").alias("copies"), F.max("copy").alias("most_copies"))
    all_goals = session.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], held.get(r["source"], 0)) for r in goals], "source string, target_share double, max_repeats int, tokens_held long")
    report = all_goals.join(got, "source", "left").na.fill(0, ["tokens", "documents", "copies", "most_copies"])
    sum_all = report.agg(F.sum("tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(sum_all)).withColumn("share", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0))).drop("all_tokens")
    return selection, report
