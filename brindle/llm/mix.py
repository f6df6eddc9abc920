"""Mixing sources to target weights: subset-sum budget fitting.

A document's size is its number of words.  Each source has a target of words;
whole rounds of the source (0, 1 or 2) are taken first, and what is left of the
target is fitted: documents are counted by source and size, a share of every
size is taken, and a bounded-knapsack dynamic programme over the sizes closes
the rest, exactly for rests up to WIDEST words.  Within a source and size the
documents are ordered by a seeded hash of doc_id and text, rows that agree in
both by a number, and the first so many get one round more.

Only counts per (source, size, slice of the hash) are gathered by key, so a hot
source or a hot size is spread over slices, and so are rows that all repeat one
document: a source reaches one task as its histogram of sizes, never as its
documents.

Null texts have size 0, very long ones their number of words like others.  Null
sources are one source, weighed last.  Documents of size 0 take no words; they
keep the whole rounds of their source, one at least.  Of rows that repeat doc_id
and text so many as the mix needs get the further round, which of them is left
open.  An empty table gives no rows.  Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import Scratch, materialise, sized, spaced_words, unused

# Weights by place of the source in order, share of all sizes, most rounds.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Slices of a hash, by its 12 highest bits; a group of one source and size is ranked by slices first.
SLICES = 4096
#: Words that the dynamic programme may close at once; twice the longest document that the budget holds, where that is more.
REST = 1 << 16
#: Words up to which it is widened where a budget is missed; budgets up to here are met as nearly as any choice of documents can.
WIDEST = 1 << 24


def ordered(seed: int) -> dict[str, Column]:
    """h, which orders the documents, and tie, which orders rows of equal h; tie is a number of the row, so write it before it is used."""
    return {"h": F.xxhash64(F.lit(seed), "doc_id", "text"), "tie": F.xxhash64(F.lit(seed), F.monotonically_increasing_id())}


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, h, tie, size of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(spaced_words(t)) for t in batch.column(4).to_pylist()], pa.int64())], names=["doc_id", "source", "h", "tie", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = (c.alias(n) for n, c in ordered(seed).items())
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), *columns, "text").mapInArrow(run, f"doc_id {kind}, source string, h long, tie long, size long")


def numbered(sources: DataFrame, keep: Scratch) -> DataFrame:
    """sources with its place in the order of `source`, from 0, nulls last.

    The sort is by ranges over many tasks; a place is the count of the ranges
    before, one row for each task, and the place within the range.
    """
    sorted_ = keep(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-ordered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return sorted_.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("place", F.col("before") + within).drop("at", "part", "before")


def targets(sizes: DataFrame, keep: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    Targets are shares of the budget by weight, none above `most` times its
    source.  Round by round, sources that their share would lift above that are
    held at it, and the level of the others, (budget - caps) / weights, rises;
    one row of sums a round reaches the driver, however many sources there are.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    x = keep(numbered(sizes, keep).select("source", "source_size", w.alias("w"), (F.col("source_size").cast("double") * most).alias("cap")), "mix-sources")
    budget = float(x.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        over = F.col("cap") <= level * F.col("w") if held >= 0 else F.lit(False)
        r = x.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("w"))).alias("left")).first()
        if r.n == held or not r.left:
            return x.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target") if r.left else F.col("cap").alias("target"))
        level, held = (budget - (r.caps or 0.0)) / r.left, r.n


def knapsack(sizes: np.ndarray, counts: np.ndarray, rest: int) -> tuple[dict[int, int], int]:
    """Numbers of documents by index whose sizes add up to the largest sum <= rest.

    Bounded multiplicities are split into powers of two; `first` holds the
    part that reached a sum first, from which the choice is read back.
    """
    first = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size, left, step = int(sizes[i]), int(min(counts[i], rest // max(int(sizes[i]), 1))), 1
        while size and left > 0:
            n = min(step, left)
            left, step, width = left - n, step * 2, size * n
            if width <= rest:
                new = reached[:-width] & ~reached[width:] if width else np.zeros(0, bool)
                first[width:][new] = len(parts)
                reached[width:] |= new
                parts.append((int(i), n))
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    best, chosen = at, {}
    while at:
        i, n = parts[first[at]]
        chosen[i] = chosen.get(i, 0) + n
        at -= int(sizes[i]) * n
    return chosen, best


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come to `budget` or little less."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    best = np.zeros_like(counts)
    if budget <= 0 or not total:
        return best
    unit = int(np.gcd.reduce(sizes[counts > 0]))
    sizes, budget = sizes // unit, budget // unit
    most = max(REST, 2 * int(sizes[(counts > 0) & (sizes <= budget)].max(initial=0)))
    while True:
        take = fit_within(sizes, counts, budget, most)
        if (sizes * take).sum() > (sizes * best).sum():
            best = take
        if (sizes * best).sum() == budget or most >= min(budget, WIDEST):
            return best
        most = min(most * 8, WIDEST)


def fit_within(sizes: np.ndarray, counts: np.ndarray, budget: int, most: int) -> np.ndarray:
    """fit_counts() by a share of every size and a programme over `most` words, twice the longest document at least."""
    take = np.minimum(counts, np.floor(counts * (budget / int((sizes * counts).sum()))).astype(np.int64))
    rest = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):  # large sizes first, until the programme can close the rest
        if rest <= most:
            break
        n = min(int(counts[i] - take[i]), max(0, rest - most // 2) // max(int(sizes[i]), 1))
        take[i] += n
        rest -= n * int(sizes[i])
    for i in np.argsort(sizes, kind="stable"):  # small sizes back, so that the programme has a choice
        n = min(int(take[i]), max(0, most - rest) // max(int(sizes[i]), 1))
        take[i] -= n
        rest += n * int(sizes[i])
    chosen, _ = knapsack(sizes, counts - take, min(rest, most))
    for i, n in chosen.items():
        take[i] += n
    return take


def edges(rows: DataFrame, ranks: DataFrame, x: str, keep: Scratch) -> DataFrame:
    """source, size, at, rank, held: of each (source, size) in `ranks` the value of x at which the rank-th row stands, its rank among the rows of that value, and how many these are.

    x is spread evenly over 64 bits and ordered as unsigned.  Counts by its
    SLICES highest values find the slice, counts by value within that slice the
    value; both combine before they shuffle.
    """
    top = F.shiftrightunsigned(x, 65 - SLICES.bit_length())
    slices = keep(_match(rows, sized(ranks), "rank").groupBy("source", "size", "rank", top.alias("slice")).agg(F.count("*").alias("n")), "mix-slices")
    order = Window.partitionBy("source", "size").orderBy("slice")
    at = slices.withColumn("before", F.sum("n").over(order) - F.col("n")).where("before < rank and rank <= before + n")
    at = keep(at.select("source", "size", "slice", (F.col("rank") - F.col("before")).alias("rank")), "mix-edges")
    inside = rows.withColumn("slice", top).alias("a").join(sized(at).alias("b"), F.expr("a.source <=> b.source and a.size = b.size and a.slice = b.slice"))
    values = inside.groupBy("a.source", "a.size", "b.rank", F.col(f"a.{x}").alias("at")).agg(F.count("*").alias("held"))
    order = Window.partitionBy("source", "size").orderBy("at")  # within a slice the order is the same, signed or not
    values = values.withColumn("before", F.sum("held").over(order) - F.col("held")).where("before < rank and rank <= before + held")
    return keep(values.select("source", "size", "at", (F.col("rank") - F.col("before")).alias("rank"), "held"), "mix-values")


def plan(thin: DataFrame, **weights) -> DataFrame:
    """source, size, source_size, target, rounds, below, below_tie: one round more for rows up to (below, below_tie); a null tie is all of below."""
    with Scratch(thin.sparkSession) as keep:
        hist = keep(thin.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
        goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), keep, **weights)

        def choose(key, pdf):
            own = pdf.sort_values("size", ignore_index=True)
            sizes, counts = own["size"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
            total, target = int((sizes * counts).sum()), float(own["target"].iloc[0])
            rounds = int((target + 1e-6) // total) if total else 1
            own["rounds"] = np.where(sizes > 0, rounds, max(rounds, 1))
            own["take"] = np.where(sizes > 0, fit_counts(sizes, counts, int(target + 1e-6) - rounds * total), 0)
            return own[["source", "size", "source_size", "target", "rounds", "n", "take"]]

        hist = hist.alias("a").join(goal.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "a.size", "a.n", "b.source_size", "b.target")
        quota = hist.groupBy("source").applyInPandas(choose, "source string, size long, source_size long, target double, rounds long, n long, take long")
        quota = keep(quota, "mix-quota")
        some = keep(quota.where("take > 0 and take < n").select("source", "size", F.col("take").alias("rank")), "mix-ranks")
        cut = edges(thin, some, "h", keep)
        # rows of one hash beyond what is needed of them repeat a document
        split = keep(cut.where("rank < held").select("source", "size", "at", "rank"), "mix-ties")
        tied = thin.alias("a").join(sized(split).alias("b"), F.expr("a.source <=> b.source and a.size = b.size and a.h = b.at")).select("a.source", "a.size", "a.tie")
        ties = edges(tied, split.drop("at"), "tie", keep).select("source", "size", F.col("at").alias("below_tie"))
        cut = cut.select("source", "size", F.col("at").alias("below"))
        on = "a.source <=> b.source and a.size = b.size"
        cut = cut.alias("a").join(ties.alias("b"), F.expr(on), "left").select("a.*", "b.below_tie")
        out = quota.alias("a").join(cut.alias("b"), F.expr(on), "left")
        whole = F.expr("rounds + if(take = n and take > 0, 1, 0)")
        return materialise(out.select("a.source", "a.size", "source_size", "target", whole.alias("rounds"), "below", "below_tie"), "mix-plan")


def _match(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """left with columns of right where source and size agree; null sources agree."""
    return left.alias("a").join(right.alias("b"), F.expr("a.source <=> b.source and a.size = b.size")).select("a.*", *(f"b.{c}" for c in more))


def copies(h: Column, tie: Column, rounds: Column, below: Column, below_tie: Column) -> Column:
    """Rounds, and one more up to the cut; the hashes are ordered as unsigned."""
    flip = F.lit(-(2**63))
    h, below, tie, below_tie = (c.bitwiseXOR(flip) for c in (h, below, tie, below_tie))
    more = (h < below) | ((h == below) & F.coalesce(tie <= below_tie, F.lit(True)))
    return (rounds + F.when(more, 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, seed: int = 7, **weights) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    thin = materialise(with_size(docs, seed), "mix-thin")
    got = _match(thin, sized(plan(thin, **weights)), "source_size", "target", "rounds", "below", "below_tie")
    times = copies(*(F.col(c) for c in ("h", "tie", "rounds", "below", "below_tie")))
    return got.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, seed: int = 7, **weights) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay.  Nulls, empties, repeats and an empty table are as the module says."""
    own = {c: unused(docs, f"mix_{c}") for c in ("h", "tie", "size", "source", "rounds", "below", "below_tie")}
    at = docs.columns.index("text")

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(spaced_words(t)) for t in batch.column(at).to_pylist()], pa.int64())], names=[*batch.schema.names, own["size"]])

    numbered = docs.withColumns({own[n]: c for n, c in ordered(seed).items()})
    counted = numbered.mapInArrow(count, T.StructType([*numbered.schema.fields, T.StructField(own["size"], T.LongType())]))
    counted = materialise(counted, "mix-counted")
    thin = counted.select("doc_id", F.col("source").cast("string").alias("source"), *(F.col(own[c]).alias(c) for c in ("h", "tie", "size")))
    rule = plan(thin, **weights).select(F.col("source").alias(own["source"]), F.col("size").alias("rule_size"), *(F.col(c).alias(own[c]) for c in ("rounds", "below", "below_tie")))
    got = counted.join(sized(rule), counted["source"].cast("string").eqNullSafe(rule[own["source"]]) & (counted[own["size"]] == rule["rule_size"]))
    times = copies(*(F.col(own[c]) for c in ("h", "tie", "rounds", "below", "below_tie")))
    return got.select(*(counted[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(own["size"])).drop(own["size"])
