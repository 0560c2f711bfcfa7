"""Problem 9: mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer, counted once per document. A mix has a size: by default the largest at which every
source can have its target share; at a larger one the shares give way: sources that would have to repeat more often than
allowed are clamped at their cap, and what they leave is shared out among the others in proportion to their weights until all
fit. A source is then used a whole number of times, plus once more for a seeded part of its documents, cut at the hash where
the remaining tokens are reached; the document at the cut is in if that comes nearer to them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.encoding import token_counts
from strandloom.operators.times import small_side
from strandloom.session import written

#: Hash buckets in which the cut is looked for; only the documents of one bucket per source are then sorted.
BUCKETS = 4096
#: Targets up to which they are sent to all tasks; more are joined by shuffle.
BROADCAST_TARGETS = 10_000


def water_fill(want: float, sources: list[tuple[float, float]]) -> list[float]:
    """Shares of ``want`` for sources of (weight, cap): proportional to weight, none above its cap, no weight no share."""
    out = [0.0] * len(sources)
    open_ = [i for i, (w, cap) in enumerate(sources) if w > 0 and cap > 0]
    left = want
    while open_ and left > 0:
        total = sum(sources[i][0] for i in open_)
        full = [i for i in open_ if left * sources[i][0] / total >= sources[i][1]]
        if not full:
            for i in open_:
                out[i] = left * sources[i][0] / total
            break
        for i in full:
            out[i] = sources[i][1]
            left -= sources[i][1]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def exact_total(sources: list[tuple[float, float]]) -> float:
    """The largest total at which no source of (weight, cap) is held back by its cap; sources with nothing to give don't count."""
    some = [(w, cap) for w, cap in sources if w > 0 and cap > 0]
    return min((cap / w for w, cap in some), default=0.0) * sum(w for w, _ in some)


def plan(targets: list[tuple[str, float, int, int]], total: float | str = "exact") -> list[tuple]:
    """source, target_share, reachable_share, allotted, whole, fraction of the targets (source, weight, max_repeats, tokens) of one mix.

    A null or negative weight and a cap below one count as none. target_share is of the weights of all the mix's sources,
    reachable_share of those that have tokens and may be used. total: tokens wanted, or 'exact' for the most that meets all
    reachable shares, or 'pass' for as many as the mix's sources have in one pass.
    """
    weights = [max(0.0, t[1] or 0.0) for t in targets]
    caps = [t[3] * max(0, t[2] or 0) for t in targets]
    pairs = list(zip(weights, caps, strict=True))
    one_pass = sum(t[3] for t, w in zip(targets, weights, strict=True) if w > 0)
    want = {"exact": exact_total(pairs), "pass": one_pass}.get(total, total)
    all_weight, usable = sum(weights) or 1.0, sum(w for w, cap in pairs if cap > 0) or 1.0
    out = []
    for t, (w, cap), a in zip(targets, pairs, water_fill(float(want), pairs), strict=True):
        epochs = a / t[3] if t[3] else 0.0
        whole = int(epochs + 1e-9)
        out.append((t[0], w / all_weight, w / usable if cap > 0 else 0.0, float(a), whole, max(0.0, epochs - whole)))
    return out


def counted(documents: DataFrame, **tokenizer) -> DataFrame:
    """doc_id, source, n_tokens, kept in the shared folder: both passes over the sizes read it."""
    return written(token_counts(documents, ["doc_id", "source"], **tokenizer), "token-counts")


_GOALS = (
    "mix_name string, source string, target_share double, reachable_share double, available_tokens bigint, max_repeats int, allotted double, whole int, fraction double, largest bigint"
)


def goals_of(sizes: DataFrame, targets: DataFrame, total: float | str) -> DataFrame:
    """What each source of each mix is to give. A mix is planned by the task that holds its targets; nothing comes to the driver."""
    goal = targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull())
    goal = goal.groupBy("mix_name", "source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("mix_name", "source", "t.*")
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))

    def planned(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        rows = [(s, None if pd.isna(w) else float(w), 0 if pd.isna(m) else int(m), int(n)) for s, w, m, n in zip(pdf["source"], pdf["weight"], pdf["max_repeats"], pdf["tokens"], strict=True)]
        out = [(key[0], p[0], p[1], p[2], r[3], r[2], p[3], p[4], p[5], g) for r, p, g in zip(rows, plan(rows, total), pdf["largest"], strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _GOALS.split(", ")])

    return written(goal.join(have, "source", "left").na.fill(0, ["tokens", "largest"]).groupBy("mix_name").applyInPandas(planned, _GOALS), "goals")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, total: float | str = "exact", sizes: DataFrame | None = None, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: mix_name, doc_id, source, n_tokens, copies (how often the document is used: at least 1, at most max_repeats).
    shares: mix_name, source, target_share, reachable_share (what is left of it for sources that have tokens), available_tokens,
    allotted_tokens, used_tokens, actual_share, passes, clamped (held at its cap), missing (no tokens at all), largest_document.
    used_tokens misses allotted_tokens by half a document of the source at most. Documents without source are in no mix; null
    and empty texts have no tokens and follow their hash like any other. Repeated (mix_name, source) targets count once, with
    the largest weight. The choice depends on the seed, the mix and doc_id only. sizes: of :func:`counted`, if at hand.
    """
    sizes = counted(documents, **tokenizer) if sizes is None else sizes
    goals = goals_of(sizes, targets, total)
    wanted = goals.where((F.col("whole") > 0) | (F.col("fraction") > 0)).drop("target_share", "reachable_share", "allotted", "largest")
    drawn = sizes.where(F.col("source").isNotNull()).join(small_side(wanted, BROADCAST_TARGETS), "source")
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "mix_name", "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    drawn = drawn.withColumn("extra", F.col("fraction") * F.col("available_tokens"))
    # tokens before each bucket: at most BUCKETS rows a target
    per = drawn.where(F.col("fraction") > 0).groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("t"), F.max("extra").alias("extra"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = per.withColumn("before", before).where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("t") > F.col("extra")))
    cut = written(cut.select("mix_name", "source", F.col("bucket").alias("cut"), F.col("before").alias("cut_before")), "cuts")
    placed = drawn.join(small_side(cut, BROADCAST_TARGETS), ["mix_name", "source"], "left")
    edge = placed.where(F.col("bucket") == F.col("cut"))
    above = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("more", ((F.col("cut_before") + above + F.col("n_tokens") / 2) <= F.col("extra")).cast("int"))
    rest = placed.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("more", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("int"))
    both = rest.unionByName(edge).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.col("max_repeats")))
    selection = written(both.where(F.col("copies") > 0).select("mix_name", "doc_id", "source", "n_tokens", "copies"), "mix")
    used = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("passes"))
    shares = goals.join(used, ["mix_name", "source"], "left").na.fill(0, ["used_tokens", "passes"])
    in_mix = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
    cap = F.col("available_tokens") * F.col("max_repeats")
    shares = shares.select(
        "mix_name", "source", "target_share", "reachable_share", "available_tokens", F.col("allotted").alias("allotted_tokens"), "used_tokens",
        F.when(in_mix > 0, F.col("used_tokens") / in_mix).otherwise(0.0).alias("actual_share"), F.col("passes").cast("int").alias("passes"),
        ((cap > 0) & (F.col("allotted") >= cap * (1 - 1e-9))).alias("clamped"), (F.col("available_tokens") == 0).alias("missing"), F.col("largest").alias("largest_document"),
    )
    return selection, shares


def checked(selection: DataFrame, shares: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, over_cap (documents used more often than max_repeats, or listed twice), share_met (the tokens used are
    within half a document of those allotted) of every target: should be 0 and true throughout."""
    cap = targets.groupBy("mix_name", "source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("mix_name", "source", "t.max_repeats")
    per_doc = selection.groupBy("mix_name", "source", "doc_id").agg(F.sum("copies").alias("copies"))
    over = per_doc.join(small_side(cap, BROADCAST_TARGETS), ["mix_name", "source"]).where(F.col("copies") > F.col("max_repeats"))
    over = over.groupBy("mix_name", "source").agg(F.count("*").alias("over_cap"))
    met = F.abs(F.col("used_tokens") - F.col("allotted_tokens")) <= F.col("largest_document") / 2 + 1e-6
    return shares.join(over, ["mix_name", "source"], "left").select("mix_name", "source", F.coalesce("over_cap", F.lit(0)).cast("bigint").alias("over_cap"), met.alias("share_met"))
