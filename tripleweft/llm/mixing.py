"""Mixing sources by temperature, with the exponent found by bisection.

A source with T tokens gets a weight in proportion to T to the power alpha:
1 keeps the sources' own shares, 0 makes them equal. Alpha is bisected to a
target entropy of the weights or to a limit on how often the most repeated
source is passed through. Weights become whole passes plus, for the rest of a
source's budget, a prefix of its blocks in a seeded permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweft.llm.runtime import materialize, prepare

MAX_PASSES = 4.0  # how often the most repeated source is passed through
BLOCKS = 4096  # per source; what a budget is rounded to
_HALVINGS, _ROUNDS = 4, 10  # a round tests 15 exponents at once: four bisection steps
_BLANKS = r"[^\x20\x09-\x0D]+"


def source_tokens(docs: DataFrame) -> DataFrame:
    """`source, tokens, n_docs`; a token is a word between blanks, a null source is a source."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def _entropy(log_weight: Column, total: Column) -> Column:
    return F.log(total) - F.sum(F.exp(log_weight) * log_weight) / total


def solve_exponent(sources: DataFrame, entropy: float | None = None, max_passes: float = MAX_PASSES) -> float:
    """The exponent in [0, 1] that meets the target, over `source, tokens`.

    With `entropy` (nats) the weights' entropy reaches it; it falls as the
    exponent grows. Without, no source is passed through more than
    `max_passes` times when the largest is passed through once: the flattest
    such mix. A target beyond reach gives the nearer end. The table of sources
    is never collected: every round is one aggregate over it.
    """
    live = sources.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("t"))
    top = live.agg(F.max("t").alias("top"), F.min("t").alias("low")).first()
    if top["top"] is None:
        return 1.0
    low, high = 0.0, 1.0
    steps = 1 << _HALVINGS
    for _ in range(_ROUNDS):
        grid = F.explode(F.sequence(F.lit(0), F.lit(steps)))
        tested = live.select("t", grid.alias("k")).withColumn("alpha", F.lit(low) + F.col("k") * (high - low) / steps)
        log_weight = F.col("alpha") * (F.col("t") - F.lit(top["top"]))
        passes = F.exp((F.col("alpha") - 1) * (F.col("t") - F.lit(top["top"])))
        results = tested.groupBy("k").agg(_entropy(log_weight, F.sum(F.exp(log_weight))).alias("h"), F.max(passes).alias("passes")).collect()
        # the first exponent that is sharp enough; one below it is still too flat
        sharp = [r["k"] for r in results if (r["passes"] <= max_passes if entropy is None else r["h"] <= entropy)]
        at = min(sharp, default=steps)
        if at == 0:
            return low
        low, high = low + (at - 1) * (high - low) / steps, low + at * (high - low) / steps
    return high


def plan_budgets(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """`source, tokens, weight, budget, passes` per source that has tokens.

    Without `budget` it is the least under which every source is passed
    through at least once, so that no document is left out.
    """
    live = sources.where("tokens > 0")
    logs = F.log(F.col("tokens").cast("double"))
    totals = live.agg(F.max(logs).alias("top"), F.sum(F.exp(F.lit(alpha) * logs)).alias("sum")).first()
    if totals["top"] is None:
        return live.select("source", "tokens", *[F.lit(0.0).alias(c) for c in ("weight", "budget", "passes")])
    weight = F.exp(F.lit(alpha) * logs) / F.lit(totals["sum"])
    if budget is None:
        share = F.exp((F.lit(alpha) - 1) * (logs - F.lit(totals["top"]))) * F.col("tokens")
    else:
        share = weight * F.lit(float(budget))
    return live.select("source", "tokens", weight.alias("weight"), share.alias("budget"), (share / F.col("tokens")).alias("passes"))


def mix_sources(docs: DataFrame, entropy: float | None = None, max_passes: float = MAX_PASSES, budget: int | None = None, seed: int = 1) -> DataFrame:
    """`doc_id, source, n_tokens, epoch, block`: a row for each use of a document.

    Reading by `epoch`, then `block`, gives the mix: within an epoch a source's
    documents lie in 4,096 blocks whose order is a seeded permutation, and the
    last epoch of a source takes blocks until its budget is met, to half a
    block. Documents without words cost nothing and are used once. Null texts
    have no words, a null source is a source of its own, repeated rows are
    documents of their own, other columns are ignored, an empty table gives an
    empty mix.
    """
    prepare(docs.sparkSession)
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(_BLANKS)), F.lit(0)).cast("bigint")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), n_tokens), F.lit(BLOCKS)).cast("int")
    counted = materialize(docs.select("doc_id", "source", n_tokens.alias("n_tokens"), block.alias("home")), "mixing")
    sources = materialize(source_tokens(counted), "sources")
    plan = plan_budgets(sources, solve_exponent(sources, entropy, max_passes), budget)
    key = F.col("source").eqNullSafe(F.col("_source"))
    blocks = _planned_blocks(counted, plan, seed)
    placed = counted.join(
        blocks.withColumnsRenamed({"source": "_source", "home": "_home"}), key & (F.col("home") == F.col("_home")), "left"
    )
    uses = F.when(F.col("n_tokens") > 0, F.coalesce("n_epochs", F.lit(0))).otherwise(1)
    return (
        placed.withColumn("uses", uses)
        .where("uses > 0")
        .select("doc_id", "source", "n_tokens", "home", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("epoch"))
        .select("doc_id", "source", "n_tokens", "epoch", _place(F.col("epoch"), F.col("home"), seed).alias("block"))
    )


def _place(epoch: Column, home: Column, seed: int) -> Column:
    """A block's place in an epoch: an odd multiplier and a shift permute the 4,096 places."""
    draw = F.xxhash64(F.lit(seed), epoch)
    odd = F.pmod(draw, F.lit(BLOCKS // 2)) * 2 + 1
    return F.pmod(home * odd + F.pmod(F.shiftright(draw, 32), F.lit(BLOCKS)), F.lit(BLOCKS)).cast("int")


def _planned_blocks(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """`source, home, n_epochs`: how often each block is used.

    At most 4,096 rows per source, so the running sum has bounded windows.
    """
    sums = counted.groupBy("source", "home").agg(F.sum("n_tokens").alias("block_tokens"))
    whole = F.floor("passes").cast("int")
    planned = sums.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "home", "block_tokens", whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest")
    )
    order = Window.partitionBy("source").orderBy(_place(F.col("whole"), F.col("home"), seed))
    through = F.sum("block_tokens").over(order)
    # a block counts if at least half of it lies within the budget
    extra = (through - F.col("block_tokens") / 2.0 < F.col("rest")).cast("int")
    return planned.withColumn("extra", extra).select("source", "home", (F.col("whole") + F.col("extra")).alias("n_epochs"))
