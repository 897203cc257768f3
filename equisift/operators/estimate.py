"""Calls, tokens and cost of a run: a table of its phases, summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Tokens of a prompt, prices in dollars per million tokens, and the share of input.
ZERO_SHOT_TOKENS, FEW_SHOT_TOKENS, DEMO_TOKENS, CELLS = 155, 170, 70, 4
PRICE_IN, PRICE_OUT, SHARE_IN, SHARE_OUT = 0.10, 0.20, 0.95, 0.05

PHASES = ("baseline", "evolution", "test", "search")


def phases(configs: DataFrame) -> DataFrame:
    """A row for each kind of call that a configuration makes: config, phase, calls, tokens (of one call)."""
    c = F.col
    zero, few = F.lit(ZERO_SHOT_TOKENS), c("k_shots") * CELLS * DEMO_TOKENS + FEW_SHOT_TOKENS
    searched = F.ceil(c("max_test_samples") / c("batch_size")) * c("batch_size") * c("batch_size") * c("l_iterations")
    kinds = [
        ("baseline", c("max_dev_samples"), zero),
        ("evolution", c("max_dev_samples") * c("iterations"), few),
        ("test", c("max_test_samples"), zero),
        ("test", c("max_test_samples"), few),
        ("search", F.when(c("with_search"), searched).otherwise(0), c("k_neighbors") * DEMO_TOKENS + FEW_SHOT_TOKENS),
    ]
    rows = [F.struct(F.lit(p).alias("phase"), n.cast("long").alias("calls"), t.cast("long").alias("tokens")) for p, n, t in kinds]
    return configs.select(F.struct("*").alias("config"), F.inline(F.array(*rows)))


def estimate(configs: DataFrame) -> DataFrame:
    """configs: name, k_shots, max_dev_samples, max_test_samples, iterations, batch_size, k_neighbors, l_iterations, with_search. One row each; equal rows count once."""
    of = lambda value, *names: F.sum(F.when(F.col("phase").isin(*names), value).otherwise(0))
    first = PHASES[:3]
    sums = [of(v, *p).alias(f"{n}_{what}") for n, p in [*((p, (p,)) for p in PHASES), ("phase_one", first), ("grand_total", PHASES)] for what, v in (("calls", F.col("calls")), ("tokens", F.col("calls") * F.col("tokens")))]
    total = phases(configs).groupBy("config").agg(*sums)
    part = lambda share, price: F.floor(F.col("grand_total_tokens") * F.lit(share)) * F.lit(price)
    demos = F.col("config.k_shots").cast("long") * CELLS
    return total.select(
        "config.name", *[c for c in total.columns if c != "config"], F.round((part(SHARE_IN, PRICE_IN) + part(SHARE_OUT, PRICE_OUT)) / 1_000_000, 6).alias("estimated_cost_usd"),
        F.lit(ZERO_SHOT_TOKENS).cast("long").alias("tokens_per_zero_shot"), (demos * DEMO_TOKENS + FEW_SHOT_TOKENS).alias("tokens_per_few_shot"), demos.alias("total_demonstrations"),
    )
