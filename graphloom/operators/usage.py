"""Token usage: prices, cost of calls, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import coarse_token_estimate, preview

#: Fixed values: (part of a model's name, USD per 1000 tokens in, and out), in the order in which they are tried.
PRICES = [
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("qwen-turbo", 0.0008, 0.0008),
    ("qwen-plus", 0.004, 0.004),
    ("qwen-max", 0.02, 0.02),
    ("ollama", 0.0, 0.0),
]


def price(model: Column, longest: bool = False) -> tuple[Column, Column]:
    """(price in, price out): of the first entry whose key is in the model's name, or of the longest such key; 0 if none.

    The table is a dozen constants, so the look-up is an expression and no join.
    """
    entries = sorted(PRICES, key=lambda p: -len(p[0])) if longest else PRICES
    columns = []
    for k in (1, 2):
        found = None
        for entry in entries:
            hit = F.contains(F.lower(model), F.lit(entry[0]))
            found = F.when(hit, F.lit(entry[k])) if found is None else found.when(hit, F.lit(entry[k]))
        columns.append(found.otherwise(F.lit(0.0)))
    return columns[0], columns[1]


def with_cost(usage: DataFrame, longest: bool = False) -> DataFrame:
    """``usage`` (model, input_tokens, output_tokens) with total_tokens and costs."""
    p_in, p_out = price(F.col("model"), longest)
    out = usage.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return out.withColumns(
        {
            "cost_input": F.col("input_tokens") * p_in / 1000,
            "cost_output": F.col("output_tokens") * p_out / 1000,
            "cost_total": (F.col("input_tokens") * p_in + F.col("output_tokens") * p_out) / 1000,
        }
    )


def with_previews(usage: DataFrame, n: int = 200) -> DataFrame:
    """prompt and response cut to previews (SNK11)."""
    return usage.withColumns({"prompt_preview": preview(F.col("prompt"), n), "response_preview": preview(F.col("response"), n)}).drop("prompt", "response")


def reported_tokens(sources: list[tuple[Column, Column]], prompt: Column, response: Column) -> tuple[Column, Column]:
    """(in, out) from the first source that reports any, else by estimate."""
    some = [F.when((F.coalesce(i, F.lit(0)) != 0) | (F.coalesce(o, F.lit(0)) != 0), F.struct(F.coalesce(i, F.lit(0)).cast("long").alias("i"), F.coalesce(o, F.lit(0)).cast("long").alias("o"))) for i, o in sources]
    guess = F.struct(coarse_token_estimate(prompt).alias("i"), coarse_token_estimate(response).alias("o"))
    best = F.coalesce(*some, guess)
    return best["i"], best["o"]


def summary(usage: DataFrame, *by: str) -> DataFrame:
    """Calls, sums of tokens and cost, and tokens per call (0 without calls), over all or by columns (A1)."""
    total = F.coalesce(F.sum("total_tokens"), F.lit(0))
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        total.alias("total_tokens"),
        F.coalesce(F.sum("cost_total"), F.lit(0.0)).alias("cost_total"),
        F.coalesce(F.try_divide(total, F.count(F.lit(1))), F.lit(0.0)).alias("avg_tokens"),
    )


def log_usage(usage: DataFrame, path: str) -> None:
    """Append each call as one JSON object to the log under ``path`` (SNK11)."""
    usage.write.mode("append").json(path)
