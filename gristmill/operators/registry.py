"""The model dimension: selection, inferred attributes and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import schemas

# fixed values: substrings of an id and the points they give, the first that matches
NAME_TIERS = [(("gpt-4", "claude-3", "claude-4", "opus"), 10.0), (("turbo", "pro", "large"), 5.0)]
# fixed values: substrings of an id and the provider they name, tried in order
PROVIDERS = [(("openai/", "gpt"), "openai"), (("anthropic/", "claude"), "anthropic"), (("mistralai/", "mistral"), "mistral"), (("google/", "gemini"), "google"), (("deepseek/", "deepseek"), "deepseek"), (("meta-llama/", "llama"), "meta")]


def configured_models(names: str) -> list[str]:
    """A comma list, stripped, blanks dropped; none at all is an error."""
    found = [n.strip() for n in names.split(",") if n.strip()]
    if not found:
        raise ValueError("no models are configured")
    return found


def select_models(models: DataFrame, capabilities: list[str] | None = None, least_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """Available models with all capabilities and at least the score, best first, ties by id."""
    rows = models.filter(F.col("is_available") & (F.col("performance_score") >= least_score))
    for c in capabilities or []:
        rows = rows.filter(F.array_contains("capabilities", c))
    rows = rows.orderBy(F.desc("performance_score"), "id")
    return rows.limit(limit) if limit else rows


def infer_provider(provider: Column, model_id: Column) -> Column:
    low, out = F.lower(model_id), F.lit("unknown")
    for terms, name in reversed(PROVIDERS):
        out = F.when(F.contains(low, F.lit(terms[0])) | F.contains(low, F.lit(terms[1])), name).otherwise(out)
    return F.when(provider.isNull() | (provider == "unknown"), out).otherwise(provider)


def context_bucket(length: Column) -> Column:
    return F.when(length < 8000, "small").when(length < 32000, "medium").when(length < 128000, "large").otherwise("very_large")


def inferred_capabilities(capabilities: Column, length: Column) -> Column:
    """Declared capabilities and the one that the context length gives, sorted."""
    extra = F.when(length > 128000, F.array(F.lit("very_large_context"))).when(length > 32000, F.array(F.lit("large_context"))).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_union(F.coalesce(capabilities, F.array().cast("array<string>")), extra))


def model_statistics(models: DataFrame) -> DataFrame:
    """(grouping, value, models): by provider, capability, context size, score band and availability, in one pass."""
    score = F.col("performance_score")
    single = F.array(
        F.struct(F.lit("provider").alias("grouping"), F.coalesce("provider", F.lit("unknown")).alias("value")),
        F.struct(F.lit("context").alias("grouping"), context_bucket(F.col("context_length")).alias("value")),
        F.struct(F.lit("score").alias("grouping"), F.when(score < 0.3, "low").when(score < 0.7, "medium").otherwise("high").alias("value")),
        F.struct(F.lit("available").alias("grouping"), F.col("is_available").cast("string").alias("value")),
    )
    listed = F.transform(inferred_capabilities(F.col("capabilities"), F.col("context_length")), lambda c: F.struct(F.lit("capability").alias("grouping"), c.alias("value")))
    return models.select(F.inline(F.concat(single, listed))).groupBy("grouping", "value").agg(F.count(F.lit(1)).alias("models"))


def model_score(model_id: Column, context_length: Column, cutoff: Column, now: Column) -> Column:
    """Points for context (a point for 5,000 tokens, at most 20), for a recent cutoff (10, less one for 100 days, at least 0) and for the name. Cutoffs that are no full date give none. Prices play no part."""
    day = F.when(cutoff.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(cutoff, 1, 10)).try_cast("date")
    recent = F.coalesce(F.greatest(F.lit(0.0), 10 - F.datediff(now.cast("date"), day) / 100), F.lit(0.0))
    tier = F.lit(0.0)
    for names, points in reversed(NAME_TIERS):
        found = F.lit(False)
        for name in names:
            found = found | F.contains(F.lower(F.coalesce(model_id, F.lit(""))), F.lit(name))
        tier = F.when(found, points).otherwise(tier)
    return F.least(F.coalesce(context_length, F.lit(0)) / 5000, F.lit(20.0)) + recent + tier


def to_json(models: DataFrame) -> DataFrame:
    """(id, json): each model as one JSON object, nulls left out."""
    return models.select("id", F.to_json(F.struct(*models.columns)).alias("json"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Models of JSON objects in the fixed schema; what is absent is null, an object that cannot be read is an error."""
    return rows.select(F.from_json(column, schemas.MODEL, {"mode": "FAILFAST"}).alias("m")).select("m.*")
