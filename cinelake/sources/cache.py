"""A cache of provider responses as Parquet tables: latest wins, ages decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def latest(rows: DataFrame, keys: list[str], at: str = "fetched_at_ms", tie: str | None = None) -> DataFrame:
    """One row a key: the latest, by an aggregate that combines before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(at, *([tie] if tie else []))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows replaced those of their key; an equal time goes to the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, tie="_new").drop("_new")


def freshness(age_ms: Column, ttl_days: float, stale_days: float | None = None) -> Column:
    """fresh within its time, stale if still good enough when the network fails, else expired."""
    stale = (age_ms <= stale_days * DAY_MS) if stale_days is not None else F.lit(False)
    return F.when(age_ms <= ttl_days * DAY_MS, "fresh").when(stale, "stale").otherwise("expired")


def purge(rows: DataFrame, provider: str, now_ms: Column, days: float = 183) -> DataFrame:
    """Without one provider's rows older than it allows."""
    return rows.filter(~((F.col("provider") == provider) & (now_ms - F.col("fetched_at_ms") > days * DAY_MS)))


def retry_after_ms(headers: Column, now_ms: Column) -> Column:
    """How long a provider's headers ask to wait: seconds to wait, a time in seconds or milliseconds, or a spent allowance."""
    number = lambda name: F.try_element_at(headers, F.lit(name)).try_cast("double")
    reset = number("x-ratelimit-reset")
    wait = F.when(reset > 1e12, reset - now_ms).when(reset > 1e9, reset * 1000 - now_ms).otherwise(reset * 1000)
    spent = F.when(number("x-ratelimit-remaining") <= 0, F.coalesce(wait, F.lit(1000.0)))
    asked = F.coalesce(number("retry-after") * 1000, spent)
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.0), asked))


def source_status(needs_key: Column, has_key: Column, outcome: Column) -> Column:
    """How a provider stands: without its key, refused, out of reach, or ready. outcome: of its last request, null before the first."""
    return F.when(needs_key & ~has_key, "needsKey").when(outcome == "unauthorized", "rejected").when(outcome.isin("network", "rateLimited"), "unavailable").otherwise("ready")
