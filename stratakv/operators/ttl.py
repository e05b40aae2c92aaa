"""Expiry: an entry's own TTL or the first matching prefix rule, whichever runs out first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.functions.codec import read_metadata
from stratakv.sources.oplog import age_over

Rules = list[tuple[str, int]]


def rule_ttl(key: Column, rules: Rules) -> Column:
    """Seconds of the first rule in declared order whose prefix the key has (not the longest prefix); null if none."""
    out = F.lit(None).cast("long")
    for prefix, seconds in reversed(rules):
        out = F.when(key.startswith(prefix), F.lit(seconds).cast("long")).otherwise(out)
    return out


def moment(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def expired(rules: Rules, as_of: datetime | str) -> Column:
    """Own TTL counts from the update, a rule from the creation; both strictly. Either one expires the entry."""
    now = moment(as_of)
    own = age_over(F.col("updated_at"), F.col("ttl_secs"), now)
    rule = age_over(F.col("created_at"), rule_ttl(F.col("key"), rules), now)
    return F.coalesce(own, F.lit(False)) | F.coalesce(rule, F.lit(False))


def expired_keys(entries: DataFrame, rules: Rules, as_of: datetime | str) -> DataFrame:
    """``key, reason``: an expired own TTL is named before a rule."""
    own = F.coalesce(age_over(F.col("updated_at"), F.col("ttl_secs"), moment(as_of)), F.lit(False))
    return entries.where(expired(rules, as_of)).select("key", F.when(own, "own").otherwise("rule").alias("reason"))


def expired_records(records: DataFrame, rules: Rules, as_of: datetime | str) -> DataFrame:
    """``expired_keys`` of ``key, raw``: stored records, whose values are not decoded. Records that can't be read stay."""
    meta = records.select("key", read_metadata("raw").alias("m")).where("m.error is null")
    return expired_keys(meta.select("key", "m.*"), rules, as_of)


def sweep(tiers: dict[str, DataFrame], rules: Rules, as_of: datetime | str, all_tiers: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tiers without expired keys, and these keys.

    Expired keys are looked for on disk only, as entries that moved to the object tier have no TTL; with
    ``all_tiers`` rules are applied to object entries too. They are removed from every tier.
    """
    gone = expired_keys(tiers["disk"], rules, as_of).select("key")
    if all_tiers and "object" in tiers:
        gone = gone.unionByName(expired_keys(tiers["object"].withColumn("updated_at", F.col("created_at")).withColumn("ttl_secs", F.lit(None).cast("long")), rules, as_of).select("key"))
    gone = gone.distinct()
    return {t: df.join(gone, "key", "left_anti") for t, df in tiers.items()}, gone
