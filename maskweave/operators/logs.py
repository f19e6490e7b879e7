"""The request log: pages, counts, quota, retention, health, and what goes into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 50
#: Ranges of keys that a log is counted in to find a page.
RANGES = 1_000


def page(log: DataFrame, number: int = 1, key: str = "id", size: int = PAGE) -> DataFrame:
    """The rows of one page, the latest first by a whole-number key; rows without a key come last.

    Counts by range of keys, RANGES rows at most, tell where the page lies; only rows of those ranges are sorted, so a
    late page costs no more than an early one.
    """
    ends = log.agg(F.min(key), F.max(key)).first()
    skip = (number - 1) * size
    if ends[0] is None:
        return log.offset(skip).limit(size)
    low, width = ends[0], (ends[1] - ends[0]) // RANGES + 1
    counted = log.filter(F.col(key).isNotNull()).groupBy(F.floor((F.col(key) - low) / width).alias("r")).agg(F.count("*").alias("n")).collect()
    before, chosen = 0, []
    for r in sorted(counted, key=lambda r: -r.r):
        if before + r.n > skip or chosen:
            chosen.append(r)
        else:
            before += r.n
        if before + sum(c.n for c in chosen) >= skip + size:
            break
    short = before + sum(c.n for c in chosen) < skip + size
    here = F.col(key).isNull() if short else F.lit(False)
    if chosen:
        here = here | ((F.col(key) >= low + chosen[-1].r * width) & (F.col(key) < low + (chosen[0].r + 1) * width))
    return log.filter(here).orderBy(F.col(key).desc_nulls_last()).offset(skip - before).limit(size)


def page_count(log: DataFrame, size: int = PAGE) -> DataFrame:
    return log.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def within_retention(log: DataFrame, now: Column, months: int, ts: str = "requested_at") -> DataFrame:
    """Rows not older than ``months`` (at least one) before now."""
    return log.filter(F.col(ts) >= F.add_months(now, -max(1, months)))


def quota_used(log: DataFrame, client: str = "client_id") -> DataFrame:
    return log.groupBy(client).agg(F.count("*").alias("used"))


def quota_state(used: DataFrame, quota: int) -> DataFrame:
    """used with ``refused``: a quota of 0 or less never is exhausted."""
    return used.withColumn("refused", F.lit(quota > 0) & (F.col("used") >= quota))


def outcomes(results: DataFrame, error: str = "error") -> DataFrame:
    """One row of a batch: how many files went well and how many failed, and the exit code, 2 if any failed."""
    counts = results.agg(F.count_if(F.col(error).isNull()).alias("done"), F.count_if(F.col(error).isNotNull()).alias("failed"))
    return counts.withColumn("exit_code", F.when(F.col("failed") > 0, 2).otherwise(0))


def license_health(licenses: DataFrame, today: Column) -> DataFrame:
    """licenses(org_name, expiry_date) with days_left and status; on its last day a licence already counts as expired here."""
    days = F.datediff("expiry_date", today)
    status = F.when(F.col("expiry_date").isNull(), "missing").when(days <= 0, "expired").when(days <= 30, "expiring_soon").otherwise("ok")
    return licenses.withColumn("days_left", days).withColumn("status", status)


LICENSE_SCHEMA = "OrgName string, LicenseId string, IssuedDate date, ExpiryDate date, MaxClients int, RequestQuota long, Features array<string>"


def license_of(envelope: Column) -> Column:
    """The licence in base64(JSON).base64(signature), as a struct; null fields where it cannot be read. The signature is not checked."""
    body = F.regexp_replace(F.split(F.coalesce(envelope, F.lit("")), "\\.")[0], "\\s", "")  # base64 may be in lines
    readable = F.when(body.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(body) % 4 == 0), F.unbase64(body))
    return F.from_json(F.coalesce(F.decode(readable, "UTF-8"), F.lit("{}")), LICENSE_SCHEMA)


def admits(licenses: DataFrame, today: Column) -> DataFrame:
    """Licences under which requests are served: through the last day."""
    return licenses.filter(F.col("expiry_date") >= today)


def by_key(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """requests(api_key, ...) with the active client whose key hash it has; others are left out."""
    active = clients.filter("is_active").select(F.col("id").alias("client_id"), "name", "api_key_hash")
    return requests.withColumn("api_key_hash", F.sha2("api_key", 256)).join(active, "api_key_hash").drop("api_key", "api_key_hash")


def entries(results: DataFrame, client_id: int | None, requested_at: Column, size_bytes: str = "length") -> DataFrame:
    """Log rows of redaction results: whole kilobytes, the fields hit as JSON or null."""
    fields = F.when(F.size("fields_hit") > 0, F.to_json("fields_hit"))
    return results.select(F.lit(client_id).cast("int").alias("client_id"), requested_at.alias("requested_at"), "file_name", F.floor(F.col(size_bytes) / 1024).cast("int").alias("file_size_kb"), fields.alias("fields_hit"), F.lit(None).cast("string").alias("error_msg"))


def parsed_fields(c: Column) -> Column:
    """fields_hit from its JSON; what cannot be read is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def totals(log: DataFrame, fields: DataFrame, patterns: DataFrame, clients: DataFrame) -> DataFrame:
    """One row of counts for a dashboard."""
    counted = [df.agg(F.count("*").alias(name)) for name, df in (("requests", log), ("fields", fields), ("patterns", patterns), ("clients", clients))]
    out = counted[0]
    for one in counted[1:]:
        out = out.join(one, F.lit(True))  # one row each
    return out
