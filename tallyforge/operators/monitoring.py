"""Request, step, security and usage logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price per 1000 tokens, in and out.
PRICES = {"gpt-4o": (0.0025, 0.01), "gpt-4o-mini": (0.00015, 0.0006), "gpt-5": (0.00125, 0.01), "gpt-5-mini": (0.00025, 0.002), "gpt-5-nano": (0.00005, 0.0004)}
DEFAULT_MODEL = "gpt-4o"


def pct(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part.cast("double") / whole * 100).otherwise(F.lit(0.0)), 2)


def statistics(requests: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Counts by status, success rate, mean time of completed requests, and the last 24 hours."""
    n = F.count("*")
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = [
        n.alias("total_requests"), is_("completed").alias("completed_requests"), is_("failed").alias("failed_requests"), is_("processing").alias("processing_requests"),
        pct(is_("completed"), n).alias("success_rate"), F.round(F.coalesce(F.avg(F.when(F.col("status") == "completed", F.col("processing_time"))), F.lit(0.0)), 2).alias("average_processing_time"),
    ]
    return requests.agg(*out, *([F.count_if(F.col("timestamp") >= as_of - F.expr("INTERVAL 1 DAY")).alias("recent_requests_24h")] if as_of is not None else []))


def within(requests: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return requests.where(F.col("timestamp") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def latest(requests: DataFrame, n: int, tie: str) -> DataFrame:
    """The newest ``n``; filters applied to the result see these only."""
    return requests.orderBy(F.desc("timestamp"), F.desc(tie)).limit(n)


def matching(requests: DataFrame, equal: Mapping[str, object], contains: Mapping[str, str]) -> DataFrame:
    """Conjunction of equalities and of contained texts, the latter without regard to case."""
    for c, v in equal.items():
        requests = requests.where(F.col(c) == F.lit(v))
    for c, v in contains.items():
        requests = requests.where(F.contains(F.lower(c), F.lit(v.lower())))
    return requests


def error_frequency(requests: DataFrame) -> DataFrame:
    failed = requests.where("status = 'failed'")
    return failed.groupBy(F.coalesce("error_details", F.lit("Unknown Error")).alias("error")).agg(F.count("*").alias("n"))


def performance(requests: DataFrame, hours: float, by: list[str]) -> DataFrame:
    """Completed requests by ``by``: count, mean, least and most time, and requests an hour.
    Requests without a time count in the throughput only."""
    t = F.col("processing_time")
    return requests.where("status = 'completed'").groupBy(*by).agg(
        F.count("*").alias("completed"), F.round(F.avg(t), 2).alias("avg_time"), F.round(F.min(t), 2).alias("min_time"), F.round(F.max(t), 2).alias("max_time"),
        F.round(F.count("*") / F.lit(float(hours)), 4).alias("per_hour"),
    )


def call_metrics(calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES, default: str = DEFAULT_MODEL) -> DataFrame:
    """Costs, per-page figures and levels of each call; unknown models pay the default's price."""

    def price(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[i])])
        return F.coalesce(F.try_element_at(table, F.col("model")), F.lit(prices[default][i]))

    pages = F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1))
    c = calls.withColumn("input_cost", F.round(F.col("prompt_tokens") / 1000 * price(0), 6)).withColumn("output_cost", F.round(F.col("completion_tokens") / 1000 * price(1), 6))
    c = c.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("total_cost", F.round(F.col("input_cost") + F.col("output_cost"), 6))
    c = c.withColumn("cost_per_page", F.round(F.col("total_cost") / pages, 6)).withColumn("tokens_per_page", F.round(F.col("total_tokens") / pages, 6))
    return c.withColumn("cost_level", F.when(F.col("total_cost") <= 0.005, "low").when(F.col("total_cost") <= 0.05, "medium").otherwise("high"))


def time_level(seconds_per_page: Column) -> Column:
    return F.when(seconds_per_page <= 1, "fast").when(seconds_per_page <= 3, "average").otherwise("slow")


def usage_by(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("total_tokens").cast("long").alias("tokens"), F.round(F.sum("total_cost"), 4).alias("cost"))


def usage_details(calls: DataFrame, keys: list[str], kind: str, at: str) -> DataFrame:
    """``usage_by`` with the kinds of the calls, sorted, and the last time."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("total_tokens").cast("long").alias("tokens"), F.round(F.sum("total_cost"), 4).alias("cost"), F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("kinds"), F.max(at).alias("last_seen")
    )


def batch_results(items: DataFrame, batch: str, ok: Column, seconds: str) -> DataFrame:
    """Per batch: how many, succeeded, failed, and the seconds in all."""
    return items.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 2).alias("seconds"))


def mean_confidence(pages: DataFrame, doc: str, confidence: str) -> DataFrame:
    """The mean confidence of each document's pages, and of all documents (null)."""
    per = pages.groupBy(doc).agg(F.avg(confidence).alias("confidence"))
    return per.unionByName(per.agg(F.avg("confidence").alias("confidence")).select(F.lit(None).cast(pages.schema[doc].dataType).alias(doc), "confidence"))


def ledger_summary(ledger: DataFrame, message: str) -> DataFrame:
    """How many messages were read, and how many files they held."""
    return ledger.agg(F.count_distinct(message).alias("messages"), F.count("*").alias("files"))


def active_requests(updates: DataFrame, key: str, order: list[str], status: str, terminal: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """The last update of each request that has not ended."""
    return latest_state(updates, key, order).where(~F.col(status).isin(*terminal))


def security_stats(events: DataFrame, scan: str, action: str) -> DataFrame:
    """Totals over all, by scan status and by action, in one pass."""
    g = events.groupingSets([[], [F.col(scan)], [F.col(action)]], F.col(scan), F.col(action))
    return g.agg(F.grouping_id().alias("gid"), F.count("*").alias("n")).select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "scan_status").otherwise("action").alias("kind"), F.coalesce(F.when(F.col("gid") != 2, F.col(scan)), F.when(F.col("gid") == 2, F.col(action))).alias("value"), "n"
    )


def latest_state(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last update of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def step_durations(steps: DataFrame, keys: list[str], kind: str, at: str) -> DataFrame:
    """Seconds from the first start to the last completion of each step."""
    begin, end = F.min(F.when(F.col(kind) == "start", F.col(at))), F.max(F.when(F.col(kind) == "complete", F.col(at)))
    g = steps.groupBy(*keys).agg(begin.alias("b"), end.alias("e")).where("b IS NOT NULL AND e IS NOT NULL AND e >= b")
    return g.select(*keys, (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("b").cast("timestamp"))).alias("duration_us"))


def expired(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows past their retention."""
    return rows.where(F.col(at) < as_of - F.make_dt_interval(days=F.lit(days)))


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects; the new one's keys win."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    o, n = parse(old), parse(new)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def request_steps(requests: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Requests with their steps, a row per step; requests without steps drop out."""
    return requests.join(steps, key)


def resolved_paths(names: DataFrame, name: str, cache: DataFrame) -> DataFrame:
    """Each file name with its path in ``cache`` (file, path), null if it has none; of several
    paths the least."""
    known = cache.groupBy(F.col("file").alias("__f")).agg(F.min("path").alias("path"))
    return names.join(known, F.col(name) == F.col("__f"), "left").drop("__f")


def with_call(requests: DataFrame, calls: str, new: Column) -> DataFrame:
    """Requests whose list of model calls has one more, with the totals over all of them."""
    every = F.array_append(F.coalesce(F.col(calls), F.array().cast(requests.schema[calls].dataType)), new)
    tokens = lambda c: F.coalesce(c["prompt_tokens"], F.lit(0)) + F.coalesce(c["completion_tokens"], F.lit(0))
    out = requests.withColumn(calls, every)
    return out.withColumns({
        "total_ai_tokens": F.aggregate(calls, F.lit(0).cast("long"), lambda a, c: a + tokens(c)), "total_ai_cost": F.aggregate(calls, F.lit(0.0), lambda a, c: a + F.coalesce(c["total_cost"], F.lit(0.0))),
    })


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """A log after more entries; columns that an entry lacks are null, and none is replaced."""
    return log.unionByName(entries.select(*[c for c in entries.columns if c in log.columns]), allowMissingColumns=True)


def poll_interval(polls: DataFrame, part: str, order: str, found: str, base: float, patience: int = 3, most: float = 300) -> DataFrame:
    """The seconds to wait after each poll: ``base``, doubled for every empty poll in a row from
    the ``patience``-th on, up to ``most``; a poll that finds something starts anew."""
    w = Window.partitionBy(part).orderBy(order)
    run = F.count_if(F.col(found) > 0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = polls.withColumn("__run", run)
    empty = F.count_if(F.col(found) == 0).over(Window.partitionBy(part, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    doubled = F.lit(float(base)) * F.pow(F.lit(2.0), F.least(empty - patience + 1, F.lit(60)))
    return p.withColumn("wait", F.when(empty >= patience, F.least(doubled, F.lit(float(most)))).otherwise(F.lit(float(base)))).drop("__run")
