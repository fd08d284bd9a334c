"""Streams of fetches: rate limits, freshness, deduplication and correlation with state by key.

Every function takes and returns a streaming DataFrame (most of them also work on a
batch one) and leaves sources, sinks and checkpoints to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _forget_at(state: GroupState, last: float, late_s: float) -> None:
    """Let a key's state go once the watermark has passed its last event."""
    state.setTimeoutTimestamp(int(max((last + late_s) * 1000, state.getCurrentWatermarkMs() + 1)))


def rate_limited(
    requests: DataFrame, rate: float = 10.0, burst: int = 10, wait_on_limit: bool = True, late_s: int = 3600
) -> DataFrame:
    """key, ts, wait, allowed for each request of (key, ts): a token bucket by key.

    A bucket starts with ``burst`` tokens and gains ``rate`` a second. State is two
    numbers a key, and goes when the watermark is ``late_s`` seconds past the key's last request.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(burst), None)
        times = sorted(t for batch in batches for t in batch["ts"])
        waits = []
        for t in times:
            now = t.timestamp() if last is None else max(t.timestamp(), last)
            tokens = tokens if last is None else min(float(burst), tokens + (now - last) * rate)
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens, last = (tokens - 1, now) if not wait else (0.0, now + wait)
            waits.append(wait)
        state.update((tokens, last))
        _forget_at(state, last, late_s)
        allowed = [wait_on_limit or not w for w in waits]
        yield pd.DataFrame({"key": key[0], "ts": times, "wait": waits, "allowed": allowed})

    timed = requests.select("key", "ts").withWatermark("ts", f"{late_s} seconds")
    return timed.groupBy("key").applyInPandasWithState(
        step, "key string, ts timestamp, wait double, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def cached(requests: DataFrame, default_ttl: float = 300.0, late_s: int = 3600, buckets: int = 1024) -> DataFrame:
    """key, ts, hit for each request of (key, ts, ttl): whether a stored response was still fresh.

    Keys are dealt to buckets, as a call of Python for each of them costs far more than its requests. State is the end of
    each fresh entry of a bucket; an entry goes when the watermark has passed its end, and a bucket ``late_s`` seconds after its last.
    """

    def step(_: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        times = (rows["us"] / 1e6).tolist()
        hits = []
        for key, now, ttl in zip(rows["key"].tolist(), times, rows["ttl"].fillna(default_ttl).tolist(), strict=True):
            hits.append(now < until.get(key, float("-inf")))
            if not hits[-1]:
                until[key] = now + ttl
        last = max(times[-1], *until.values())
        passed = state.getCurrentWatermarkMs() / 1000
        fresh = {key: end for key, end in until.items() if end > passed}
        state.update((list(fresh), list(fresh.values())))
        _forget_at(state, last, late_s)
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "ts": rows["ts"].to_numpy(), "hit": hits})

    timed = requests.select("key", "ts", F.unix_micros("ts").alias("us"), F.col("ttl").cast("double")).withWatermark("ts", f"{late_s} seconds")
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(
        step, "key string, ts timestamp, hit boolean", "keys array<string>, ends array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def new_items(items: DataFrame, key: str = "guid", at: str = "published", late: str = "7 days") -> DataFrame:
    """Feed items not seen before; a key is remembered as long as late items are let in."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, by: Column | str, at: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events a window and key, tumbling or sliding; events later than the watermark are left out."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counted = events.withWatermark(at, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *[c for c in counted.columns if c not in ("w", "n")], "n")


def sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, closed by a gap without events."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def answered(requests: DataFrame, responses: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Requests with the responses of their id that follow within a time: a join of two streams."""
    left = requests.withWatermark("ts", within).alias("q")
    right = responses.select(F.col("id").alias("r_id"), F.col("ts").alias("r_ts"), "status").withWatermark("r_ts", within).alias("r")
    return left.join(right, F.expr(f"id = r_id AND r_ts >= ts AND r_ts <= ts + INTERVAL {within}"), "inner")
