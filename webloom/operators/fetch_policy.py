"""Fetch policy as expressions and folds: status classes, caching, rate limits, retries, robots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import addresses, fixed, urls


def status_class(status: Column) -> dict[str, Column]:
    """error_class and retryable of a response status."""
    kind = F.when(status == 429, "rate_limit").when(status >= 500, "server").when(status >= 400, "client").otherwise("ok")
    return {"error_class": kind, "retryable": kind.isin("rate_limit", "server")}


def cache_directives(value: Column) -> Column:
    """A Cache-Control header as a map from lower-case directive to value."""
    return F.transform_keys(F.str_to_map(F.lower(value), F.lit(","), F.lit("=")), lambda k, _: F.trim(k))


def cache_ttl(headers: Column, default: int = 300) -> Column:
    """Seconds that a response stays fresh: max-age, 0 if it must be checked again, else the default."""
    found = cache_directives(F.coalesce(F.try_element_at(headers, F.lit("cache-control")), F.lit("")))
    age = F.trim(F.try_element_at(found, F.lit("max-age"))).try_cast("int")
    return F.when(F.map_contains_key(found, "no-cache"), 0).otherwise(F.coalesce(age, F.lit(default)))


def cacheable(method: Column, status: Column, headers: Column, request_headers: Column) -> Column:
    """Whether a response may be stored."""
    found = cache_directives(F.coalesce(F.try_element_at(headers, F.lit("cache-control")), F.lit("")))
    auth = F.exists(F.map_keys(request_headers), lambda k: F.lower(k).isin(*fixed.AUTH_HEADERS))
    return (
        F.upper(method).isin("GET", "HEAD") & status.isin(*fixed.CACHEABLE_STATUS) & ~F.map_contains_key(found, "no-store") & ~auth
    )


def cache_key(method: Column, url: Column) -> Column:
    return F.sha2(F.concat(F.upper(method), F.lit(":"), url), 256)


def redacted(headers: Column) -> Column:
    """Headers with the values of secrets masked."""
    secret = lambda k: F.lower(k).isin(*fixed.REDACTED_HEADERS) | F.lower(k).rlike(fixed.REDACTED_NAMES)
    return F.transform_values(
        headers,
        lambda k, v: F.when(secret(k), F.concat(F.lit("<redacted: "), F.char_length(v).cast("string"), F.lit(" bytes>"))).otherwise(v),
    )


def captured(
    log: DataFrame, resource_types: list[str] | None = None, content_types: list[str] | None = None, least_status: int = 200, most_bytes: int | None = None
) -> DataFrame:
    """The responses of (status, resource_type, content_type, content_length, ...) that are worth keeping.

    Redirects and statuses below ``least_status`` are not. ``resource_types`` are equal, ``content_types`` are beginnings, whatever their case; None lets all
    pass. A response without a length passes ``most_bytes``, its body has to be held against it.
    """
    status, kind = F.col("status"), F.lower(F.trim("content_type"))
    kept = (status >= least_status) & ((status < 300) | (status >= 400))
    if resource_types is not None:
        kept = kept & F.lower("resource_type").isin([t.lower() for t in resource_types])
    if content_types is not None:
        begins = F.lit(False)
        for one in content_types:
            begins = begins | F.startswith(kind, F.lit(one.strip().lower()))
        kept = kept & begins
    if most_bytes is not None:
        kept = kept & F.coalesce(F.col("content_length") <= most_bytes, F.lit(True))
    return log.filter(kept)


def retry_schedule(max_retries: int = 3, initial: float = 1.0, base: float = 2.0, longest: float = 60.0) -> Column:
    """array<struct<attempt, delay, least, most>>: the waits before each retry, with the bounds of their jitter."""

    def step(n: Column) -> Column:
        delay = F.least(F.lit(initial) * F.pow(F.lit(base), n), F.lit(longest))
        return F.struct(n.alias("attempt"), delay.alias("delay"), (delay * 0.5).alias("least"), (delay * 1.5).alias("most"))

    return F.transform(F.sequence(F.lit(0), F.lit(max_retries - 1)), step)


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header; null for a date."""
    return F.trim(value).try_cast("double")


#: The special-purpose networks of both families that are never fetched from (True), and the parts of them
#: that anyone can reach (False). The narrowest network that an address lies in decides. 64:ff9b::/96 and 2002::/16 hold IPv4 addresses.
SPECIAL_NETWORKS = (
    ("0.0.0.0/8", True),
    ("10.0.0.0/8", True),
    ("100.64.0.0/10", True),
    ("127.0.0.0/8", True),
    ("169.254.0.0/16", True),
    ("172.16.0.0/12", True),
    ("192.0.0.0/24", True),
    ("192.0.0.9/32", False),
    ("192.0.0.10/32", False),
    ("192.0.2.0/24", True),
    ("192.168.0.0/16", True),
    ("198.18.0.0/15", True),
    ("198.51.100.0/24", True),
    ("203.0.113.0/24", True),
    ("224.0.0.0/4", True),
    ("240.0.0.0/4", True),
    ("::/128", True),
    ("::1/128", True),
    ("64:ff9b::/96", True),
    ("64:ff9b:1::/48", True),
    ("100::/64", True),
    ("2001::/23", True),
    ("2001:1::1/128", False),
    ("2001:1::2/128", False),
    ("2001:3::/32", False),
    ("2001:4:112::/48", False),
    ("2001:20::/28", False),
    ("2001:30::/28", False),
    ("2001:db8::/32", True),
    ("2002::/16", True),
    ("3fff::/20", True),
    ("fc00::/7", True),
    ("fe80::/10", True),
    ("fec0::/10", True),
    ("ff00::/8", True),
)
#: Names of the machine itself and of metadata services.
CLOSED_HOSTS = ("localhost", "metadata", "metadata.google.internal", "instance-data")
_NUMBERS = r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]*))*$"


def policy_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a last dot; an IPv6 address without its brackets."""
    host = F.lower(F.regexp_replace(F.regexp_replace(urls.netloc(url), "^.*@", ""), r":\d*$", ""))
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^\[(.*)\]$", "$1")


def _listed(host: Column, address: Column, entries: list[str]) -> Column:
    """Whether a host is an entry, ends with one that begins with a dot, or lies in a network of one."""
    hit = F.lit(False)
    for entry in filter(None, (e.strip().lower() for e in entries)):
        if known := addresses.network(entry):
            hit = hit | addresses.within(address, *known)
        elif entry.startswith("."):
            hit = hit | host.endswith(entry)
        else:
            hit = hit | (host == entry)
    return hit


def host_allowed(host: Column, allowed_hosts: list[str] | None = None) -> Column:
    """Whether a host may be reached: a name that isn't local, an address outside of SPECIAL_NETWORKS, or one that is allowed.

    ``allowed_hosts`` are hosts, suffixes (``.example.com``) and networks of both families (``10.0.0.0/24``, ``fd00::/8``). What could be
    an address but is none in full (``127.1``, ``2130706433``, ``0x7f.1``, a zone) isn't open.
    """
    closed_or_open = list(SPECIAL_NETWORKS)

    def passes(x: Column) -> Column:
        host, address = x["host"], x["address"]
        named = host.isin("", *CLOSED_HOSTS) | host.rlike(r"\.(local|internal|localhost)$")
        odd = address.isNull() & (host.rlike(_NUMBERS) | host.rlike(r"[:%\[]"))
        closed = F.coalesce(addresses.first_match(address, closed_or_open), F.lit(False))
        return F.coalesce((~named & ~odd & ~closed) | _listed(host, address, allowed_hosts or []), F.lit(False))

    both = lambda h: addresses.let(F.struct(h.alias("host"), addresses.digits(h).alias("address")), passes)
    return addresses.let(host, both)


def url_allowed(url: Column, allowed_hosts: list[str] | None = None) -> Column:
    """Whether a URL may be fetched: http or https to a host that ``host_allowed`` lets pass; a null isn't."""
    return F.coalesce(F.lower(urls.scheme(url)).isin("http", "https") & host_allowed(policy_host(url), allowed_hosts), F.lit(False))


def _grouped_rules(docs: DataFrame) -> DataFrame:
    """host, section, agent, pos, allow, path of robots.txt bodies (host, body); a section is a group of agents with its rules."""
    lines = docs.select("host", F.posexplode(F.split("body", "\r\n|[\r\n]")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    key, value = F.lower(F.trim(F.regexp_extract(line, "^([^:]+):", 1))), F.trim(F.regexp_extract(line, "^[^:]+:(.*)$", 1))
    rows = lines.select("host", "pos", key.alias("key"), value.alias("value")).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("pos")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = rows.withColumn("starts", starts.cast("int")).withColumn("section", F.sum("starts").over(order))
    agents = grouped.filter("key = 'user-agent'").select("host", "section", F.lower("value").alias("agent"))
    rules = grouped.filter("key <> 'user-agent'").select("host", "section", "pos", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, ["host", "section"])


def robots_rules(docs: DataFrame) -> DataFrame:
    """host, agent, pos, allow, path of robots.txt bodies (host, body), in file order.

    Agents that follow one another share the rules after them.
    """
    return _grouped_rules(docs).drop("section").filter("path <> '' OR NOT allow")


def robots_allowed(requests: DataFrame, docs: DataFrame, agent: str = "*") -> DataFrame:
    """requests (url, ...) with ``allowed``: the first matching rule of the agent's group, in file order, decides.

    The group is the first one that names the agent, also by a part of its name, else the first of ``*``. Without
    robots.txt, a group or a match a URL is allowed. Other columns stay as they are, but one named ``allowed`` is replaced.
    """
    rules = _grouped_rules(docs)
    name = agent.lower().split("/")[0]
    own = (F.col("agent") != "*") & (F.col("agent") != "") & F.lit(name).contains(F.col("agent"))
    rank = F.when(own, 0).when(F.col("agent") == "*", 1)
    known = rules.withColumn("group", F.struct(rank.alias("rank"), "section")).filter(rank.isNotNull())
    chosen = known.withColumn("best", F.min("group").over(Window.partitionBy("host"))).filter("group = best AND (path <> '' OR NOT allow)")
    distinct = requests.select("url").distinct().withColumn("host", F.lower(urls.netloc(F.col("url"))))
    target = F.concat(F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url"))), F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise(""))
    met = distinct.withColumn("target", target).join(chosen.select("host", "pos", "allow", "path"), "host").filter((F.col("path") == "") | F.startswith("target", "path"))
    verdict = met.groupBy("url").agg(F.min_by(F.when(F.col("path") == "", True).otherwise(F.col("allow")), "pos").alias("verdict"))
    kept = [c for c in requests.columns if c != "allowed"]
    asked = requests.select("url", F.struct(*kept).alias("row"))
    return asked.join(verdict, "url", "left").select("row.*", F.coalesce("verdict", F.lit(True)).alias("allowed"))


def token_bucket(requests: DataFrame, rate: float = 10.0, burst: int = 10, key: str = "key", at: str = "ts") -> DataFrame:
    """key, n_requests, n_waited, total_wait of each bucket, its requests folded in order.

    The first request leaves burst - 1 tokens; a request without a token waits for the
    next one, after which one more try is made whose outcome doesn't matter. The fold
    keeps a bucket's times only, as doubles, in one row.
    """
    times = F.array_sort(F.collect_list((F.unix_micros(F.col(at).cast("timestamp")) / 1e6)))
    kind = "struct<tokens:double,last:double,waited:bigint,wait:double>"

    def step(state: Column, now: Column) -> Column:
        now = F.greatest(now, state["last"])
        filled = F.least(F.lit(float(burst)), state["tokens"] + (now - state["last"]) * rate)
        ok = filled >= 1
        wait = (1 - filled) / rate
        # After the wait the bucket holds one token, which the second try takes.
        return F.when(
            ok,
            F.struct((filled - 1).alias("tokens"), now.alias("last"), state["waited"].alias("waited"), state["wait"].alias("wait")),
        ).otherwise(
            F.struct(F.lit(0.0).alias("tokens"), (now + wait).alias("last"), (state["waited"] + 1).alias("waited"), (state["wait"] + wait).alias("wait"))
        ).cast(kind)

    first = F.struct(F.lit(float(burst)).alias("tokens"), F.col("times")[0].alias("last"), F.lit(0).alias("waited"), F.lit(0.0).alias("wait")).cast(kind)
    folded = requests.groupBy(key).agg(times.alias("times")).withColumn("end", F.aggregate("times", first, step))
    return folded.select(
        key, F.size("times").cast("long").alias("n_requests"), F.col("end.waited").alias("n_waited"), F.col("end.wait").alias("total_wait")
    )


def cache_hits(requests: DataFrame, ttl: Column, key: str = "key", at: str = "ts") -> DataFrame:
    """key, n_requests, n_hits: requests that met a fresh response. An entry lives ``ttl`` seconds from its store.

    The fold keeps a key's times only, and counts.
    """
    kind = "struct<until:double,hits:bigint>"
    times = F.array_sort(F.collect_list(F.struct((F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), ttl.cast("double").alias("ttl"))))

    def step(state: Column, r: Column) -> Column:
        hit = F.coalesce(r["t"] < state["until"], F.lit(False))
        return F.struct(
            F.when(hit, state["until"]).otherwise(r["t"] + r["ttl"]).alias("until"), (state["hits"] + hit.cast("bigint")).alias("hits")
        ).cast(kind)

    start = F.struct(F.lit(None).cast("double").alias("until"), F.lit(0).alias("hits")).cast(kind)
    folded = requests.groupBy(key).agg(times.alias("times"))
    return folded.select(key, F.size("times").cast("long").alias("n_requests"), F.aggregate("times", start, step, lambda s: s["hits"]).alias("n_hits"))
