"""Queries of fetch policy, discovery and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import discovery, fetch_policy
from webloom.operators.links import extract_links
from webloom.plans.common import host, part, table
from webloom.sources import feeds, rendered
from webloom.sources.rendered import text



def status_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fetch_policy.status_class(F.col("status"))
    return rendered.http_observations(spark, sf_dir).select("id", "status", *[c.alias(k) for k, c in told.items()])


def cache_control_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rendered.http_observations(spark, sf_dir)
    asked = F.when(F.col("id") % 9 == 0, F.create_map(F.lit("Cookie"), F.lit("a"))).otherwise(F.create_map(F.lit("accept"), F.lit("*")))
    stored = fetch_policy.cacheable(F.lit("get"), F.col("status"), F.col("headers"), asked)
    key = fetch_policy.cache_key(F.lit("get"), F.col("url"))
    return seen.select("id", fetch_policy.cache_ttl(F.col("headers")).alias("ttl"), stored.alias("cacheable"), key.alias("cache_key"))


def header_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered.http_observations(spark, sf_dir).select("id", F.explode(fetch_policy.redacted(F.col("headers"))).alias("header", "value"))
    return rows.filter(F.col("value").startswith("<redacted"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before the retries of every failed fetch that may be retried."""
    failed = rendered.http_observations(spark, sf_dir).filter(fetch_policy.status_class(F.col("status"))["retryable"])
    waits = failed.select("id", F.explode(fetch_policy.retry_schedule()).alias("r"))
    return waits.select("id", "r.attempt", "r.delay", "r.least", "r.most")


def url_policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses counted up from customer keys, of which some are private."""
    k = F.col("c_custkey")
    nets = ["10.{}", "172.{}", "192.168", "8.8", "169.254", "127.0", "100.64", "203.0"]
    first = F.element_at(F.array(*[F.lit(n.replace("{}", "1")) for n in nets]), (k % 8 + 1).cast("int"))
    second = F.when(k % 8 == 1, text("172.", k % 40)).otherwise(first)
    scheme = F.when(k % 11 == 0, "ftp").otherwise("https")
    url = text(scheme, "://", second, ".", k % 250, ".", k % 200, ":8080/x")
    return table(spark, sf_dir, "customer").select(k.alias("id"), fetch_policy.url_allowed(url).alias("allowed"))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user folded through a bucket of one request in 1000 seconds, burst 2."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    folded = fetch_policy.token_bucket(events, rate=0.001, burst=2)
    return folded.select("key", "n_requests", "n_waited", F.round("total_wait", 3).alias("total_wait"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache whose entries live an hour, for each user and event type."""
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    return fetch_policy.cache_hits(events, F.lit(3600.0))


def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    path = F.when(key % 3 == 0, text("/private/", F.col("c_nationkey"), "/x")).otherwise(text("/open/", key))
    asked = table(spark, sf_dir, "customer").select(text("https://n", F.col("c_nationkey"), ".example.com", path, "?k=", key).alias("url"))
    checked = fetch_policy.robots_allowed(asked, rendered.robots_docs(spark, sf_dir))
    bad = fetch_policy.robots_allowed(asked, rendered.robots_docs(spark, sf_dir), "BadBot/1.0")
    return checked.join(bad.select("url", F.col("allowed").alias("bad_allowed")), "url")


def url_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = discovery.matches_patterns(F.col("url"), ["^/en/", "^/fr/", "(unclosed", "(a+)+b"], [r"\.html$"])
    return table(spark, sf_dir, "pages").filter(kept).select("page_id", "url")


def captured_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rendered.request_log(spark, sf_dir).filter("kind = 'response'")
    kept = fetch_policy.captured(log, ["document", "xhr"], ["application/json", "text/html"], most_bytes=1_048_576)
    return kept.select("id", "resource_type", "content_length")


def request_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.correlate(rendered.request_log(spark, sf_dir)).groupBy("session_id").agg(
        F.count("*").alias("responses"), F.count("request_id").alias("matched"), F.sum("request_id").alias("request_ids")
    )


def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded site: the page of customer k links to those of 2k and 2k + 1, some of which are missing."""
    k = F.col("c_custkey")
    html = text('<html><body><a href="/c/', 2 * k, '">a</a><a href="x/../../../c/', 2 * k + 1, '?x=1#y">b</a><a href="#top">t</a>',
                '<a href="https://other.example.com/c/1">o</a></body></html>')
    pages = table(spark, sf_dir, "customer").filter((k > 0) & (k % 13 != 0))
    return pages.select(k.alias("page_id"), text("https://www.site.example.com/c/", k, "/").alias("url"), html.alias("html"))


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("https://www.site.example.com/c/1",)], "url string")
    found = discovery.crawl(tree_pages(spark, sf_dir), start, max_depth=5)
    return found.withColumn("page_id", F.coalesce("page_id", F.lit(-1)))


def crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.crawl_summary(crawl_bfs(spark, sf_dir))


def _shop_urls(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    entries = feeds.sitemap_entries(rendered.sitemap_files(spark, sf_dir)).filter("NOT is_index")
    entries = entries.withColumn("seq", F.regexp_extract("loc", r"(\d+)$", 1).cast("long"))
    links = extract_links(
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("page_id"), F.lit("https://shop.example.com/p/1").alias("url"),
            text('<nav><a href="/p/', F.col("p_partkey"), '">x</a><a href="/q/', F.col("p_partkey"), '">y</a></nav>').alias("html"),
        )
    ).withColumn("seq", F.col("page_id") * 10 + F.col("pos"))
    found = discovery.discover_urls(entries, links, "shop.example.com", ["^/[pq]/"], ["5$"])
    return found.select("url", "source", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"), "link_type", *more)


def discover_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap entries of the shop with the links of its pages, with the depth at which they were found."""
    return _shop_urls(spark, sf_dir, "depth")


def discover_all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sitemap entries of the shop with all links of its pages."""
    return _shop_urls(spark, sf_dir)


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rendered.http_observations(spark, sf_dir)
    wanted = seen.select("url")
    told = discovery.batch_outcomes(wanted, seen.filter("id % 5 <> 0").select("url", "status"))
    return told.groupBy("error").agg(F.count("*").alias("n"))


def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k redirects to k / 2 while k is even."""
    k = F.col("p_partkey")
    hops = table(spark, sf_dir, "part").filter((k % 2 == 0) & (k > 0)).select(k.cast("string").alias("source"), (k / 2).cast("long").cast("string").alias("target"))
    start = table(spark, sf_dir, "part").filter(k > 0).select(k.cast("string").alias("url"))
    return discovery.redirect_targets(hops, start, most=4)


QUERIES = {
    f.__name__: f
    for f in (
        status_taxonomy, cache_control_ttl, header_redaction, retry_schedule, url_policy_gate, token_bucket, cache_hits, robots_filter,
        url_pattern_filter, captured_responses, request_correlation, crawl_bfs, crawl_totals, discover_urls, discover_all_urls, batch_outcomes, redirect_chain,
    )
}

_STATUS = "[200, 301, 404, 429, 500, 503, 403, 204][c_custkey % 8 + 1]"


def crawl_sql(max_depth: int) -> str:
    """The crawl of tree_pages as the table c (url, page_id, depth, status)."""
    return f"""WITH RECURSIVE b AS (
    SELECT 1::BIGINT AS k, 0 AS depth UNION ALL
    SELECT 2 * b.k + i, depth + 1 FROM b JOIN customer ON c_custkey = b.k AND c_custkey % 13 <> 0, (VALUES (0), (1)) v(i) WHERE depth < {max_depth}
), c AS (
    SELECT 'https://www.site.example.com/c/' || k AS url, coalesce(c_custkey, -1) AS page_id, depth,
        CASE WHEN c_custkey IS NULL THEN 'error' ELSE 'crawled' END AS status
    FROM b LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON c_custkey = k
)
"""


_CRAWL = crawl_sql(5)
SQL = {
    "status_taxonomy": f"""SELECT id, status, CASE WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server'
    WHEN status >= 400 THEN 'client' ELSE 'ok' END AS error_class, status IN (429, 500, 503) AS retryable
    FROM (SELECT c_custkey AS id, {_STATUS} AS status FROM customer)""",
    "cache_control_ttl": f"""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN c_custkey % 1000 WHEN 2 THEN 0 ELSE 300 END::INTEGER AS ttl,
    c_custkey % 4 <> 0 AND c_custkey % 9 <> 0 AND {_STATUS} IN (200, 301, 404, 204) AS cacheable,
    sha256('GET:https://c' || c_custkey || '.example.com/') AS cache_key FROM customer""",
    "header_redaction": """SELECT c_custkey AS id, 'set-cookie' AS header, '<redacted: ' || length('id=' || c_custkey) || ' bytes>' AS value FROM customer
    UNION ALL SELECT c_custkey, 'x-my-token', '<redacted: ' || length(c_name) || ' bytes>' FROM customer WHERE c_custkey % 13 = 0""",
    "retry_schedule": """SELECT c_custkey AS id, n::INTEGER AS attempt, pow(2.0, n) AS delay, pow(2.0, n) * 0.5 AS least, pow(2.0, n) * 1.5 AS most
    FROM customer, range(3) r(n) WHERE c_custkey % 8 IN (3, 4, 5)""",
    # 203.0.113.0/24 is reserved, too.
    "url_policy_gate": """SELECT c_custkey AS id, c_custkey % 11 <> 0 AND (c_custkey % 8 = 3 OR (c_custkey % 8 = 7 AND c_custkey % 250 <> 113)
    OR (c_custkey % 8 = 1 AND c_custkey % 40 NOT BETWEEN 16 AND 31)) AS allowed FROM customer""",
    "token_bucket": """WITH RECURSIVE e AS (
    SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events
), f AS (
    SELECT key, n, 1.0::DOUBLE AS tokens, t AS last, 0 AS waited, 0.0::DOUBLE AS wait FROM e WHERE n = 1 UNION ALL
    SELECT key, n, CASE WHEN filled >= 1 THEN filled - 1 ELSE 0.0 END, CASE WHEN filled >= 1 THEN now ELSE now + (1 - filled) / 0.001 END,
        waited + (filled < 1)::INT, CASE WHEN filled >= 1 THEN wait ELSE wait + (1 - filled) / 0.001 END
    FROM (SELECT f.key, e.n, waited, wait, greatest(e.t, last) AS now, least(2.0, tokens + (greatest(e.t, last) - last) * 0.001) AS filled
        FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
) SELECT key, max(n) AS n_requests, max(waited)::BIGINT AS n_waited, round(max(wait), 3) AS total_wait FROM f GROUP BY key""",
    "cache_hits": """WITH RECURSIVE e AS (
    SELECT user_id || '/' || event_type AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events
), f AS (
    SELECT key, n, t + 3600.0 AS until, 0 AS hits FROM e WHERE n = 1 UNION ALL
    SELECT f.key, e.n, CASE WHEN e.t < until THEN until ELSE e.t + 3600.0 END, hits + (e.t < until)::INT
    FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1
) SELECT key, max(n) AS n_requests, max(hits)::BIGINT AS n_hits FROM f GROUP BY key""",
    "robots_filter": """SELECT 'https://n' || c_nationkey || '.example.com' || CASE WHEN c_custkey % 3 = 0
    THEN '/private/' || c_nationkey || '/x' ELSE '/open/' || c_custkey END || '?k=' || c_custkey AS url,
    c_custkey % 3 <> 0 AS allowed, false AS bad_allowed FROM customer""",
    "url_pattern_filter": f"SELECT page_id, url FROM pages WHERE regexp_matches({part('url', 5)}, '^/(en|fr)/')"
    f" AND NOT regexp_matches({part('url', 5)}, '\\.html$')",
    "captured_responses": """SELECT event_id AS id, ['document', 'xhr'][event_id % 4 + 1] AS resource_type, event_id * 977 % 2000000 AS content_length
    FROM events WHERE event_id % 3 = 0 AND event_id % 10 <> 0 AND event_id % 4 < 2 AND event_id * 977 % 2000000 <= 1048576""",
    "request_correlation": """WITH RECURSIVE e AS (
    SELECT event_id AS id, user_id, event_type, event_id % 3 = 0 AS closes,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events
), f AS (
    SELECT user_id, event_type, n, id, closes, CASE WHEN closes THEN [] ELSE [id] END AS opened, NULL::BIGINT AS request_id FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.event_type, e.n, e.id, e.closes,
        CASE WHEN e.closes THEN f.opened[:-2] ELSE list_append(f.opened, e.id) END, CASE WHEN e.closes THEN f.opened[-1] END
    FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1
) SELECT user_id AS session_id, count(*) AS responses, count(request_id) AS matched, sum(request_id)::BIGINT AS request_ids
    FROM f WHERE closes GROUP BY user_id""",
    "crawl_bfs": _CRAWL + "SELECT * FROM c",
    "crawl_totals": _CRAWL + "SELECT count(*) AS discovered, count(*) FILTER (WHERE status = 'crawled') AS crawled,"
    " count(*) FILTER (WHERE status = 'error') AS errors FROM c",
    "discover_urls": """SELECT 'https://shop.example.com/p/' || p_partkey AS url, 'sitemap' AS source,
    make_timestamp(2000 + p_partkey % 24, p_partkey % 9 + 1, 1, 0, 0, 0) AS lastmod, NULL::VARCHAR AS link_type, 0 AS depth FROM part WHERE p_partkey % 10 <> 5
    UNION ALL SELECT 'https://shop.example.com/q/' || p_partkey, 'page_link', NULL, 'navigation', 1 FROM part WHERE p_partkey % 10 <> 5""",
    "discover_all_urls": """SELECT 'https://shop.example.com/p/' || p_partkey AS url, 'sitemap' AS source,
    make_timestamp(2000 + p_partkey % 24, p_partkey % 9 + 1, 1, 0, 0, 0) AS lastmod, NULL::VARCHAR AS link_type FROM part WHERE p_partkey % 10 <> 5
    UNION ALL SELECT 'https://shop.example.com/q/' || p_partkey, 'page_link', NULL, 'navigation' FROM part WHERE p_partkey % 10 <> 5""",
    "batch_outcomes": f"""SELECT CASE WHEN c_custkey % 5 = 0 THEN 'no response' WHEN {_STATUS} >= 400 THEN 'HTTP ' || {_STATUS} END AS error,
    count(*) AS n FROM customer GROUP BY 1""",
    "redirect_chain": """WITH RECURSIVE r AS (
    SELECT p_partkey AS url, p_partkey AS target, 0 AS hops FROM part WHERE p_partkey > 0 UNION ALL
    SELECT url, target // 2, hops + 1 FROM r WHERE target % 2 = 0 AND hops < 5
) SELECT url::VARCHAR AS url, CASE WHEN max(hops) <= 4 THEN arg_max(target, hops)::VARCHAR END AS target, max(hops) AS hops FROM r GROUP BY url""",
}
