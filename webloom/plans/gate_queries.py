"""Queries of what comes before a page is read: addresses, redirects, charsets, patterns, labels by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import addresses
from webloom.operators import discovery, fetch_policy, patterns, regions
from webloom.plans.common import table
from webloom.runtime import checkpointed, grown
from webloom.sources import bodies, rendered
from webloom.sources.dom import nodes
from webloom.sources.rendered import text


def address_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers in nested networks of both families, one for each nation."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    nations = table(spark, sf_dir, "nation")
    nets = nations.select(text("10.", n, ".0.0/16").alias("network"))
    nets = nets.unionByName(nations.filter(n % 2 == 0).select(text("10.", n, ".128.0/17").alias("network")))
    nets = nets.unionByName(nations.select(text("2001:db8:", F.lower(F.hex(n)), "::/48").alias("network")))
    nets = nets.unionByName(nations.filter(n == 0).select(F.lit("10.0.0.0/8").alias("network")))
    v4 = text("10.", c % 30, ".", c % 256, ".1")
    v6 = text("[2001:DB8:", F.lower(F.hex(c % 30)), "::", F.lower(F.hex(c % 1000)), "]")
    host = F.when(c % 3 == 0, v4).when(c % 3 == 1, v6).when(c % 6 == 5, text("::ffff:", v4)).otherwise(text("h", c, ".example.com"))
    found = addresses.narrowest(table(spark, sf_dir, "customer").select(c.alias("id"), host.alias("host")), nets)
    return found.select("id", F.coalesce("network", F.lit("none")).alias("network"))


def url_policy_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with addresses of both families in many forms, some of them allowed."""
    c = F.col("c_custkey")
    hosts = [
        text("[2001:db8::", F.lower(F.hex(c % 5000)), "]"), text("[2606:4700::", F.lower(F.hex(c % 5000)), "]:443"), text("[::ffff:10.0.", c % 256, ".1]"), text("[fd00::", c % 10, "]"),
        text("198.18.", c % 256, ".9"), text("h", c, ".example.com."), text("127.", c % 256), text("8.8.", c % 256, ".8"), text("[64:ff9b::7f00:", c % 10, "]"), text("172.", c % 40, ".0.1"),
    ]
    host = hosts[-1]
    for i, one in enumerate(hosts[:-1]):
        host = F.when(c % 10 == i, one).otherwise(host)
    url = text("https://", host, "/x")
    return table(spark, sf_dir, "customer").select(c.alias("id"), fetch_policy.url_allowed(url, ["fd00::4/126"]).alias("allowed"))


def redirect_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k redirects to itself, to a closed host, or to k / 2 while k is even."""
    k = F.col("p_partkey")
    page = lambda n: text("https://h", n.cast("long"), ".example.com/")
    target = F.when(k % 5 == 0, page(k)).when(k % 7 == 0, "http://192.168.0.1/").when(k % 2 == 0, page(k / 2))
    parts = table(spark, sf_dir, "part").filter(k > 0)
    hops = parts.select(page(k).alias("source"), target.alias("target"))
    return discovery.redirect_paths(hops, parts.select(page(k).alias("url")), fetch_policy.url_allowed, most=4)


def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in seven charsets, told by a header, a mark, a meta element or nothing."""
    c, name = F.col("c_custkey"), F.col("c_name")
    ascii_, raw = F.encode(name, "US-ASCII"), lambda digits: F.unhex(F.lit(digits))
    meta = lambda label: F.encode(F.lit(f'<meta charset="{label}">'), "US-ASCII")
    shapes = [
        (F.concat(ascii_, raw("E9")), "text/html; charset=ISO-8859-1"),
        (F.concat(raw("FFFE"), F.encode(F.concat(name, F.lit("é")), "UTF-16LE")), "text/html; charset=utf-8"),
        (F.concat(meta("koi8-r"), ascii_, raw("F0D2C9D7C5D4")), "text/html"),
        (F.concat(ascii_, raw("FF")), None),
        (F.concat(meta("windows-1252"), ascii_, raw("80")), "text/html; charset=nonsense"),
        (F.concat(ascii_, raw("93FA967B")), 'text/html; charset="Shift_JIS"'),
        (F.concat(raw("EFBBBF"), F.encode(F.concat(name, F.lit("é")), "UTF-8")), "text/html; charset=koi8-r"),
    ]
    body, kind = shapes[-1][0], F.lit(shapes[-1][1])
    for i, (one, header) in enumerate(shapes[:-1]):
        body, kind = F.when(c % 7 == i, one).otherwise(body), F.when(c % 7 == i, F.lit(header)).otherwise(kind)
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), body.alias("body"), kind.alias("content_type"))
    return bodies.decoded(rows).select("id", "charset", F.col("html").alias("text"))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts each pattern of a table matches; the patterns are made of the parts' brands and names."""
    parts = table(spark, sf_dir, "part")
    told = parts.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    brands = parts.select(F.concat("p_brand", F.lit("$")).alias("pattern")).distinct()
    names = parts.select(F.concat(F.lit("^"), F.substring_index("p_name", " ", 1), F.lit(r" [a-z]+ (ECONOMY|SMALL)\b")).alias("pattern")).distinct()
    found = patterns.matching(told, brands.unionByName(names))
    return found.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in regions that paths name, of pages of four shapes, with their own paths."""
    found = checkpointed(nodes(rendered.structured_pages(spark, sf_dir)))
    good = ["//ul/li[1]", "//table//td[1]", "//div[contains(@class, 'x')]/blockquote", "//p[not(@class)]/*[@href or contains(@class, 'sr')]"]
    labelled = regions.labelled_by_paths(found, good, ["//ol/li[2]", "/html/body/table//i", "//blockquote/blockquote", "//missing"])
    return labelled.select("page_id", "nid", "label").join(grown(regions.node_paths(found)), ["page_id", "nid"]).select("page_id", "path", "label")


QUERIES = {f.__name__: f for f in (address_networks, url_policy_families, redirect_outcomes, decoded_bodies, pattern_hits, path_labels)}

_PATHS = {
    0: [("/ul/li[1]", 1), ("/ul/li[1]/ol", 1), ("/ul/li[1]/ol/li[1]", 1), ("/ul/li[1]/ol/li[2]", 0), ("/ul/li[1]/ol/li[2]/p[1]", 0), ("/ul/li[1]/ol/li[2]/p[2]", 0)],
    1: [("/table/tr[1]/td[1]", 1), ("/table/tr[2]/td", 1), ("/table/tr[2]/td/i", 0)],
    2: [("/div/blockquote", 1), ("/div/blockquote/p", 1), ("/div/blockquote/blockquote", 0), ("/div/blockquote/blockquote/br", 0)],
    3: [("/p/a", 1), ("/p/span", 1)],
}
_CODE = "CASE c_custkey % 7 "
SQL = {
    "address_networks": """WITH c AS (SELECT c_custkey AS id, c_custkey % 30 AS x, c_custkey % 256 AS y FROM customer)
    SELECT id, CASE WHEN id % 3 = 0 OR id % 6 = 5 THEN CASE WHEN x > 24 THEN '10.0.0.0/8' WHEN x % 2 = 0 AND y >= 128 THEN '10.' || x || '.128.0/17' ELSE '10.' || x || '.0.0/16' END
    WHEN id % 3 = 1 AND x <= 24 THEN '2001:db8:' || lower(to_hex(x)) || '::/48' ELSE 'none' END AS network FROM c""",
    "url_policy_families": """SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 1 THEN true WHEN 3 THEN c_custkey % 10 BETWEEN 4 AND 7 WHEN 5 THEN true WHEN 7 THEN true
    WHEN 9 THEN c_custkey % 40 NOT BETWEEN 16 AND 31 ELSE false END AS allowed FROM customer""",
    "redirect_outcomes": """WITH RECURSIVE w AS (SELECT p_partkey AS k, p_partkey AS cur, 0 AS h FROM part WHERE p_partkey > 0
    UNION ALL SELECT k, cur // 2, h + 1 FROM w WHERE cur % 2 = 0 AND cur % 5 <> 0 AND cur % 7 <> 0
), e AS (SELECT k, max(h) AS h, arg_max(cur, h) AS cur FROM w GROUP BY k), o AS (
    SELECT *, CASE WHEN cur % 5 = 0 THEN 'cycle' WHEN cur % 7 = 0 AND h < 4 THEN 'closed' WHEN cur % 7 = 0 OR h > 4 THEN 'too many' ELSE 'ok' END AS outcome FROM e
) SELECT 'https://h' || k || '.example.com/' AS url, CASE WHEN outcome = 'ok' THEN 'https://h' || cur || '.example.com/' END AS target,
    (CASE outcome WHEN 'ok' THEN h WHEN 'closed' THEN h + 1 ELSE 5 END)::INTEGER AS hops, outcome, CASE WHEN outcome = 'closed' THEN 'http://192.168.0.1/' END AS closed FROM o""",
    "decoded_bodies": f"""SELECT c_custkey AS id, {_CODE} WHEN 0 THEN 'iso8859-1' WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'koi8-r' WHEN 4 THEN 'cp1252' WHEN 5 THEN 'shift_jis' ELSE 'utf-8' END AS charset,
    {_CODE} WHEN 2 THEN '<meta charset="koi8-r">' || c_name || 'Привет' WHEN 3 THEN c_name || chr(65533) WHEN 4 THEN '<meta charset="windows-1252">' || c_name || '€'
    WHEN 5 THEN c_name || '日本' ELSE c_name || 'é' END AS text FROM customer""",
    "pattern_hits": r"""WITH p AS (SELECT DISTINCT p_brand || '$' AS pattern FROM part UNION SELECT DISTINCT '^' || string_split(p_name, ' ')[1] || ' [a-z]+ (ECONOMY|SMALL)\b' FROM part)
    SELECT pattern, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM p JOIN part ON regexp_matches(p_name || ' ' || p_type || ' ' || p_brand, pattern) GROUP BY pattern""",
    "path_labels": "SELECT p_partkey AS page_id, '/html/body' || path AS path, label FROM part JOIN (VALUES "
    + ", ".join(f"({shape}, '{path}', {label})" for shape, rows in _PATHS.items() for path, label in rows)
    + ") v(shape, path, label) ON p_partkey % 4 = shape",
}
