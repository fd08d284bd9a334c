"""Queries of domain intelligence over rendered observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.operators import domain_intel as intel
from webloom.plans.common import table
from webloom.sources import rendered



def server_software(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rendered.http_observations(spark, sf_dir)
    return seen.select("id", intel.server_software(F.try_element_at(F.col("headers"), F.lit("server"))).alias("software"), intel.cdn(F.col("headers")).alias("cdn"))


def http_security_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.http_observations(spark, sf_dir).select("id", intel.security_score(F.col("headers")).alias("score"))


def http_security_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of each security header."""
    pairs = F.array(*[F.struct(F.lit(h).alias("header"), intel.header_status(F.col("headers"), h).alias("status")) for h in fixed.SECURITY_HEADERS])
    rows = rendered.http_observations(spark, sf_dir).select(F.explode(pairs).alias("p"))
    return rows.groupBy("p.header", "p.status").agg(F.count("*").alias("n"))


def _policy(spark: SparkSession, sf_dir: str, start: str) -> DataFrame:
    rows = rendered.dns_records(spark, sf_dir).filter("record_type = 'TXT'")
    value = F.regexp_replace("value", '^"|"$', "")
    return rows.select("domain", value.alias("value")).filter(F.col("value").startswith(start))


def spf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "v=spf1").select("domain", *[c.alias(k) for k, c in intel.spf(F.col("value")).items()])


def dmarc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _policy(spark, sf_dir, "v=DMARC1").select("domain", *[c.alias(k) for k, c in intel.dmarc(F.col("value")).items()])
    return told.withColumn("pct", F.coalesce("pct", F.lit(-1)))


def mail_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.mail_security(rendered.dns_records(spark, sf_dir))


def dns_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.dns_profile(rendered.dns_records(spark, sf_dir))


def whois_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intel.parse_whois(rendered.whois_docs(spark, sf_dir))
    return found.select(
        "domain", "registrar", "creation_date", "expiration_date", "updated_date", "registrant_country", "dnssec",
        F.array_join("name_servers", ",").alias("name_servers"), F.array_join("status", ",").alias("status"),
    )


def banner_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intel.fingerprint(F.col("banner"), F.col("port"))
    return rendered.banners(spark, sf_dir).select("s_suppkey", *[c.alias(k) for k, c in found.items()])


def port_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9300).alias("port"))
    return rows.select("o_orderkey", intel.port_hint(F.col("port")).alias("service")).filter("service IS NOT NULL")


def tls_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("1998-01-01 00:00:00").cast("timestamp")
    rows = rendered.tls_observations(spark, sf_dir)
    return rows.select(
        "o_orderkey", intel.tls_expiry(F.col("not_after"), today).alias("days_left"), intel.subject_field(F.col("subject"), "O").alias("org")
    )


def domain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, mail posture and headers of each domain, joined; parts that are missing stay null."""
    records = rendered.dns_records(spark, sf_dir)
    web = rendered.http_observations(spark, sf_dir)
    web = web.select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit(".example.com")).alias("domain"), intel.security_score(F.col("headers")).alias("score"))
    joined = intel.dns_profile(records).join(intel.mail_security(records), "domain", "left").join(web, "domain", "left")
    return joined.groupBy("posture", "dnssec").agg(F.count("*").alias("domains"), F.sum("score").alias("scores"))


def ntp_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of NTP answers packed from orders."""
    k = F.col("o_orderkey")
    hex2 = lambda v: F.lpad(F.hex(v), 2, "0")
    packet = F.unhex(F.concat(hex2(k % 4 * 64 + 4 * 8 + 4), hex2(k % 16), F.lit("0AEC"), F.lit("00" * 8), hex2(k % 200), F.lit("00020A")))
    fields = intel.ntp_header(F.col("packet"))
    rows = table(spark, sf_dir, "orders").select(k, packet.alias("packet"))
    return rows.select("o_orderkey", *[fields[f].alias(f) for f in ("leap", "version", "mode", "stratum", "poll", "precision")],
                       F.when(fields["stratum"] > 1, fields["reference"]).alias("reference"))


QUERIES = {
    "server_software": server_software,
    "http_security_score": http_security_score,
    "http_security_headers": http_security_headers,
    "spf_parse": spf_parse,
    "dmarc_parse": dmarc_parse,
    "mail_posture": mail_posture,
    "dns_profile": dns_profile,
    "whois_parse": whois_parse,
    "banner_fingerprint": banner_fingerprint,
    "port_hints": port_hints,
    "tls_expiry": tls_expiry,
    "domain_profile": domain_profile,
    "ntp_header": ntp_header,
}

_STATUS = """CASE h WHEN 'x-frame-options' THEN CASE WHEN c_custkey % 2 = 0 THEN 'present' ELSE 'missing' END
    WHEN 'content-security-policy' THEN CASE WHEN c_custkey % 3 = 0 THEN 'present' ELSE 'missing' END
    WHEN 'referrer-policy' THEN CASE c_custkey % 4 WHEN 0 THEN 'weak' WHEN 1 THEN 'present' ELSE 'missing' END
    WHEN 'x-xss-protection' THEN CASE c_custkey % 5 WHEN 0 THEN 'weak' WHEN 1 THEN 'present' ELSE 'missing' END
    ELSE 'missing' END"""
_SCORE = """((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 1)::INT + (c_custkey % 5 = 1)::INT) * 100 // 9"""
_SPF = """CASE c_custkey % 6 WHEN 0 THEN 'configured' WHEN 1 THEN 'configured' WHEN 2 THEN 'weak' WHEN 3 THEN 'weak'
    WHEN 4 THEN 'configured' ELSE 'missing' END"""
_DMARC = "CASE c_custkey % 4 WHEN 0 THEN 'configured' WHEN 1 THEN 'weak' WHEN 2 THEN 'configured' ELSE 'missing' END"
_MAIL = f"""mail AS (
    SELECT *, CASE WHEN n = 3 THEN 'strong' WHEN n + w >= 2 THEN 'moderate' WHEN n + w >= 1 THEN 'weak' ELSE 'missing' END AS posture
    FROM (SELECT *, (spf = 'configured')::INT + (dkim = 'configured')::INT + (dmarc = 'configured')::INT AS n,
        (spf = 'weak')::INT + (dmarc = 'weak')::INT AS w
        FROM (SELECT c_custkey, 'c' || c_custkey || '.example.com' AS domain, {_SPF} AS spf,
            CASE WHEN c_custkey % 2 = 0 THEN 'configured' ELSE 'missing' END AS dkim, {_DMARC} AS dmarc FROM customer))
)"""
SQL = {
    "server_software": """SELECT c_custkey AS id, ['nginx', 'Apache', 'WeirdServer', 'CustomServer', 'cloudflare', 'AkamaiGHost', NULL][c_custkey % 7 + 1]
    AS software, CASE WHEN c_custkey % 7 = 4 THEN 'Cloudflare' WHEN c_custkey % 7 = 5 THEN 'Akamai'
    WHEN c_custkey % 11 = 0 THEN 'Fastly' END AS cdn FROM customer""",
    "http_security_score": f"SELECT c_custkey AS id, ({_SCORE})::INTEGER AS score FROM customer",
    "http_security_headers": f"""SELECT h AS header, {_STATUS} AS status, count(*) AS n
    FROM customer, (SELECT unnest({fixed.SECURITY_HEADERS!r}) AS h) GROUP BY ALL""",
    "spf_parse": """SELECT 'c' || c_custkey || '.example.com' AS domain,
    ['-all (hard fail)', '~all (soft fail)', '?all (neutral)', '+all (pass all)', '-all (hard fail)'][c_custkey % 6 + 1] AS policy,
    [1, 0, 0, 0, 11][c_custkey % 6 + 1]::INTEGER AS lookups, [0, 0, 1, 1, 1][c_custkey % 6 + 1]::INTEGER AS n_issues,
    ['configured', 'configured', 'weak', 'weak', 'configured'][c_custkey % 6 + 1] AS status
    FROM customer WHERE c_custkey % 6 <> 5""",
    "dmarc_parse": """SELECT 'c' || c_custkey || '.example.com' AS domain, ['quarantine', 'none', 'reject'][k] AS policy,
    CASE WHEN k = 1 THEN 'reject' END AS subdomain_policy, CASE WHEN k = 1 THEN 'mailto:d@example.com' END AS report,
    CASE k WHEN 1 THEN 100 WHEN 3 THEN c_custkey % 100 ELSE -1 END::INTEGER AS pct, [0, 2, 2][k]::INTEGER AS n_issues,
    ['configured', 'weak', 'configured'][k] AS status FROM (SELECT *, c_custkey % 4 + 1 AS k FROM customer) WHERE k < 4""",
    "mail_posture": f"WITH {_MAIL} SELECT domain, spf, dkim, dmarc, posture FROM mail",
    "dns_profile": """SELECT d AS domain, 'ns1.' || d || ',ns2.' || d AS nameservers,
    CASE WHEN c_custkey % 3 <> 0 THEN 'mx.' || d ELSE '' END AS mx_hosts, '192.0.2.' || (c_custkey % 250) AS addresses,
    c_custkey % 5 = 0 AS dnssec FROM (SELECT c_custkey, 'c' || c_custkey || '.example.com' AS d FROM customer)""",
    "whois_parse": """SELECT 's' || s_suppkey || '.example.com' AS domain, s_name AS registrar,
    '2001-02-0' || (s_suppkey % 9 + 1) || 'T03:04:05' AS creation_date, '2030-08-0' || (s_suppkey % 9 + 1) || 'T00:00:00' AS expiration_date,
    NULL::VARCHAR AS updated_date, 'N' || s_nationkey AS registrant_country, 'unsigned' AS dnssec,
    'ns1.s' || s_suppkey || '.net,ns2.s' || s_suppkey || '.net' AS name_servers, 'ok' AS status FROM supplier""",
    "banner_fingerprint": """SELECT s_suppkey,
    CASE WHEN k = 8 AND s_suppkey % 2 = 1 THEN 'unknown' ELSE ['ssh', 'smtp', 'ftp', 'pop3', 'imap', 'http', 'redis', 'ssh', 'redis'][k + 1] END AS service,
    ['OpenSSH', 'Postfix', 'vsFTPd', 'Dovecot', 'Dovecot', 'nginx', 'Redis'][k + 1] AS product,
    CASE k WHEN 0 THEN '8.' || (s_suppkey % 10) || 'p1' WHEN 2 THEN '3.0.' || (s_suppkey % 10) WHEN 5 THEN '1.' || s_suppkey || '.0' END AS version,
    CASE WHEN k = 8 AND s_suppkey % 2 = 1 THEN 0.0 ELSE [0.95, 0.9, 0.9, 0.85, 0.9, 0.9, 0.8, 0.3, 0.3][k + 1] END::DOUBLE AS confidence
    FROM (SELECT *, s_suppkey % 9 AS k FROM supplier)""",
    "port_hints": "SELECT o_orderkey, service FROM orders JOIN (VALUES "
    + ", ".join(f"({p}, '{s}')" for p, s in fixed.PORT_SERVICES.items())
    + ") v(port, service) ON o_orderkey % 9300 = port",
    "tls_expiry": """SELECT o_orderkey, floor((epoch(date_trunc('second', o_orderdate)) - epoch(TIMESTAMP '1998-01-01')) / 86400)::BIGINT AS days_left,
    o_orderpriority AS org FROM orders""",
    "domain_profile": f"""WITH {_MAIL} SELECT posture, c_custkey % 5 = 0 AS dnssec, count(*) AS domains,
    sum(({_SCORE})::INTEGER)::BIGINT AS scores FROM mail GROUP BY ALL""",
    "ntp_header": """SELECT o_orderkey, (o_orderkey % 4)::INTEGER AS leap, 4 AS version, 4 AS mode, (o_orderkey % 16)::INTEGER AS stratum,
    10 AS poll, -20 AS precision, CASE WHEN o_orderkey % 16 > 1 THEN (o_orderkey % 200) || '.0.2.10' END AS reference FROM orders""",
}
