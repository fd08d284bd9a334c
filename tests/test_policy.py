"""Addresses of both families, groups of robots.txt, and paths of redirects."""

from __future__ import annotations

import ipaddress
import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from webloom.functions import addresses
from webloom.operators import fetch_policy


def mapped(address):
    number = int(address)
    return f"{number if address.version == 6 else (0xFFFF << 32) | number:032x}"


def test_digits_of_addresses(spark):
    rng = random.Random(1)
    hosts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(100)]
    for _ in range(200):
        number = rng.getrandbits(128)
        for shift in rng.sample(range(8), rng.randint(0, 7)):
            number &= ~(0xFFFF << 16 * shift)
        one = ipaddress.IPv6Address(number)
        hosts += [str(one), one.exploded, f"[{one}]", str(one).upper()]
    hosts += ["::ffff:10.0.0.1", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7.8.9.10", "1::8.8.8.8"]
    bad = ["", "a.example.com", "1.2.3", "1.2.3.256", "01.2.3.4", "1:2", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", ":1", "12345::", "g::", "fe80::1%eth0", "::1.2.3", None, "1.2.3.4.5", "::ffff:010.0.0.1"]
    rows = [(h,) for h in hosts + bad]
    found = {r.host: r.d for r in spark.createDataFrame(rows, "host string").withColumn("d", addresses.digits(F.col("host"))).collect()}
    for host in hosts:
        assert found[host] == mapped(ipaddress.ip_address(host.strip("[]"))), host
    assert [h for h in bad if found[h] is not None] in ([], ["1:2:3:4:5:6:7::8"])


def test_narrowest_networks(spark):
    rng = random.Random(2)
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "2001:db8::/32", "2001:db8:1::/48", "::/0", "192.168.0.0/23", "nonsense", "10.0.0.0/8"]
    hosts = [f"10.{rng.randint(0, 2)}.{rng.randint(0, 3)}.{rng.randint(0, 4)}" for _ in range(60)] + [f"2001:db8:{rng.randint(0, 2)}::{rng.randint(0, 9)}" for _ in range(20)]
    hosts += ["192.168.1.255", "192.168.2.0", "8.8.8.8", "none.example.com", "::ffff:10.1.2.3", None]
    networks = spark.createDataFrame([(n, i) for i, n in enumerate(nets)], "network string, number int")
    found = addresses.narrowest(spark.createDataFrame([(h, 1) for h in hosts], "host string, long int"), networks).collect()
    assert len(found) == len(hosts) and found[0].asDict().keys() == {"host", "long", "network", "number"}
    known = [ipaddress.ip_network(n) for n in nets if n != "nonsense"]
    for r in found:
        try:
            one = ipaddress.ip_address(r.host or "")
            one = getattr(one, "ipv4_mapped", None) or one
        except ValueError:
            assert r.network is None
            continue
        want = max((n for n in known if one in n), key=lambda n: n.prefixlen)
        assert ipaddress.ip_network(r.network) == want, r


OPEN = ["http://example.com/", "https://8.8.8.8/x", "http://[2606:4700::1111]:8080/", "http://a.example.com.:80/", "http://192.0.0.9/", "http://[2001:4:112::1]/", "http://1.2.3.4.example.com/", "http://[::ffff:8.8.8.8]/"]
CLOSED = [
    "http://[::ffff:10.0.0.1]/", "http://[0:0:0:0:0:0:0:1]/", "http://198.18.0.1/", "http://192.0.2.5/", "http://[2001:db8::1]/", "http://127.1/", "http://2130706433/", "http://localhost./",
    "http://169.254.169.254./latest", "http://0x7f.1/", "http://[fe80::1%25eth0]/", "http://u:p@10.0.0.1:80/", "ftp://example.com/", "http://[fd12::1]/", "http://[64:ff9b::a00:1]/", "http:///x", "http://010.0.0.1/",
    "http://metadata.google.internal/", "http://x.local/", None, "http://[::]/", "http://[::1", "http://0/", "http://[::ffff:7f00:1]/", "http://255.255.255.255/", "http://[ff02::1]/",
]


def test_closed_hosts_of_both_families(spark):
    df = spark.createDataFrame([(u,) for u in OPEN + CLOSED], "url string").withColumn("ok", fetch_policy.url_allowed(F.col("url")))
    assert {r.url for r in df.collect() if r.ok} == set(OPEN)


def test_private_addresses_are_closed(spark):
    rng = random.Random(3)
    hosts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(400)]
    hosts += [str(ipaddress.ip_network(n)[rng.randint(0, 3)]) for n, _ in fetch_policy.SPECIAL_NETWORKS if ipaddress.ip_network(n).num_addresses > 3]
    found = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("ok", fetch_policy.host_allowed(F.col("host"))).collect()
    for r in found:
        one = ipaddress.ip_address(r.host)
        if one.is_private or one.is_loopback or one.is_link_local or one.is_multicast or one.is_reserved:
            assert not r.ok, r.host
        elif one.version == 4:
            assert r.ok or one in ipaddress.ip_network("100.64.0.0/10"), r.host


@pytest.mark.parametrize("entries", [["10.0.0.0/24", "fd00::/8"], ["::ffff:10.0.0.1"], [".internal", "localhost", ""]])
def test_allowed_hosts(spark, entries):
    hosts = ["10.0.0.1", "10.0.1.1", "fd00::5", "fe80::1", "a.internal", "localhost", "internal"]
    found = {r.host: r.ok for r in spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("ok", fetch_policy.host_allowed(F.col("host"), entries)).collect()}
    want = {"10.0.0.0/24": {"10.0.0.1", "fd00::5", "internal"}, "::ffff:10.0.0.1": {"10.0.0.1", "internal"}, ".internal": {"a.internal", "localhost", "internal"}}[entries[0]]
    assert {h for h, ok in found.items() if ok} == want


BODIES = [
    "User-agent: bot\nDisallow: /a\n\nUser-agent: botx\nDisallow: /b", "User-agent: *\nDisallow: /c\nUser-agent: botx\nAllow: /c/d\nDisallow: /c", "User-agent: *\nDisallow: /x\n\nUser-agent: *\nDisallow: /a",
    "User-agent: other\nUser-agent: BOTX\nDisallow:\n\nUser-agent: *\nDisallow: /", "Disallow: /a", "", "User-agent: botx # c\nAllow: /a/b\nDisallow: /a\nDisallow: /", "User-agent: none\nDisallow: /",
]


@pytest.mark.parametrize("agent", ["botx/1.0", "*", "Bot", "zzz"])
def test_the_first_group_of_an_agent_holds(spark, agent):
    paths = ["/", "/a", "/a/b", "/b", "/c/d", "/x?y=1", "/d"]
    docs = spark.createDataFrame([(f"h{i}.example.com", b) for i, b in enumerate(BODIES)], "host string, body string")
    rows = [(f"https://h{i}.example.com{p}", i, p, "v", 5, False) for i in range(len(BODIES) + 1) for p in paths]
    requests = spark.createDataFrame(rows, "url string, own int, path string, verdict string, _id int, allowed boolean")
    found = fetch_policy.robots_allowed(requests, docs, agent).collect()
    assert len(found) == len(rows) and {(r.verdict, r["_id"]) for r in found} == {("v", 5)}
    for r in found:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse((BODIES + [""])[r.own].splitlines())
        parser.modified()
        assert r.allowed == parser.can_fetch(agent, r.url), (r.url, agent)
