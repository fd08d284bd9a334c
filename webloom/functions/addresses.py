"""Internet addresses as 16 bytes in 32 hex digits, and the networks that they lie in.

IPv4 addresses are those of ::ffff:0:0/96, so a network of either family is a prefix of one
kind of string, and a mapped address is the address that it maps.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V4_BEFORE = "00000000000000000000ffff"
_V4 = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"


def let(value: Column, then) -> Column:
    """then(value), with value worked out once, however often ``then`` asks for it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _v4_digits(host: Column) -> Column:
    """The 8 hex digits of a dotted address."""
    return F.array_join(F.transform(F.split(host, r"\."), lambda p: F.lpad(F.hex(p.try_cast("long")), 2, "0")), "")


def digits(host: Column) -> Column:
    """The 32 lower-case hex digits of an IPv4 or IPv6 address, in brackets or not; null for all else.

    An IPv4 address needs four numbers without leading zeros; a zone (``%eth0``) isn't part of an address.
    """
    return let(F.lower(F.regexp_replace(F.trim(host), r"^\[(.*)\]$", "$1")), _digits)


def _digits(host: Column) -> Column:
    tail = F.regexp_extract(host, rf":({_V4})$", 1)
    pair = let(F.lower(_v4_digits(tail)), lambda n: F.concat(F.substring(n, 1, 4), F.lit(":"), F.substring(n, 5, 4)))
    plain = F.when(F.rlike(host, F.lit(rf":{_V4}$")), F.concat(F.regexp_replace(host, r"[\d.]+$", ""), pair)).otherwise(host)
    v4 = F.concat(F.lit(_V4_BEFORE), F.lower(_v4_digits(host)))
    return F.when(host.rlike(f"^{_V4}$"), v4).otherwise(F.when(host.contains(":"), let(plain, _v6_digits)))


def _v6_digits(plain: Column) -> Column:
    def full(halves: Column) -> Column:
        groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
        both = F.struct(groups(F.get(halves, F.lit(0))).alias("left"), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>")).alias("right"), (F.size(halves) == 2).alias("cut"))
        return let(both, filled)

    def filled(x: Column) -> Column:
        missing = F.lit(8) - F.size(x["left"]) - F.size(x["right"])
        every = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["right"])
        fits = F.when(x["cut"], missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    shaped = plain.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$")
    return F.when(shaped, let(F.split(plain, "::"), full))


def network(text: str) -> tuple[str, int] | None:
    """The hex digits and the prefix length of ``address/length`` (or an address); None for all else."""
    try:
        net = ipaddress.ip_network(text.strip(), strict=False)
    except ValueError:
        return None
    if net.version == 4:
        return _V4_BEFORE + f"{int(net.network_address):08x}", 96 + net.prefixlen
    return f"{int(net.network_address):032x}", net.prefixlen


def within(address: Column, first: str, length: int) -> Column:
    """Whether the digits of an address lie in a network; false for null."""
    whole, bits = divmod(length, 4)
    hit = F.startswith(address, F.lit(first[:whole]))
    if bits:
        low = int(first[whole], 16) >> (4 - bits) << (4 - bits)
        hit = hit & F.substring(address, whole + 1, 1).isin(*(f"{d:x}" for d in range(low, low + (1 << (4 - bits)))))
    return F.coalesce(hit, F.lit(False))


def bits(address: Column) -> Column:
    """128 digits 0 and 1."""
    half = lambda at: F.lpad(F.conv(F.substring(address, at, 16), 16, 2), 64, "0")
    return F.concat(half(1), half(17))


def narrowest(hosts: DataFrame, networks: DataFrame) -> DataFrame:
    """hosts (host, ...) with ``network`` and the other columns of its narrowest network of networks (network, ...), nulls if there is none.

    Networks are texts like ``10.0.0.0/8`` and ``2001:db8::/32``; a bare address is a network of one, what is neither matches nothing. The
    join is by equal prefixes: an address has a row for each prefix length that any network has, 129 at most. Of networks that
    stand twice the least row counts. A host that is no address keeps its row.
    """
    length = F.regexp_extract("network", r"/(\d{1,3})$", 1).try_cast("int")
    base = digits(F.regexp_replace("network", r"/.*$", ""))
    v4 = ~F.col("network").contains(":")
    long_ = F.when(v4, F.coalesce(length, F.lit(32)) + 96).otherwise(F.coalesce(length, F.lit(128)))
    parsed = networks.select(F.struct("*").alias("own"), long_.alias("long"), base.alias("base"), length.alias("length"))
    parsed = parsed.filter("base IS NOT NULL AND long BETWEEN 0 AND 128").withColumn("prefix", F.substring(bits(F.col("base")), F.lit(1), F.col("long")))
    told = parsed.groupBy("long", "prefix").agg(F.min("own").alias("own"))
    lengths = [r.long for r in told.select("long").distinct().collect()]  # 129 at most
    asked = hosts.select(F.struct("*").alias("row"), digits(F.col("host")).alias("address"))
    each = asked.filter("address IS NOT NULL").select("address").distinct()
    each = each.withColumn("long", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).withColumn("prefix", F.substring(bits(F.col("address")), F.lit(1), F.col("long")))
    found = each.join(told, ["long", "prefix"]).groupBy("address").agg(F.max_by("own", "long").alias("own"))
    return asked.join(found, "address", "left").select("row.*", "own.*")


def first_match(address: Column, networks: list[tuple[str, bool]]) -> Column:
    """The value of the narrowest network that an address lies in; null if it lies in none. Networks are (text, value)."""
    known = sorted(((*network(text), value) for text, value in networks), key=lambda n: -n[1])

    def chosen(a: Column) -> Column:
        out = F.when(within(a, *known[0][:2]), F.lit(known[0][2]))
        for first, length, value in known[1:]:
            out = out.when(within(a, first, length), F.lit(value))
        return out

    return let(address, chosen)

