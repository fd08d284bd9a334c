"""URL algebra as column expressions.

Parts follow the regular expression of RFC 3986, appendix B; a part that is absent is
the empty string, and no input fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed

PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PATTERN, group)


def scheme(url: Column) -> Column:
    return _part(url, 2)


def netloc(url: Column) -> Column:
    return _part(url, 4)


def path(url: Column) -> Column:
    return _part(url, 5)


def query(url: Column) -> Column:
    return _part(url, 7)


def fragment(url: Column) -> Column:
    return _part(url, 9)


def host(url: Column) -> Column:
    """Lower-case netloc without one leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def _without_dots(path_: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path_, "/", -1)
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        above = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", above).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ended = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(ended, "/")
    return F.when(path_.contains("/."), joined).otherwise(path_)


def join(base: Column, ref: Column) -> Column:
    """ref resolved against base."""
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    own = path(ref)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    asked = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    return (
        F.when(ref == "", base)
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(own), tail))
        .when(ref.startswith("?"), F.concat(origin, path(base), ref))
        .when(ref.startswith("#"), F.concat(origin, path(base), asked, ref))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), tail))
    )


def crawl_key(url: Column) -> Column:
    """The URL as crawls compare it: without query, fragment and trailing slashes."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.when(bare == "", "/").otherwise(bare))


def is_internal(url: Column, page_host: Column) -> Column:
    """Whether a link stays on the page's host; links without a host do."""
    return F.when(page_host == "", False).when(url.startswith("#"), True).otherwise(host(url).isin("") | (host(url) == page_host))


def same_domain(url: Column, base: Column) -> Column:
    return host(url) == host(base)


def has_unsafe_scheme(href: Column) -> Column:
    return F.lower(F.trim(href)).rlike(f"^({'|'.join(fixed.UNSAFE_SCHEMES)}):")


def apex_domain(hostname: Column) -> Column:
    """The registered domain: two labels, or three under a two-part suffix."""
    labels = F.split(F.regexp_replace(hostname, r"\.+$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(
        last(2).isin(*fixed.TWO_PART_SUFFIXES), last(3)
    ).otherwise(last(2))


def whois_server(domain: Column) -> Column:
    """The registry server of a domain's longest known suffix."""
    labels = F.split(F.lower(F.regexp_replace(domain, r"\.+$", "")), r"\.")
    servers = F.create_map(*[F.lit(x) for pair in fixed.WHOIS_SERVERS.items() for x in pair])
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    return F.coalesce(
        F.when(F.size(labels) >= 2, F.try_element_at(servers, two)),
        F.try_element_at(servers, F.element_at(labels, -1)),
        F.lit(fixed.WHOIS_DEFAULT),
    )


def wants_bot_agent(url: Column) -> Column:
    """Whether the host takes honest bot user agents only."""
    name = F.regexp_replace(F.lower(F.regexp_replace(netloc(url), "^.*@", "")), ":[0-9]*$", "")
    hosts = F.array(*[F.lit(h) for h in fixed.BOT_FRIENDLY_HOSTS])
    return F.exists(hosts, lambda h: (name == h) | F.endswith(name, F.concat(F.lit("."), h)))


def rate_limit_key(url: Column) -> Column:
    return F.when(netloc(url) == "", "unknown").otherwise(netloc(url))


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/robots.txt"))


def handle_id(url: Column, prefixes: list[str]) -> Column:
    """The id of a stored document that a URL with one of the prefixes names, up to the next slash; null for others."""
    found = F.lit(None).cast("string")
    for prefix in reversed(prefixes):
        rest = F.trim(F.substring_index(F.substr(url, F.lit(len(prefix) + 1)), "/", 1))
        found = F.when(url.startswith(prefix), F.nullif(rest, F.lit(""))).otherwise(found)
    return found
