"""Addresses as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_TRACKING = r"(?i)^(?:utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(?:=|$)"
# Fixed value: hosts that must not be fetched. The two letters of private IPv6 also block names that start with them.
_PRIVATE = r"^(?:localhost|.*\.localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2\d|3[01])\..*|::1|fc.*|fd.*|fe80:.*)$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def host(url: Column) -> Column:
    """Host in lower case without user and port; empty where there is none."""
    return F.regexp_extract(F.lower(part(url, 2)), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)


def normalize_url(url: Column) -> Column:
    """An address in one form; null where it is none.

    Without fragment and tracking parameters, scheme and host in lower case, no default port, no slash at
    the end of a path other than the root, parameters in the order of their keys, equal keys as they came.
    """
    scheme, authority, path = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 3)
    authority = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(authority)
    path = F.when(path == "", "/").when(path != "/", F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.filter(F.split(F.substring(part(url, 4), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(keyed, lambda s: s["p"]), "&")
    return F.when(url.rlike(_PARTS), F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def is_public(url: Column) -> Column:
    """Whether an address may be fetched: http or https and no private host. Null addresses may not."""
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & (host(url) != "") & ~host(url).rlike(_PRIVATE), F.lit(False))


def unwrap_redirect(url: Column, site: str = "bing.com", marker: str = "apiclick") -> Column:
    """The address inside a click redirector's ``url`` parameter, else the address; null where not public."""
    nested = F.try_url_decode(F.regexp_extract(part(url, 4), r"[?&]url=([^&]+)", 1))
    wrapped = host(url).endswith(site) & F.contains(part(url, 3), F.lit(marker)) & (nested != "")
    out = F.when(wrapped, nested).otherwise(url)
    return F.when(is_public(out), out)


def post_permalink(url: Column, site: str = "reddit.com") -> Column:
    """A forum post's address on the main host; null for any other page."""
    ours = F.regexp_replace(host(url), r"^www\.", "").isin(site, f"old.{site}", f"np.{site}")
    path = F.regexp_replace(part(url, 3), "/+$", "")
    return F.when(ours & is_public(url) & path.rlike(r"(?i)^/r/[^/]+/comments/[a-z0-9]+"), F.concat(F.lower(part(url, 1)), F.lit(f"://www.{site}"), part(url, 3), part(url, 4)))


def on_hosts(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h, out = host(url), F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


# The places a monitor's profile can name, in their order.
PROFILE_KEYS = ("website", "facebook", "x", "linkedin", "youtube", "tiktok", "instagram", "reddit")


def http_url(text: Column) -> Column:
    """An address as someone types it: https where no scheme is given, a slash for no path; null unless http with a dot in its host."""
    bare = F.trim(text)
    full = F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(F.lit("https://"), bare))
    made = F.concat(F.lower(part(full, 1)), F.lit("://"), F.lower(part(full, 2)), F.when(part(full, 3) == "", "/").otherwise(part(full, 3)), part(full, 4), part(full, 5))
    return F.when(F.lower(part(full, 1)).isin("http", "https") & F.contains(host(full), F.lit(".")), made)


def profile_seeds(profile: Column) -> Column:
    """array<struct<key,url>> of a map of profile entries, in the order of PROFILE_KEYS; entries that are no address are left out."""
    rows = F.array(*(F.struct(F.lit(k).alias("key"), http_url(F.element_at(profile, k)).alias("url")) for k in PROFILE_KEYS))
    return F.filter(rows, lambda r: r["url"].isNotNull())


def merge_key(url: Column) -> Column:
    """What makes two feed addresses one: lower case, no slashes at the end."""
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def strip_api_prefix(path: Column) -> Column:
    return F.when(path.rlike("^/api(?:/|$)"), F.coalesce(F.nullif(F.regexp_replace(path, "^/api", ""), F.lit("")), F.lit("/"))).otherwise(path)
