"""Addresses: policies only, nothing is fetched (Column -> Column)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 blocks that are not public: (first address, prefix length) (fixed values).
SPECIAL_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("168.63.129.16", 32), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def v4_number(ip: Column) -> Column:
    """The address as a long, null if it is no dotted quad."""
    quad = r"\A(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\z"
    parts = F.split(ip, r"\.")
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + F.expr("0") + p.cast("long"))
    return F.when(ip.rlike(quad), n)


def is_public_v4(ip: Column) -> Column:
    n = v4_number(ip)
    special = F.lit(False)
    for first, bits in SPECIAL_V4:
        low = sum(int(p) << 8 * (3 - i) for i, p in enumerate(first.split(".")))
        special = special | n.between(low, low + (1 << 32 - bits) - 1)
    return F.coalesce(n.isNotNull() & ~special, F.lit(False))


def v6_words(ip: Column) -> Column:
    """The eight 16-bit words of an IPv6 address; null if it is none. One "::" stands for at
    least one word of zeros; a dotted quad may stand for the last two."""
    quad = F.regexp_extract(ip, r":([0-9.]+)\z", 1)
    n = v4_number(quad)
    plain = F.when(quad.contains("."), F.concat(F.regexp_extract(ip, r"\A(.*:)[0-9.]+\z", 1), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF)))).otherwise(ip)
    halves = F.split(plain, "::")
    words = lambda part: F.filter(F.split(part, ":"), lambda w: w != "")
    left, right = words(F.element_at(halves, 1)), F.when(F.size(halves) == 2, words(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>"))
    short = F.size(halves) == 2
    whole = F.concat(left, F.when(short, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))).otherwise(F.array().cast("array<string>")), right)
    fine = plain.rlike(r"(?i)\A[0-9a-f:]+\z") & ~plain.rlike(r":::|\A:[^:]|[^:]:\z|[0-9a-fA-F]{5}") & (F.size(halves) <= 2) & (F.size(whole) == 8) & (~short | (F.size(left) + F.size(right) < 8))
    return F.when(fine, F.transform(whole, lambda w: F.conv(w, 16, 10).cast("int")))


def is_public_v6(ip: Column) -> Column:
    """Global unicast without the special, documentation, mapped and tunnel ranges."""
    first, second = (F.element_at(v6_words(ip), i) for i in (1, 2))
    special = (first == 0x2002) | ((first == 0x2001) & ((second < 0x0200) | (second == 0x0DB8))) | ((first == 0x3FFF) & (second < 0x1000))
    return F.coalesce(first.between(0x2000, 0x3FFF) & ~special, F.lit(False))


def is_public(ip: Column) -> Column:
    return is_public_v4(ip) | is_public_v6(ip)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)", 1))


def policy(url: Column, allowed: list[str]) -> Column:
    """First failed check of a remote source, or ok: https only, no user part, the
    default port, no fragment, and a host that is allowed or lies below one that is."""
    authority = F.regexp_extract(url, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    fits = F.lit(False)
    for h in allowed:
        fits = fits | (host(url) == h) | host(url).endswith("." + h)
    return (
        F.when(url.isNull() | (F.length(url) > 4096), "INVALID_URL")
        .when(~url.rlike(r"(?i)\Ahttps://"), "NOT_HTTPS")
        .when(authority.contains("@"), "USER_INFO")
        .when(authority.rlike(r":\d+\z") & ~authority.rlike(r":443\z"), "PORT")
        .when(url.contains("#"), "FRAGMENT")
        .when(~fits, "HOST_NOT_ALLOWED")
        .otherwise("ok")
    )


def sas_error(url: Column, now: Column) -> Column:
    """First failed check of a signed upload address, or ok."""
    q = lambda k: F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1)
    ends = F.try_to_timestamp(F.replace(q("se"), F.lit("%3A"), F.lit(":")))
    return F.when(~url.rlike(r"\Ahttps://"), "NOT_HTTPS").when(q("sr") != "b", "RESOURCE").when(~q("sp").isin("c", "w", "cw"), "PERMISSION").when(ends.isNull() | (ends <= now), "EXPIRED").when(q("sig") == "", "SIGNATURE").otherwise("ok")
