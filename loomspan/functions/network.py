"""Address safety and retry times as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import urls as U

# First and last address of ranges that must not be fetched.
PRIVATE_RANGES = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("224.0.0.0", "255.255.255.255"),
]


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def ipv4_number(host: Column) -> Column:
    """The address as a number; null for what is none."""
    parts = F.split(host, r"\.")
    value = sum((F.element_at(parts, i + 1).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"), value)


def unsafe_url(url: Column) -> Column:
    """Not http(s), no host, a local name, or an address in a private or reserved range."""
    host = U.host_of(url)
    n = ipv4_number(host)
    inside = F.lit(False)
    for lo, hi in PRIVATE_RANGES:
        inside = inside | n.between(_number(lo), _number(hi))
    local = host.isin("localhost", "") | host.rlike(r"\.(?:local|internal|localhost)$") | U.netloc_of(url).rlike(r"^(?:[^@]*@)?\[(?:::1?|f[cd]|fe80)")
    return ~U.scheme_of(url).isin("http", "https") | local | F.coalesce(inside, F.lit(False))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header: a number or a date, never negative; null if neither."""
    when = F.try_to_timestamp(F.regexp_extract(F.trim(value), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.trim(value).try_cast("double"), (F.unix_seconds(when) - F.unix_seconds(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))
