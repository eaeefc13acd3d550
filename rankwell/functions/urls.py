"""URL checks as column expressions: may this address be fetched, and what is its host?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.constants import LOCAL_HOSTS, LOCAL_SUFFIXES, PRIVATE_IPV4
from rankwell.functions.text import let

CHECK_TYPE = "struct<ok:boolean,reason:string>"


def _cidr(text: str) -> tuple[int, int]:
    address, bits = text.split("/")
    value = 0
    for octet in address.split("."):
        value = value * 256 + int(octet)
    return value, (0xFFFFFFFF << (32 - int(bits))) & 0xFFFFFFFF


def _address_number(part: Column) -> Column:
    """Number of one IPv4 part in decimal, octal or hex; null when it is none of them."""
    return (
        F.when(part.rlike("^0[xX]$"), F.lit(0))
        .when(part.rlike("^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(part, 3, 12), 16, 10))
        .when(part.rlike("^0[0-7]{1,15}$"), F.conv(part, 8, 10))
        .when(part.rlike("^(?:0|[1-9][0-9]{0,14})$"), part)
        .cast("bigint")
    )


def _ipv4_value(host: Column) -> Column:
    """32-bit value of a host written as 1 to 4 numbers, null when out of range."""

    def value(numbers):
        size = F.size(numbers)
        room = F.pow(F.lit(256.0), (5 - size).cast("double")).cast("bigint")
        heads = F.slice(numbers, 1, size - 1)
        fits = (
            (size <= 4)
            & F.forall(numbers, lambda n: n.isNotNull())
            & F.forall(heads, lambda n: n <= 255)
            & (F.element_at(numbers, -1) < room)
        )
        total = F.aggregate(heads, F.lit(0).cast("bigint"), lambda acc, n: acc * 256 + n)
        return F.when(fits, total * room + F.element_at(numbers, -1))

    return let(F.transform(F.split(host, r"\."), _address_number), value)


def _is_private_ipv4(value: Column) -> Column:
    ranges = F.array(
        *[
            F.struct(F.lit(net).cast("bigint").alias("net"), F.lit(mask).cast("bigint").alias("mask"))
            for net, mask in map(_cidr, PRIVATE_IPV4)
        ]
    )
    return F.exists(ranges, lambda r: value.bitwiseAND(r["mask"]) == r["net"])


def _ipv6_groups(host: Column) -> Column:
    """Eight numbers of a bracketed address, null when it is not a valid one."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    tail = F.regexp_extract(bare, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    octets = F.transform(F.split(tail, r"\."), lambda x: x.try_cast("bigint"))
    hexed = F.when(
        tail != "",
        F.concat(
            F.regexp_replace(bare, r"[\d.]+$", ""),
            F.lower(F.hex(F.get(octets, 0) * 256 + F.get(octets, 1))),
            F.lit(":"),
            F.lower(F.hex(F.get(octets, 2) * 256 + F.get(octets, 3))),
        ),
    ).otherwise(bare)

    def numbers(text):
        return F.transform(
            F.filter(F.split(text, ":"), lambda x: x != ""),
            lambda x: F.when(x.rlike("^[0-9a-fA-F]{1,4}$"), F.conv(x, 16, 10).cast("bigint")),
        )

    def expand(text):
        gap = text.contains("::")
        left = numbers(F.substring_index(text, "::", 1))
        right = F.when(gap, numbers(F.substring_index(text, "::", -1))).otherwise(
            F.array().cast("array<bigint>")
        )
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(missing, F.lit(0)))
        groups = F.concat(left, zeros, right)
        valid = (
            text.rlike(r"^[0-9a-fA-F:]+$")
            & (F.regexp_count(text, F.lit("::")) <= 1)
            & ~text.contains(":::")
            & F.when(gap, missing >= 1).otherwise(missing == 0)
            & F.forall(groups, lambda g: g.isNotNull())
            & F.forall(octets, lambda o: o.isNull() | (o <= 255))
        )
        return F.when(valid, groups)

    return let(hexed, expand)


def _is_private_ipv6(groups: Column) -> Column:
    def g(i):
        return F.get(groups, i)

    head = F.lower(F.hex(g(0)))
    zero_run = F.aggregate(
        groups,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, x: F.struct(
            (acc["n"] + F.when(acc["open"] & (x == 0), 1).otherwise(0)).alias("n"),
            (acc["open"] & (x == 0)).alias("open"),
        ),
    )["n"]
    mapped = (zero_run >= 2) & (zero_run <= 6) & (F.get(groups, zero_run) == 0xFFFF)
    low = F.forall(F.slice(groups, 1, 7), lambda x: x == 0) & g(7).isin(0, 1)
    return (
        low
        | mapped
        | ((g(0) == 0x64) & (g(1) == 0xFF9B))
        | head.startswith("fc")
        | head.startswith("fd")
        | head.rlike("^fe[89ab]")
    )


def check_url(url: Column) -> Column:
    """Struct (ok, reason): https only, no credentials, no private or local host.

    Short, octal, hex and integer IPv4 forms are resolved before the range test, so
    ``127.1`` and ``2130706433`` are refused like ``127.0.0.1``.
    """
    text = F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]", "")
    scheme = F.lower(F.regexp_extract(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\]*([^/\\?#]*)", 1)
    account = F.when(authority.contains("@"), F.regexp_extract(authority, r"(?s)^(.*)@", 1))
    address = F.regexp_extract(authority, r"(?s)([^@]*)$", 1)
    host = F.lower(F.regexp_extract(address, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(address, r"^(?:\[[^\]]*\]|[^:]*)(.*)$", 1)
    web = F.struct(
        scheme.alias("scheme"),
        account.alias("account"),
        host.alias("host"),
        F.regexp_replace(host, r"\.$", "").alias("bare"),
        port.alias("port"),
    )

    def verdict(u):
        bare = u["bare"]
        special = u["scheme"].isin("http", "https", "ws", "wss", "ftp")
        bracketed = u["host"].startswith("[")
        numeric = bare.rlike(r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)$")

        def decide(k):
            bad_host = (
                (u["host"] == "")
                | F.when(bracketed, k["v6"].isNull()).otherwise(
                    u["host"].rlike(r"[\x00-\x20#/<>?@\[\\\]^|%\x7f]")
                    | (numeric & k["v4"].isNull())
                )
                | ~u["port"].rlike(r"^(?::\d*)?$")
                | (F.substring(u["port"], 2, 20).try_cast("bigint") > 65535)
            )
            local = bare.isin(*LOCAL_HOSTS)
            for suffix in LOCAL_SUFFIXES:
                local = local | bare.endswith(suffix)
            private = F.when(bracketed, _is_private_ipv6(k["v6"])).when(
                numeric, _is_private_ipv4(k["v4"])
            ).otherwise(local | ~bare.contains("."))
            no = F.lit(False)
            return F.when(
                (u["scheme"] == "") | (special & F.coalesce(bad_host, no)), "not-a-url"
            ).when(u["scheme"] != "https", "scheme-not-https").when(
                ~F.coalesce(u["account"], F.lit("")).isin("", ":"), "credentials-in-url"
            ).when(F.coalesce(private, no), "private-address")

        known = F.struct(
            F.when(numeric, _ipv4_value(bare)).alias("v4"),
            F.when(bracketed, _ipv6_groups(u["host"])).alias("v6"),
        )
        reason = let(known, decide)
        return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))

    return F.when(url.isNotNull(), let(web, verdict)).otherwise(
        F.struct(F.lit(False).alias("ok"), F.lit("not-a-url").alias("reason"))
    )


def is_url(url: Column) -> Column:
    """Whether a text reads as an absolute URL; web schemes need a host."""
    return url.rlike(
        r"(?i)^(?:(?:https?|wss?|ftp):[/\\]*[^\s/\\?#]+.*"
        r"|(?!(?:https?|wss?|ftp):)[a-z][a-z0-9+.-]*:.*)$"
    )


def is_safe_url(url: Column) -> Column:
    return check_url(url)["ok"]


def source_label(url: Column) -> Column:
    """Host shown as the source name."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host, F.lit("unknown source"))
