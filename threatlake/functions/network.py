"""Address, port and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_GROUP = "[0-9a-fA-F]{1,4}"
_RUN = f"({_GROUP}(:{_GROUP})*)?"


def is_ipv4(ip: Column) -> Column:
    """Dotted quad without leading zeros."""
    return ip.rlike(f"^{_IPV4}$")


def is_ipv6(ip: Column) -> Column:
    """Full or ``::``-compressed form, optionally with a dotted-quad tail or a zone suffix."""
    bare = F.regexp_replace(ip, "%[^%]+$", "")
    plain = F.regexp_replace(bare, f"(?<=:){_IPV4}$", "0:0")
    groups = F.regexp_count(plain, F.lit(_GROUP))
    return plain.rlike(f"^({_GROUP}:){{7}}{_GROUP}$") | (plain.rlike(f"^{_RUN}::{_RUN}$") & (groups <= 7))


def ip_kind(ip: Column) -> Column:
    trimmed = F.trim(ip)
    return F.when(is_ipv4(trimmed), F.lit("IPv4")).when(is_ipv6(trimmed), F.lit("IPv6"))


def subnet24(ip: Column) -> Column:
    """/24 of an IPv4 address; shared address space 100.64.0.0/10 belongs to no subnet."""
    shared = F.split_part(ip, F.lit("."), F.lit(2)).try_cast("int").between(64, 127) & ip.startswith("100.")
    return F.when(is_ipv4(ip) & ~shared, F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def port_number(port: Column) -> Column:
    """Port as INT when its text is digits only (``80.0`` and signs give NULL)."""
    text = port.cast("string")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def entity_key(src_ip: Column) -> Column:
    return F.coalesce(F.when(src_ip != "", src_ip), F.lit("unknown-entity"))


def incident_id(entity: Column) -> Column:
    return F.concat(F.lit("inc-"), F.replace(entity, F.lit("."), F.lit("-")))


def row_id(*keys: Column) -> Column:
    """Repeatable identifier of a row: hash of its key columns."""
    return F.sha2(F.concat_ws("-", *[k.cast("string") for k in keys]), 256)


def iso_time(text: Column) -> Column:
    """ISO-8601 text as a timestamp, NULL when it does not parse."""
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.,]+(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(text))
