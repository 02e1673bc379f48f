"""Indicators of an event and their reputation.

Joins to the reputation table carry no hint: Spark broadcasts it while its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it, splitting skewed keys, beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.network import ip_kind, port_number

LOCAL_SOURCE = "local"


def _has(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _text(value: Column) -> Column:
    """Trimmed lower-case text, NULL when blank."""
    low = F.lower(F.trim(value))
    return F.when(low != "", low)


def indicator_slots(df: DataFrame) -> dict[str, Column]:
    """Value of each slot that survives per-event deduplication by value, NULL otherwise.

    A slot drops out when an earlier one holds the same text; ports are kept apart.
    """
    src = F.when(ip_kind(F.col("src_ip")).isNotNull(), F.trim(F.col("src_ip")))
    dst_raw = F.when(ip_kind(F.col("dst_ip")).isNotNull(), F.trim(F.col("dst_ip")))
    dst = F.when(~dst_raw.eqNullSafe(src), dst_raw)
    name = _text(_has(df, "domain"))
    domain = F.when(~name.eqNullSafe(src) & ~name.eqNullSafe(dst_raw), name)
    digest = _text(_has(df, "file_hash"))
    hashed = F.when(
        ~digest.eqNullSafe(src) & ~digest.eqNullSafe(dst_raw) & ~digest.eqNullSafe(name), digest
    )
    return {"src": src, "dst": dst, "port": port_number(F.col("dst_port")).cast("string"),
            "domain": domain, "hash": hashed}


def extract_iocs(events: DataFrame) -> DataFrame:
    """One row per indicator, in slot order src, dst, port, domain, hash."""
    slots = indicator_slots(events)
    kinds = {"src": ip_kind(F.col("src_ip")), "dst": ip_kind(F.col("dst_ip")), "port": F.lit("Port"),
             "domain": F.lit("Domain"), "hash": F.lit("Hash")}
    cells = [
        F.when(slots[s].isNotNull(), F.struct(kinds[s].alias("ioc_type"), slots[s].alias("value"))) for s in slots
    ]
    found = events.select(
        "event_id", "ts", F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence"),
        F.posexplode(F.array_compact(F.array(*cells))).alias("slot", "ioc"),
    )
    return found.select(
        F.col("event_id").alias("source_event_id"), "slot", "ioc.ioc_type", "ioc.value",
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), "confidence",
    )


def unique_intel(intel: DataFrame) -> DataFrame:
    """One whole row per indicator, the last source in name order deciding, then the other columns as text."""
    rest = [c for c in intel.columns if c not in ("ioc_type", "value")]
    first = [c for c in ("source", "reputation") if c in rest]
    rank = F.struct(*[F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate([*first, *[c for c in rest if c not in first]])])
    best = intel.groupBy("ioc_type", "value").agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return best.select("ioc_type", "value", *[F.col(f"__row.{c}").alias(c) for c in rest])


#: what a reputation row says of an indicator besides its reputation and confidence
ATTRIBUTES = ("source", "categories", "threat_actor", "hash_type")


def enrich_iocs(iocs: DataFrame, intel: DataFrame) -> DataFrame:
    """Reputation of each indicator: found, not_found, or not_applicable for ports.

    The attributes of the reputation row (source, categories, actor, hash type) come along as ``intel``.
    """
    known = unique_intel(intel)
    side = known.select(
        F.col("ioc_type").alias("__type"), F.col("value").alias("__value"), "reputation",
        F.col("confidence").alias("intel_confidence"),
        F.struct(*[(F.col(c) if c in known.columns else F.lit(None).cast("string")).alias(c) for c in ATTRIBUTES]).alias("intel"),
    )
    joined = iocs.join(side, (iocs["ioc_type"] == side["__type"]) & (iocs["value"] == side["__value"]), "left")
    hit = F.col("__type").isNotNull()
    return joined.withColumns({
        "intel_status": F.when(hit, "found").when(F.col("ioc_type") == "Port", "not_applicable").otherwise("not_found"),
        "reputation": F.coalesce("reputation", F.lit("UNKNOWN")),
        "intel_confidence": F.coalesce("intel_confidence", F.lit(0.0)),
    }).drop("__type", "__value")


def _of_kinds(intel: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row per value among indicators of the kinds, so that a lookup never multiplies rows."""
    wanted = intel.where(F.col("ioc_type").isin(*kinds))
    return unique_intel(wanted.withColumn("ioc_type", F.lit(kinds[0])))


def lookup(values: DataFrame, intel: DataFrame, column: str = "value") -> DataFrame:
    """Untyped lookup: the reputation as an address, else as a domain."""

    def side(kinds: tuple[str, ...], tag: str) -> DataFrame:
        return _of_kinds(intel, kinds).select(
            F.col("value").alias(f"__{tag}"), F.col("reputation").alias(f"__{tag}_rep"),
            F.col("confidence").alias(f"__{tag}_conf"),
        )

    ips, names = side(("IPv4", "IPv6"), "ip"), side(("Domain",), "name")
    trimmed = F.trim(values[column])
    joined = values.join(ips, trimmed == ips["__ip"], "left").join(names, F.lower(trimmed) == names["__name"], "left")
    as_ip, as_name = F.col("__ip").isNotNull(), F.col("__name").isNotNull()
    return joined.select(
        *values.columns,
        F.when(as_ip, "ip").when(as_name, "domain").otherwise("none").alias("matched_as"),
        F.coalesce(F.when(as_ip, F.col("__ip_rep")), F.col("__name_rep"), F.lit("UNKNOWN")).alias("reputation"),
        F.coalesce(F.when(as_ip, F.col("__ip_conf")), F.col("__name_conf"), F.lit(0.0)).alias("intel_confidence"),
    )


def with_reputation(events: DataFrame, intel: DataFrame) -> DataFrame:
    """Add ``reputation``, ``intel_confidence`` and ``ioc_count`` to each event.

    Four lookups on the event row itself (a port never has a reputation) instead of explode, join
    and regroup: with a broadcast reputation table nothing is shuffled.
    """
    slots = indicator_slots(events)
    out = events.withColumns({f"__{s}": c for s, c in slots.items()})
    kinds = {"src": ("IPv4", "IPv6"), "dst": ("IPv4", "IPv6"), "domain": ("Domain",), "hash": ("Hash",)}
    for slot, types in kinds.items():
        if slot in ("domain",) and "domain" not in events.columns:
            continue
        if slot in ("hash",) and "file_hash" not in events.columns:
            continue
        side = _of_kinds(intel, types).select(
            F.col("value").alias(f"__k_{slot}"),
            F.struct(F.col("reputation"), F.col("confidence")).alias(f"__i_{slot}"),
        )
        out = out.join(side, F.col(f"__{slot}") == F.col(f"__k_{slot}"), "left").drop(f"__k_{slot}")
    looked = [s for s in kinds if f"__i_{s}" in out.columns]

    def weight(slot: str) -> Column:
        bad = F.col(f"__i_{slot}.reputation").isin("MALICIOUS", "SUSPICIOUS")
        return F.when(bad, F.col(f"__i_{slot}.confidence")).otherwise(F.lit(0.0))

    top = F.greatest(*[F.coalesce(weight(s), F.lit(0.0)) for s in looked], F.lit(0.0))
    verdict = None
    for s in looked:  # slot order decides between equal confidences
        hit = (F.col("__top") > 0) & (weight(s) == F.col("__top"))
        value = F.col(f"__i_{s}.reputation")
        verdict = F.when(hit, value) if verdict is None else verdict.when(hit, value)
    benign = F.lit(False)
    for s in looked:
        benign = benign | F.coalesce(F.col(f"__i_{s}.reputation") == "BENIGN", F.lit(False))
    count = None
    for s in slots:
        one = F.col(f"__{s}").isNotNull().cast("int")
        count = one if count is None else count + one
    out = out.withColumn("__top", top)
    return out.withColumns({
        "reputation": verdict.when(benign, "BENIGN").otherwise("UNKNOWN"),
        "intel_confidence": F.round(F.col("__top"), 4),
        "ioc_count": count,
    }).drop("__top", *[f"__{s}" for s in slots], *[f"__i_{s}" for s in looked])
