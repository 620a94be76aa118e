"""Capability leases: coverage, attenuation, chains, revocation, and Merkle inclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CEILINGS = ["escalate", "observe", "draft", "act"]


def capability(text: Column) -> Column:
    """(kind, target) of ``kind:target``; exec and net are short forms."""
    kind = F.split_part(text, F.lit(":"), F.lit(1))
    kind = F.when(kind == "exec", "execute").when(kind == "net", "network").otherwise(kind)
    return F.struct(kind.alias("kind"), F.substring(text, F.instr(text, ":") + 1, F.length(text)).alias("target"))


def covered(child: Column, parent: Column) -> Column:
    """Whether a capability lies within another of the same kind."""
    c, p = child["target"], parent["target"]
    prefix = F.endswith(p, F.lit("*")) & F.startswith(c, F.substring(p, F.lit(1), F.length(p) - 1))
    path_ok = ~(F.contains(c, F.lit("\0")) | F.array_contains(F.split(c, "[/\\\\]"), ".."))
    shell = c.rlike("[;&|`]|\\$\\(")
    suffix = F.startswith(p, F.lit("*.")) & (F.endswith(c, F.substring(p, F.lit(2), F.length(p))) | (c == F.substring(p, F.lit(3), F.length(p))))
    plain = (p == "*") | prefix | (c == p)
    by_kind = (
        F.when(child["kind"].isin("read", "write"), path_ok & plain)
        .when(child["kind"] == "execute", (p == "*") | (~shell & (prefix | (c == p))))
        .when(child["kind"] == "network", plain | suffix)
        .otherwise(plain)
    )
    return (child["kind"] == parent["kind"]) & by_kind


def violators(child: Column, parent: Column) -> Column:
    """Child capabilities that no parent capability covers, sorted."""
    parse = lambda a: F.transform(a, capability)
    bad = F.filter(child, lambda c: ~F.exists(parse(parent), lambda p: covered(capability(c), p)))
    return F.array_sort(bad)


def chain_errors(leases: DataFrame, chain: str = "chain", order: str = "depth") -> DataFrame:
    """First error of each chain, or null. Leases: lease_id, parent_id, principal, delegatee, depth, max_depth, ceiling (rank), expires, capabilities."""
    w = f"over (partition by {chain} order by {order})"
    prior = leases.selectExpr("*", *[f"lag({c}) {w} as p_{c}" for c in ("lease_id", "delegatee", "depth", "max_depth", "ceiling", "expires", "capabilities")], f"row_number() {w} as _hop")
    root, c = F.col("_hop") == 1, F.col
    error = (
        F.when(root & (c("parent_id").isNotNull() | (c("depth") != 0)), "invalid_root")
        .when(root, F.lit(None).cast("string"))
        .when(c("parent_id").isNull() | (c("parent_id") != c("p_lease_id")), "parent_mismatch")
        .when(c("principal") != c("p_delegatee"), "principal_mismatch")
        .when(c("depth") != c("p_depth") + 1, "depth_mismatch")
        .when(c("max_depth") > c("p_max_depth"), "max_depth_raised")
        .when(c("depth") > c("max_depth"), "too_deep")
        .when(F.size(violators(c("capabilities"), c("p_capabilities"))) > 0, "not_attenuated")
        .when(c("ceiling") > c("p_ceiling"), "ceiling_raised")
        .when(c("expires") > c("p_expires"), "expiry_extended")
    )
    return prior.withColumn("error", error).groupBy(chain).agg(F.count("*").alias("hops"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("_hop"))).alias("first_error"))


def lease_status(now: Column, starts: Column, expires: Column, epoch: Column, current_epoch: Column, revoked: Column) -> Column:
    return F.when(now < starts, "premature").when(now > expires, "expired").when(epoch < current_epoch, "stale_epoch").when(revoked, "revoked").otherwise("valid")


def revoked_leases(lineage: DataFrame, revoked: DataFrame, most: int = 32) -> DataFrame:
    """Lease ids that are revoked themselves or through an ancestor; ``most`` bounds the walk where lineage has a cycle.

    ``lineage`` is (lease_id, parent_id). Distances double with each step, so
    the number of joins is the logarithm of the depth.
    """
    gone = revoked.select("lease_id").distinct()
    up = lineage.select("lease_id", F.col("parent_id").alias("anchor")).where("anchor is not null")
    found, span = gone, 1
    while span <= most:
        found = found.union(up.join(found.select(F.col("lease_id").alias("anchor")).distinct(), "anchor", "left_semi").select("lease_id")).distinct()
        further = up.select(F.col("lease_id").alias("anchor"), F.col("anchor").alias("next"))
        up = up.join(further, "anchor").select("lease_id", F.col("next").alias("anchor"))
        span *= 2
    return found


def escape(text: Column) -> Column:
    """Escapes of canonical messages."""
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def lease_message(fields: dict[str, Column], kind: str = "lease-v1") -> Column:
    return F.concat_ws("|", F.lit(kind), *[F.concat(F.lit(f"{k}="), escape(v.cast("string"))) for k, v in fields.items()])


def root_lease_id(message: Column) -> Column:
    return F.concat(F.lit("lease_root_"), F.substring(F.sha2(message, 384), 1, 16))


def capability_json(text: Column) -> Column:
    """The compact JSON of a capability."""
    c = capability(text)
    field = F.when(c["kind"].isin("read", "write"), "path").when(c["kind"] == "execute", "command").when(c["kind"] == "network", "host").when(c["kind"] == "tool", "name").otherwise("action")
    quoted = F.regexp_replace(F.regexp_replace(c["target"], r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('{"kind":"'), c["kind"], F.lit('","'), field, F.lit('":"'), quoted, F.lit('"}'))


def root_lease(requests: DataFrame, now: Column, validity: Column) -> DataFrame:
    """Root leases for (principal, delegatee, representation_digest, capabilities, ceiling, max_depth)."""
    expires = now + validity
    seed = F.concat_ws("|", F.lit("root"), "principal", "delegatee", "representation_digest", now.cast("string"), expires.cast("string"))
    return requests.withColumns({"lease_id": root_lease_id(seed), "parent_id": F.lit(None).cast("string"), "depth": F.lit(0), "issued": now, "expires": expires})


def delegate(requests: DataFrame, now: Column) -> DataFrame:
    """Child leases. ``requests`` has the parent's fields as p_* (lease_id, delegatee, depth, max_depth, capabilities, ceiling, representation_digest, issued, expires) and delegatee, capabilities, ceiling, representation_digest, validity of the request.

    ``error`` is the first check that fails, and the lease is null then.
    """
    c = F.col
    depth = c("p_depth") + 1
    error = (
        F.when(now > c("p_expires"), "expired")
        .when(now < c("p_issued"), "premature")
        .when(depth > c("p_max_depth"), "too_deep")
        .when(F.trim("representation_digest") == "", "empty_digest")
        .when(F.size(violators(c("capabilities"), c("p_capabilities"))) > 0, "not_attenuated")
        .when(c("ceiling") > c("p_ceiling"), "ceiling_raised")
    )
    expires = F.least(now + c("validity"), c("p_expires"))
    seed = F.concat_ws("|", F.lit("child"), "p_lease_id", "delegatee", "representation_digest", now.cast("string"), expires.cast("string"))
    lease = F.struct(
        F.concat(F.lit("lease_d"), depth.cast("string"), F.lit("_"), F.substring(F.sha2(seed, 384), 1, 16)).alias("lease_id"), c("p_lease_id").alias("parent_id"), c("p_delegatee").alias("principal"), c("delegatee"), depth.alias("depth"),
        c("p_max_depth").alias("max_depth"), F.array_sort("capabilities").alias("capabilities"), c("ceiling"), c("representation_digest"), now.alias("issued"), expires.alias("expires"),
    )
    return requests.withColumns({"error": error, "lease": F.when(error.isNull(), lease)})


def envelope_error(status: Column, lease_digest: Column, receipt_digest: Column, signature_ok: Column | None = None) -> Column:
    """First error of an envelope: that of its lease (from ``lease_status``), a receipt for another text, a signature that does not hold; null if none."""
    out = F.when(status != "valid", status).when(~lease_digest.eqNullSafe(receipt_digest), "representation_mismatch")
    return out if signature_ok is None else out.when(~F.coalesce(signature_ok, F.lit(False)), "bad_signature")


def envelope_message(envelope_id: Column, lease_id: Column, receipt: Column, payload: Column, kind: str = "envelope-v1") -> Column:
    return F.concat(lease_message({"id": envelope_id, "lease": lease_id, "receipt": receipt}, kind), F.lit("|payload_digest="), F.sha2(payload, 384), F.lit("|payload_len="), F.octet_length(payload).cast("string"))


def merkle_root(leaf: Column, index: Column, size: Column, path: Column) -> Column:
    """Root that an inclusion path (array of hex hashes) leads to, after RFC 6962; null if the path has a wrong length."""
    node = lambda a, b: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)
    start = F.struct(F.sha2(F.concat(F.unhex(F.lit("00")), leaf), 256).alias("hash"), index.cast("long").alias("fn"), (size - 1).cast("long").alias("sn"), F.lit(True).alias("ok"))

    def step(a: Column, h: Column) -> Column:
        right = (a.fn % 2 == 1) | (a.fn == a.sn)
        # at the right edge levels without a sibling are passed over
        skip = F.when((a.fn % 2 == 0) & right & (a.fn > 0), F.call_function("bit_count", a.fn.bitwiseAND(-a.fn) - 1)).otherwise(0)
        hash_ = F.when(right, node(h, a["hash"])).otherwise(node(a["hash"], h))
        by = F.when(right, skip).otherwise(0) + 1
        return F.struct(hash_.alias("hash"), F.call_function("shiftright", a.fn, by.cast("int")).alias("fn"), F.call_function("shiftright", a.sn, by.cast("int")).alias("sn"), (a.ok & (a.sn > 0)).alias("ok"))

    done = F.aggregate(path, start, step)
    return F.when(done["ok"] & (done["sn"] == 0) & (index < size), done["hash"])
