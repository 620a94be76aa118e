"""Checks of transparency-log entries that need no certificates: bundles, inclusion proofs, and what an entry binds.

Signatures, certificate chains, timestamps and names need X.509, which is a
port: ``checks`` takes their outcomes as boolean columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delegation import merkle_root

MEDIA_TYPE = "application/vnd.dev.sigstore.bundle.v0.3+json"
#: The older name of the same media type.
ALIAS = "application/vnd.dev.sigstore.bundle+json;version=0.3"
_CERT = "struct<rawBytes:string>"
_ENTRY = "struct<logIndex:string,logId:struct<keyId:string>,integratedTime:string,inclusionPromise:struct<signedEntryTimestamp:string>,inclusionProof:struct<logIndex:string,rootHash:string,treeSize:string,hashes:array<string>>,canonicalizedBody:string>"
SCHEMA = (
    f"mediaType string, verificationMaterial struct<certificate:{_CERT},x509CertificateChain:struct<certificates:array<{_CERT}>>,publicKey:struct<hint:string>,tlogEntries:array<{_ENTRY}>>, "
    "messageSignature struct<messageDigest:struct<algorithm:string,digest:string>,signature:string>, dsseEnvelope struct<payload:string>"
)
ORDER = ["media_type", "signature", "chain", "timestamp", "identity", "validity"]


def parse_bundle(json: Column) -> tuple[Column, Column]:
    """(bundle, error) of a bundle in wire format. The first log entry counts; public keys and envelopes are not supported."""
    b = F.from_json(json, SCHEMA)
    m, entry = b["verificationMaterial"], F.get(b["verificationMaterial"]["tlogEntries"], F.lit(0))
    certificates = F.coalesce(F.when(m["certificate"].isNotNull(), F.array(m["certificate"]["rawBytes"])), F.transform(m["x509CertificateChain"]["certificates"], lambda c: c.rawBytes))
    error = (
        F.when(b.isNull() | b["mediaType"].isNull(), "unreadable")
        .when(m["publicKey"].isNotNull(), "public_key_unsupported")
        .when(b["dsseEnvelope"].isNotNull(), "envelope_unsupported")
        .when(certificates.isNull(), "no_certificate")
        .when(b["messageSignature"]["messageDigest"].isNull(), "no_digest")
        .when(entry.isNull(), "no_log_entry")
    )
    proof = entry["inclusionProof"]
    out = F.struct(
        F.when(b["mediaType"] == ALIAS, MEDIA_TYPE).otherwise(b["mediaType"]).alias("media_type"), certificates.alias("certificates"), b["messageSignature"]["signature"].alias("signature"), b["messageSignature"]["messageDigest"].alias("digest"),
        entry["canonicalizedBody"].alias("body"), entry["integratedTime"].try_cast("long").alias("integrated_time"), F.lower(F.hex(F.unbase64(entry["logId"]["keyId"]))).alias("log_id"), entry["inclusionPromise"]["signedEntryTimestamp"].alias("set"),
        F.when(proof.isNotNull(), F.struct(proof["logIndex"].try_cast("long").alias("index"), F.lower(F.hex(F.unbase64(proof["rootHash"]))).alias("root"), proof["treeSize"].try_cast("long").alias("size"), F.transform(proof["hashes"], lambda h: F.lower(F.hex(F.unbase64(h)))).alias("path"))).alias("proof"),
    )
    return F.when(error.isNull(), out), error


def included(body: Column, proof: Column) -> Column:
    """Whether the entry's path leads to the stated root."""
    return F.coalesce(merkle_root(F.unbase64(body), proof["index"], proof["size"], proof["path"]) == proof["root"], F.lit(False))


def binding_error(body: Column, message: Column, signature: Column) -> Column:
    """Null if a log entry is about this artifact and signature, else what differs."""
    text = F.unbase64(body).cast("string")
    hash_, content = F.get_json_object(text, "$.spec.data.hash.value"), F.get_json_object(text, "$.spec.signature.content")
    return (
        F.when(F.try_parse_json(text).isNull(), "body_unreadable")
        .when(hash_.isNull(), "no_artifact_hash")
        .when(hash_ != F.sha2(message, 256), "artifact_mismatch")
        .when(content.isNull(), "no_signature")
        .when(content != signature, "signature_mismatch")
    )


def checks(rows: DataFrame, bundle: Column, message: Column, log_id: Column, ports: dict[str, Column]) -> Column:
    """First failing check in the fixed order, or null. ``ports`` holds outcomes of what needs certificates, by the names in ``ORDER`` and ``set``; a missing one counts as failed."""
    ok = lambda name: F.coalesce(ports.get(name, F.lit(False)), F.lit(False))
    out = F.when(bundle["media_type"] != MEDIA_TYPE, "media_type").when(~ok("signature"), "signature").when(F.size(bundle["certificates"]) == 0, "empty_chain")
    for name in ORDER[2:]:
        out = out.when(~ok(name), name)
    return (
        out.when(bundle["log_id"] != log_id, "log_id")
        .when(bundle["set"].isNull(), "missing_set")
        .when(~ok("set"), "set")
        .when(bundle["proof"].isNull(), "missing_inclusion_proof")
        .when(~included(bundle["body"], bundle["proof"]), "inclusion_proof")
        .otherwise(binding_error(bundle["body"], message, bundle["signature"]))
    )
