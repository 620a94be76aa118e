"""The command line: ``python -m sievegate COMMAND``; results as JSON lines, exit codes by verdict."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facade import Admission
from .operators import delegation as lease
from .operators import emit, signing, tokenizer
from .policy import Policy, load_policy
from .sources import readers, sinks


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sievegate").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievegate")
    p.add_argument("--policy", help="TOML file")
    p.add_argument("--ranks", help="rank file of the vocabulary")
    p.add_argument("--encoding", default="r50k_base")
    p.add_argument("--fail-on", choices=["never", "deny", "flag"], default="never")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c.add_argument(*o[0], **o[1]) for c in [sub.add_parser(name)] for o in options]
    o = lambda *names, **kw: (names, kw)
    texts = [o("--text"), o("--path", help="files of text"), o("--evidence", help="folder for evidence lines")]
    for name in ("scan", "sentinel", "tokenize", "attest"):
        add(name, *texts, o("--key", help="private key in PEM"), o("--allow", default="none", help="special tokens: none, all or names"))
    for name in ("tokenize-batch", "decode-batch", "mcp", "probe", "multimodal", "lease-verify"):
        add(name, o("input", help="JSON array file"), o("--allow", default="none"), o("--now", type=int, default=0))
    add("decode", o("ids", nargs="+", type=int))
    add("perceive", o("path"), o("--modality", default="text"))
    add("keygen", o("--out", required=True))
    for name in ("verify-receipt", "verify-attestation"):
        add(name, o("--message"), o("--signature"), o("--envelope"), o("--key", required=True))
    lease_fields = [o("--principal", required=True), o("--delegatee", required=True), o("--digest", required=True), o("--capability", action="append", default=[]), o("--ceiling", choices=lease.CEILINGS, default="act"), o("--max-depth", type=int, default=3), o("--validity", type=int, default=3600), o("--now", type=int, default=0)]
    add("lease-create", *lease_fields)
    add("lease-revoke", o("input", help="JSON array of leases"), o("--lease", action="append", default=[]))
    for name in ("envelope-create", "envelope-verify"):
        add(name, o("input", help="JSON array of envelopes: id, lease_id, lease_digest, receipt_digest, payload, issued, expires"), o("--now", type=int, default=0))
    add("bench", o("--rounds", type=int, default=5), o("--format", choices=["json", "jsonl", "csv", "human"], default="json"), o("input", help="JSON array of texts"))
    add("telemetry", o("input", help="JSON array of bench results"), o("--false-positives", type=float, default=0.0), o("--reference", action="append", default=[]))
    return p


def _texts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if (a.text is None) == (a.path is None):
        raise ValueError("one of --text and --path is needed")
    if a.text is not None:
        return spark.createDataFrame([("text", a.text)], "doc_id string, text string")
    return readers.read_texts(spark, a.path).select(F.col("path").alias("doc_id"), "text")


def run(a: argparse.Namespace, spark: SparkSession) -> tuple[list[dict] | str, int]:
    policy = Policy()
    if a.policy:
        with open(a.policy) as f:
            policy = load_policy(f.read())
    engine = Admission(replace(policy, vocab=a.encoding), a.ranks)
    allow = getattr(a, "allow", "none")
    allowed = allow if allow in ("none", "all") else tuple(allow.split(","))
    array = lambda element: readers.read_json_array(spark, a.input, element).where("status = 'ok'")
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    c = a.command
    if c in ("scan", "sentinel"):
        out = engine.scan_text(_texts(spark, a)) if c == "scan" else engine.inspect_sentinel(_texts(spark, a))
        if a.evidence:
            sinks.write_evidence(emit.assessed(out, policy), a.evidence)
        verdict = F.col("verdict" if c == "scan" else "composite")
        found = rows(out.withColumn("exit_code", emit.exit_code(verdict, a.fail_on)).drop("text"))
        return found, max((r["exit_code"] for r in found), default=0)
    if c == "tokenize":
        return rows(tokenizer.encode_spans(_texts(spark, a), engine._ranks(), a.encoding, allowed=allowed)), 0
    if c == "tokenize-batch":
        return rows(tokenizer.encode(array("string").select(F.col("pos").alias("doc_id"), F.col("value").alias("text")), engine._ranks(), a.encoding, allowed=allowed)), 0
    if c in ("decode", "decode-batch"):
        ids = spark.createDataFrame([(0, a.ids)], "doc_id int, ids array<int>") if c == "decode" else array("array<int>").select(F.col("pos").alias("doc_id"), F.col("value").alias("ids"))
        return rows(tokenizer.decode(ids, engine._ranks(), a.encoding)), 0
    if c == "attest":
        docs = _texts(spark, a).withColumn("token_count", F.lit(0))
        if not a.key:
            return rows(engine.receipts(docs).drop("text")), 0
        with open(a.key) as f:
            key = signing.load_private(f.read())
        signed = replace(engine, signer=lambda: lambda m: signing.sign(key, m)).receipts(docs)
        return rows(signed.drop("text").withColumn("key_id", F.lit(signing.key_id(signing.public(key))))), 0
    if c == "verify-receipt":
        ok = signing.verify(signing.load_public(a.key), a.message.encode(), bytes.fromhex(a.signature))
        return [{"valid": ok}], 0 if ok else 1
    if c == "verify-attestation":
        with open(a.envelope) as f:
            df = spark.createDataFrame([(f.read(),)], "json string")
        pae, signature = signing.envelope_parts(F.col("json"))
        ok = df.select(pae.alias("p"), signature.alias("s")).select(signing.verified(F.col("p"), F.col("s"), a.key).alias("ok")).first().ok
        return [{"valid": ok}], 0 if ok else 1
    if c == "keygen":
        key = signing.generate()
        for path, text in ((a.out, signing.private_pem(key)), (f"{a.out}.pub", signing.public_pem(signing.public(key)))):
            with open(path, "x") as f:
                f.write(text)
        return [{"key_id": signing.key_id(signing.public(key)), "public_key": signing.point_bytes(signing.public(key)).hex()}], 0
    if c == "perceive":
        return rows(engine.perceive(readers.read_artifacts(spark, a.path, a.modality))), 0
    if c == "mcp":
        r = array("struct<session:string,seq:int,server_id:string,request_hash:string,response:string>").select("value.*")
        none = spark.createDataFrame([], "server_id string, trust int, threshold double, budget int")
        done = engine.inspect_responses(r, none, "session", "seq")
        found = rows(done.select("session", "seq", "server_id", "response_hash", "verdict", "final_verdict", "taint", emit.exit_code(F.col("final_verdict"), a.fail_on).alias("exit_code")))
        return found, max((r["exit_code"] for r in found), default=0)
    if c == "probe":
        s = array("struct<input:string,output:string,latency_ms:bigint>").select("value.*")
        none = s.select("input", F.col("output").alias("fragment")).limit(0)
        return rows(engine.probe_health(s, s, none, none, none)), 0
    if c == "multimodal":
        r = array("struct<bundle:string,modality:string,content:string,provenance:string,derived:boolean>").select("value.*")
        return rows(engine.inspect_modalities(r, "bundle")), 0
    if c == "lease-create":
        df = spark.createDataFrame([(a.principal, a.delegatee, a.digest, a.capability, lease.CEILINGS.index(a.ceiling), a.max_depth)], "principal string, delegatee string, representation_digest string, capabilities array<string>, ceiling int, max_depth int")
        return rows(lease.root_lease(df, F.lit(a.now), F.lit(a.validity))), 0
    if c == "lease-verify":
        r = array("struct<chain:string,hop:int,lease_id:string,parent_id:string,principal:string,delegatee:string,depth:int,max_depth:int,ceiling:int,expires:bigint,capabilities:array<string>>").select("value.*")
        found = rows(lease.chain_errors(r, "chain", "hop"))
        return found, int(any(x["first_error"] for x in found))
    if c == "lease-revoke":
        r = array("struct<lease_id:string,parent_id:string>").select("value.*")
        return rows(lease.revoked_leases(r, spark.createDataFrame([(x,) for x in a.lease], "lease_id string")).orderBy("lease_id")), 0
    if c in ("envelope-create", "envelope-verify"):
        r = array("struct<id:string,lease_id:string,lease_digest:string,receipt_digest:string,payload:string,issued:bigint,expires:bigint>").select("value.*")
        if c == "envelope-create":
            return rows(r.withColumn("message", lease.envelope_message(F.col("id"), F.col("lease_id"), F.col("receipt_digest"), F.col("payload")))), 0
        status = lease.lease_status(F.lit(a.now), F.col("issued"), F.col("expires"), F.lit(1), F.lit(1), F.lit(False))
        found = rows(r.select("id", lease.envelope_error(status, F.col("lease_digest"), F.col("receipt_digest")).alias("error")))
        return found, int(any(x["error"] for x in found))
    if c == "bench":
        texts = array("string").select(F.col("pos").alias("doc_id"), F.col("value").alias("text")).cache()
        with open(engine._ranks()) as f:
            vocab = tokenizer.Vocabulary(a.encoding, tokenizer.load_ranks(f.read()))
        plain = [r.text for r in texts.orderBy("doc_id").collect()]
        began = time.perf_counter_ns()
        one = [vocab.encode(t, "all") for _ in range(a.rounds) for t in plain][: len(plain)]
        middle = time.perf_counter_ns()
        for _ in range(a.rounds):
            many = [r.ids for r in tokenizer.encode(texts, engine._ranks(), a.encoding, allowed="all").orderBy("doc_id").collect()]
        tokens = max(1, a.rounds * sum(map(len, one)))
        result = {"preset": a.encoding, "sequential_ns": (middle - began) / tokens, "parallel_ns": (time.perf_counter_ns() - middle) / tokens, "tokens": tokens, "outputs_match": one == many}
        return sinks.bench_report([result], a.format), 0 if result["outputs_match"] else 1
    if c == "telemetry":
        with open(a.input) as f:
            return [sinks.telemetry(json.load(f), a.false_positives, a.reference)], 0
    raise ValueError(f"unknown command {c}")


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    try:
        out, code = run(a, session())
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 3
    print(out if isinstance(out, str) else "\n".join(json.dumps({"result": r}, default=str, ensure_ascii=False) for r in out))
    return code


if __name__ == "__main__":
    sys.exit(main())
