"""One object for the engine's entry points: a policy, and the ports that a deployment brings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import decision, emit, gate, intake, probe, signing, terminal, tokenizer
from .operators.payloads import perplexity, surprisals
from .perception import adapters
from .policy import Policy


@dataclass(frozen=True)
class Admission:
    """Texts, bytes, tool responses, bundles and model samples under one policy.

    Ports: ``signer`` makes a signing callable on the executor, ``scanner`` finds
    terminal sequences, ``scorer`` gives surprisals, ``perceivers`` read
    artifacts by modality.
    """

    policy: Policy = field(default_factory=Policy)
    ranks_path: str | None = None
    signer: Callable[[], Callable[[bytes], bytes]] | None = None
    scanner: Callable[[bytes], list] | None = terminal.scan_bytes
    scorer: Callable[[str], object] = surprisals
    perceivers: dict[str, list[adapters.Port]] = field(default_factory=dict)

    def scan_text(self, docs: DataFrame, text: str = "text", spans: bool = False) -> DataFrame:
        return emit.scan(docs, self.policy, text, spans)

    def scan_bytes(self, docs: DataFrame, raw: str = "content") -> DataFrame:
        """Bytes as text: what is no UTF-8 is repaired in monitor mode, else an error of its row."""
        text, status = intake.utf8(F.col(raw), self.policy.mode)
        out = emit.scan(docs.withColumn("text", text), self.policy)
        return out.withColumn("status", F.when(status == "invalid_utf8", status).otherwise(F.col("status")))

    def process(self, segments: DataFrame, key: str, order: str, text: str = "text", provenance: str = "provenance") -> DataFrame:
        """Segments of an input through scan, merge, verdict and receipt: a row a key, with annotated tokens."""
        merged = tokenizer.merged(segments, self._ranks(), key, order, self.policy.vocab, text, provenance, self.policy.suppress_cross_boundary, self.policy.intake.normalization)
        whole = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("s")).select(key, F.array_join(F.transform("s", lambda s: F.coalesce(s.t, F.lit(""))), "").alias("text"))
        rows = emit.absorb(emit.scan(whole, self.policy).join(merged.select(key, "tokens", F.col("findings").alias("merge_findings")), key), F.col("merge_findings"))
        rows = rows.withColumn("verdict", emit.verdict(F.col("max_rank"), self.policy.mode)).drop("merge_findings")
        return self.receipts(rows.withColumn("token_count", F.size("tokens")))

    def receipts(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with raw and canonical digests, the receipt message and, with a signer, its signature."""
        form = self.policy.intake.normalization
        raw, canonical = emit.digests(F.col(text), intake.canonical(F.col(text), form, self.policy.intake.invisible == "strip"))
        out = rows.withColumns({"raw_digest": raw, "canonical_digest": canonical})
        out = out.withColumn("message", emit.receipt_message(F.col("raw_digest"), F.col("canonical_digest"), "sha384", form, self.policy.vocab, F.col("token_count")))
        return out.withColumn("signature", signing.signatures(F.col("message"), self.signer)) if self.signer else out

    def perplexity(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return perplexity(docs, key, text, self.scorer)

    def terminal(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return terminal.terminal_reports(docs, key, text, self.scanner)

    def inspect_responses(self, responses: DataFrame, profiles: DataFrame, session: str, order: str, **options) -> DataFrame:
        return gate.inspect(responses, profiles, session, order, self.policy, **options)

    def inspect_modalities(self, inputs: DataFrame, bundle: str) -> DataFrame:
        """Bundles of (modality, content, provenance, derived): fusion events, correlations, verdict and authority ceiling."""
        rows = emit.scan(inputs, self.policy, "content")
        rows = rows.withColumn("instruction", decision.instruction_signal(F.col("verdict"), F.col("reasons"), F.col("max_rank")))
        found = F.lit(False)
        for m in decision.MODALITY:
            found = F.when(F.col("modality") == m, F.size(decision.modality_findings(F.col("content"), m, F.col("max_rank"))) > 0).otherwise(found)
        rows = rows.withColumn("modal", F.when(F.col("modality").isin("vision", "audio", "code"), decision.modality_verdict(F.col("max_rank"), found)))
        each = rows.groupBy(bundle).agg(*[F.max(F.when(F.col("modality") == m, F.col("modal"))).alias(m) for m in ("vision", "audio", "code")], F.max(F.when(F.col("modality") == "text", F.col("max_rank"))).alias("text_rank"), F.max("max_rank").alias("taint"))
        crossed = decision.fusion(rows, bundle).join(decision.correlations(rows.withColumn("rank", F.col("max_rank")), bundle), bundle).join(each, bundle)
        events = F.greatest("cross_trust", "cross_role", "instruction", "derived_authority")
        cross = decision.cross_modal_verdict(F.greatest(events, F.col("taint")), F.col("correlations"))
        modal = [F.coalesce(F.col(m), F.lit("allow")) for m in ("vision", "audio", "code")]
        out = crossed.withColumn("verdict", decision.fold_verdicts(modal, F.coalesce("text_rank", F.lit(0)), F.col("taint"), cross))
        return out.withColumn("ceiling", decision.authority_ceiling(F.col("verdict"), events)).drop("vision", "audio", "code", "text_rank")

    def inspect_sentinel(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Scan and sentinel together, with the composed verdict and the training signal."""
        rows = emit.scan(docs, self.policy, text)
        scores = decision.sentinel(F.col(text), F.col("max_rank"), emit.has(F.col("findings"), "dlp_credit_card", "dlp_ssn", "dlp_api_key", "dlp_email", "dlp_custom"))
        rows = rows.withColumns(scores).withColumn("action", decision.sentinel_action(F.col("threat"), F.col("safety")))
        return rows.withColumns({"composite": decision.compose(F.col("max_rank"), F.col("action"), F.col("threat")), "training_signal": decision.training_signal(F.col("max_rank"), F.col("action"))})

    def probe_health(self, samples: DataFrame, baseline: DataFrame, canaries: DataFrame, fingerprints: DataFrame, boundaries: DataFrame, baseline_age_s: Column | None = None) -> DataFrame:
        """One row: signals, drift, health score and the action they ask for."""
        found = probe.signals(samples, baseline, canaries, fingerprints, boundaries)
        one = found.agg(F.collect_list(F.struct("kind", "score", "severity")).alias("signals"))
        scores = F.transform("signals", lambda s: s.score)
        identity = 1 - F.coalesce(F.get(F.transform(F.filter("signals", lambda s: s.kind == "model_identity"), lambda s: s.score), F.lit(0)), F.lit(0.0))
        one = one.withColumn("drift", probe.aggregate_drift(scores)).withColumn("score", probe.health_score(F.col("drift"), scores, identity))
        triggered = F.exists("signals", lambda s: s.score >= 0.75)
        return one.withColumns({"drift_band": probe.drift_band(F.col("drift")), "action": probe.action(triggered, F.col("score"), identity, F.col("drift"), F.lit(0) if baseline_age_s is None else baseline_age_s)})

    def perceive(self, artifacts: DataFrame) -> DataFrame:
        return adapters.perceive(artifacts, self.perceivers)

    def _ranks(self) -> str:
        if not self.ranks_path:
            raise ValueError("a rank file is needed for tokens")
        return self.ranks_path
