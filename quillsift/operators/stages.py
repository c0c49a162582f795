"""Sanitizing stage by stage, with what each stage counted and how long it took.

``sanitize.sanitize`` is one plan, in which stages can't be timed apart. Here each
stage is written before the next one begins, as a run that must be watched, or taken
up again, wants it. Counts are observed while a stage is written, so that nothing is
read for them again; they and the times go into the audit rows.

Defined results: the rows are those of ``sanitize``. A stage of no rows counts zero.
A stage that fails ends the run with its error, after which ``metrics`` has the
stages that ended and the one that failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillsift.operators import detect, redact, sanitize
from quillsift.sources import scratch

#: The stages in their order; ``total`` covers them all and what lies between.
STAGES = ("loading", "model", "rules", "fusion", "redaction", "total")


@dataclass
class Run:
    """One run over a table: the status of each stage, as it goes, and at the end the sanitized rows."""

    policy: dict[str, str] | None = None
    on_error: str = "drop"
    told: Callable[[str, str], None] = lambda stage, status: None
    metrics: dict[str, dict] = field(default_factory=dict)

    def _stage(self, name: str, made: Callable[[], DataFrame], **counts: Column) -> DataFrame:
        self.told(name, "active")
        began, seen = time.perf_counter(), Observation(f"quillsift_{name}_{id(self)}")
        self.metrics[name] = {"status": "active"}
        try:
            df = made()
            out = scratch.written(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(c.alias(k) for k, c in counts.items())))
        except Exception:
            self.metrics[name] = {"status": "failed", "ms": round(1000 * (time.perf_counter() - began))}
            self.told(name, "failed")
            raise
        self.metrics[name] = {"status": "completed", "ms": round(1000 * (time.perf_counter() - began)), **seen.get}
        self.told(name, "completed")
        return out

    def sanitize(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", visual: DataFrame | None = None) -> DataFrame:
        """The rows of ``sanitize.sanitize``, each stage written on its way."""
        began = time.perf_counter()
        own = self._stage("loading", lambda: df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n_null=F.count_if(F.col("text").isNull()))
        docs = own.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        model = self._stage("model", lambda: sanitize.model_hits(docs))
        ruled = self._stage("rules", lambda: sanitize.rule_hits(detect.detect_all(docs)))
        found = self._stage("fusion", lambda: sanitize.summaries(sanitize.judged(ruled.unionByName(model), self.policy), visual, self.policy), n_regions=F.coalesce(F.sum(F.size("regions")), F.lit(0)))
        out = self._stage("redaction", lambda: sanitize.masked_rows(own, found, text_col, id_col, self.on_error), n_masked=F.coalesce(F.sum("n_masked"), F.lit(0)), n_failed=F.count_if(~F.col("sanitized")))
        self.metrics["total"] = {"status": "completed", "ms": round(1000 * (time.perf_counter() - began)), "n_rows": self.metrics["redaction"]["n_rows"]}
        return out

    def table(self, df: DataFrame) -> DataFrame:
        """(stage, status, ms, n_rows) of the stages so far."""
        rows = [(s, m["status"], m.get("ms"), m.get("n_rows")) for s in STAGES if (m := self.metrics.get(s))]
        return df.sparkSession.createDataFrame(rows, "stage string, status string, ms long, n_rows long")

    def audit(self, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Audit rows of sanitized ``rows``, with the run's times by stage; whether raw text left follows from each row's own outcome."""
        times = F.create_map(*(F.lit(x) for s, m in self.metrics.items() for x in (s, m.get("ms"))))
        about = {"stages_ms": times, "processing_ms": F.lit(self.metrics["total"]["ms"])}
        raw = F.lit(self.on_error == "raw") & F.col("error").isNotNull()
        return redact.audit(rows.withColumnRenamed(id_col, "doc_id"), ~raw, about, F.col("error"))
