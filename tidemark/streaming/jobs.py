"""Streaming jobs: a change-log stream through rules into an index, failures to the dead letters and back."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.documents import render
from tidemark.model import DELETE
from tidemark.operators import dead_letters
from tidemark.plans.rules import ERRORS, RuleSet, apply_rules
from tidemark.session import settle
from tidemark.sinks.index import FailingStore, IndexStore, SinkError
from tidemark.sinks.letters import LetterStore

_EVENT, _ERROR = "__event_", "__error"


@dataclass
class SyncJob:
    """What a job reads and writes.

    ``error``: a column of the batch, the reason to reject an event, or null.
    ``rules`` apply to the documents of the tables in ``schemas`` (table: DDL of its
    document); an event that they reject becomes a dead letter of type
    "transform", and all events of a batch whose sink fails letters of type "sink".
    Deletions and other tables pass as they are.
    """

    job_id: str
    store: IndexStore | FailingStore
    dead_letter_path: str
    checkpoint: str
    error: Callable[[DataFrame], Column] | None = None
    rules: RuleSet | None = None
    schemas: dict[str, str] = field(default_factory=dict)
    source_id: str | None = None
    interval: str = "5 seconds"
    max_retries: int = 3
    base_seconds: int = 30
    enabled: bool = True
    query: StreamingQuery | None = field(default=None, repr=False)

    def __post_init__(self):
        self.letter_store = LetterStore(self.store.spark, self.dead_letter_path)

    def judged(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(events as they are to be written, rejected ones as they came with the reason in ``__error``)."""
        names = events.columns
        checked = events.withColumn(_ERROR, self.error(events) if self.error else F.lit(None).cast("string"))
        good, bad = checked.filter(F.col(_ERROR).isNull()).drop(_ERROR), checked.filter(F.col(_ERROR).isNotNull())
        if not self.rules or not self.schemas:
            return good, bad
        ruled = F.coalesce(F.col("table").isin(*self.schemas) & (F.upper("op") != DELETE), F.lit(False))
        out = good.filter(~ruled)
        for table, schema in self.schemas.items():
            own = good.filter(ruled & (F.col("table") == table)).withColumn("__doc", F.from_json("data", schema))
            object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("data")).startswith("OBJECT"), F.lit(False))
            bad = bad.unionByName(own.filter(~object_).select(*names, F.lit("data is no JSON object").alias(_ERROR)))
            rows = own.filter(object_).select(*[F.col(c).alias(_EVENT + c) for c in names], "__doc.*")
            fine, rejected = apply_rules(rows, table, self.rules, self.source_id)
            back = [F.col(_EVENT + c).alias(c) for c in names]
            bad = bad.unionByName(rejected.select(*back, F.array_join(ERRORS, "; ").alias(_ERROR)))
            document = render(fine, [c for c in fine.columns if not c.startswith(_EVENT)])
            out = out.unionByName(fine.select(*[document.alias(c) if c == "data" else b for c, b in zip(names, back)]))
        return out, bad

    def _items(self, events: DataFrame, kind: str) -> DataFrame:
        """Events with ``__error`` as new dead letters."""
        key = dead_letters.dedupe_key(F.lit(self.job_id), F.col("pk"), F.col("position"))
        return events.select(F.sha2(key, 256).alias("item_id"), F.lit(self.job_id).alias("job_id"), "op", "pk", "position", "seq", "table", "data", F.lit(kind).alias("error_type"), F.col(_ERROR).alias("error_msg"), F.lit(0).alias("retry_count"), F.lit(self.max_retries).alias("max_retries"), F.current_timestamp().alias("first_failed"), F.lit(None).cast("timestamp").alias("last_retried"), F.lit("pending").alias("status"))

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: good events to the index, bad ones to the dead letters. Both writes are safe to repeat."""
        batch = batch.persist()
        try:
            good, bad = self.judged(batch)
            items = self._items(bad, "transform")
            try:
                self.store.write(good)
            except SinkError as e:
                # as they came, so that a retry judges them anew
                kept = batch.join(bad.select("pk", "position").distinct(), ["pk", "position"], "left_anti") if self.error or self.rules else batch
                items = items.unionByName(self._items(kept.withColumn(_ERROR, F.lit(str(e))), "sink"))
            self.letter_store.add(items, f"batch-{batch_id}")
        finally:
            batch.unpersist()

    def letters(self) -> DataFrame:
        """All dead letters as they are now."""
        return self.letter_store.state()

    def start(self, events: DataFrame, once: bool = False) -> StreamingQuery:
        """Resumes from its checkpoint; ``once`` takes what is there and stops."""
        writer = events.writeStream.queryName(self.job_id).option("checkpointLocation", self.checkpoint).foreachBatch(self.handle)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval)).start()
        return self.query

    def status(self) -> str:
        if not self.enabled:
            return "DISABLED"
        return "RUNNING" if self.query is not None and self.query.isActive else "STOPPED"

    def retry(self, fix: Callable[[DataFrame], DataFrame] = lambda df: df, now: Column | None = None) -> dict[str, int]:
        """One round of the scheduler: items that a crash left in "retrying" are pending again, and eligible ones are replayed."""
        now = F.current_timestamp() if now is None else now
        open_ = dead_letters.recovered(self.letter_store.opened())
        return self.replay(open_.filter(dead_letters.eligible(now, self.base_seconds)), fix, now)

    def replay(self, due: DataFrame, fix: Callable[[DataFrame], DataFrame] = lambda df: df, now: Column | None = None, letters: LetterStore | None = None) -> dict[str, int]:
        """Dead letters through rules and index again; older events lose to newer rows there.

        Each becomes resolved, pending with one more try, or exhausted, and the counts
        of these are returned. ``fix`` changes items before they are judged.
        """
        now, letters = F.current_timestamp() if now is None else now, letters or self.letter_store
        # what is due is decided once, before the log changes
        due = settle(due)
        if due.isEmpty():
            return {}
        letters.put(due.withColumn("status", F.lit("retrying")))
        good, _ = self.judged(fix(due))
        try:
            self.store.write(good)
            done = good.select("item_id", F.lit(True).alias("__done")).distinct()
        except SinkError:
            done = good.limit(0).select("item_id", F.lit(True).alias("__done"))
        after = settle(dead_letters.after_retry(due.join(done, "item_id", "left"), F.col("__done"), now).drop("__done"))
        letters.put(after)
        return {r["status"]: r["count"] for r in after.groupBy("status").count().collect()}


class JobManager:
    """Jobs by id: create, list, start, stop, retry, remove."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def create(self, job: SyncJob) -> None:
        if job.job_id in self.jobs:
            raise ValueError(f"job {job.job_id!r} exists")
        self.jobs[job.job_id] = job

    def list(self) -> DataFrame:
        rows = [(j.job_id, j.status(), j.enabled) for j in self.jobs.values()]
        return self.spark.createDataFrame(rows, "job_id string, status string, enabled boolean")

    def health(self) -> DataFrame:
        """(job_id, healthy, reason): a job is well unless its stream ended with an error."""
        failed = {j.job_id: j.query.exception() for j in self.jobs.values() if j.query is not None}
        return self.spark.createDataFrame([(k, failed.get(k) is None, str(failed[k])[:500] if failed.get(k) else None) for k in self.jobs], "job_id string, healthy boolean, reason string")

    def start(self, job_id: str, events: DataFrame, once: bool = False) -> StreamingQuery:
        job = self.jobs[job_id]
        if not job.enabled:
            raise ValueError(f"job {job_id!r} is disabled")
        return job.start(events, once)

    def stop(self, job_id: str) -> None:
        job = self.jobs[job_id]
        if job.query is not None and job.query.isActive:
            job.query.stop()

    def retry(self, letters: LetterStore, now: Column | None = None) -> dict[str, int]:
        """Eligible items of a log that jobs share: each goes to its own job, else to the first enabled one; without any it has failed once more."""
        now = F.current_timestamp() if now is None else now
        due = settle(dead_letters.recovered(letters.opened()).filter(dead_letters.eligible(now)))
        routed = due.join(dead_letters.route_retry(due, self.list()), "item_id")
        total: dict[str, int] = {}
        for job in self.jobs.values():
            if job.enabled:
                for status, n in job.replay(routed.filter(F.col("target_job") == job.job_id).drop("target_job"), now=now, letters=letters).items():
                    total[status] = total.get(status, 0) + n
        lost = settle(dead_letters.after_retry(routed.filter("target_job is null").drop("target_job"), F.lit(False), now))
        if not lost.isEmpty():
            letters.put(lost)
            for r in lost.groupBy("status").count().collect():
                total[r["status"]] = total.get(r["status"], 0) + r["count"]
        return total

    def remove(self, job_id: str) -> None:
        self.stop(job_id)
        del self.jobs[job_id]


def commit_log(query: StreamingQuery) -> list[dict]:
    """A checkpoint record for each recent batch: position, input rows, rows a second."""
    out = []
    for p in query.recentProgress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "position": json.dumps(p["sources"][0]["endOffset"]) if p["sources"] else ""})
    return out
