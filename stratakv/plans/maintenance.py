"""The service's background loops as a schedule of batches: migration, expiry, record upgrades."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.functions import codec
from stratakv.plans.engine import Engine
from stratakv.session import materialize
from stratakv.sources.versions import VersionedTable

#: Tables of stored records, as older stores left them.
RECORDS = T.StructType([T.StructField("key", T.StringType()), T.StructField("raw", T.BinaryType())])


@dataclass
class Upgrade:
    """One pass over a table of records in key order that rewrites those of the older format, a batch at a time.

    Times and TTLs stay. A record that can't be read stays as it is and does not come up again in the pass.
    """

    table: VersionedTable
    batch: int = 500
    after: str | None = None
    done: bool = False

    def step(self) -> int:
        """How many records were rewritten; the pass is done when no older record follows."""
        rows = self.table.read()
        if self.after is not None:
            rows = rows.where(F.col("key") > self.after)
        found = materialize(codec.legacy_batch(rows, self.batch))
        last = found.agg(F.max("key").alias("key"), F.count("*").alias("n")).first()
        if last.n == 0:
            self.done = True
            return 0
        fresh = materialize(found.withColumn("raw", codec.upgrade_records("raw")).where(F.substring("raw", 1, 1) == F.lit(bytes([codec.RECORD_MARK]))))
        n = fresh.count()
        if n:
            self.table.apply(upserts=fresh)
        self.after = last.key
        return n



@dataclass
class Schedule:
    """Jobs with their intervals in seconds. Each is due at once, then whenever its interval has passed."""

    engine: Engine
    migration_every: int = 60
    expiry_every: int = 300
    upgrade: Upgrade | None = None
    upgrade_every: int = 1
    last: dict[str, float] = field(default_factory=dict)

    def due(self, job: str, every: int, now: float) -> bool:
        if job in self.last and now - self.last[job] < every:
            return False
        self.last[job] = now
        return True

    def tick(self, now: float, as_of: str) -> dict[str, int]:
        """Runs what is due; what each did. Migration waits for the disk to fill up to its threshold."""
        done = {}
        if self.due("migration", self.migration_every, now):
            done["migrated"] = self.engine.migrate(as_of) if self.engine.should_migrate() else 0
        if self.engine.config.ttl_rules and self.due("expiry", self.expiry_every, now):
            done["expired"] = self.engine.expire(as_of)
        if self.upgrade and not self.upgrade.done and self.due("upgrade", self.upgrade_every, now):
            done["upgraded"] = self.upgrade.step()
        return done

    def run(self, clock: Callable[[], str], ticks: int, pause: float = 1.0) -> None:
        for _ in range(ticks):
            self.tick(time.monotonic(), clock())
            time.sleep(pause)
