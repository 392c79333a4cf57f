"""Assessments and overrides, stored by key.

A table is a set of runs.  A run is a Parquet folder split by a hash of the assessment id into
buckets; inside a bucket rows are sorted by id and carry a Bloom filter of the ids.  A batch is
a run of its own.  When runs add up they are merged, level by level, so their number grows with
the logarithm of the batches.  A commit file names the runs that count.

A batch looks up its own keys: it reads the buckets they fall into, and with few keys only the
row groups and pages that may have them.  What it costs follows from its own size, not from
the age of the table.

A batch that is written again replaces itself; once it has been merged, its rows stay and are
not stored twice.  Of two writers that commit at a time one gets an error and may try again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schemas import ASSESSMENTS, OVERRIDES
from riskweave.session import delete_path, stage
from riskweave.sources.commits import KEPT, CommitConflict, CommitLog

ID = "assessment_id"
TABLES = {"assessments": ASSESSMENTS, "overrides": OVERRIDES}
BUCKETS = 32
# Runs of one level before they are merged, the newest batch not counted.
MAX_RUNS = 6
# Rows of one file, about.
FILE_ROWS = 4_000_000
# With at most so many keys a lookup filters by them.
FEW_KEYS = 200


@dataclass(frozen=True)
class FeedbackStore:
    """``buckets`` counts for tables that are created, others keep theirs."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    max_runs: int = MAX_RUNS

    def initialise(self) -> "FeedbackStore":
        """Create both tables, empty, if they are absent."""
        for name in TABLES:
            log = self._log(name)
            if not log.versions():
                log.publish(1, {"buckets": self.buckets, "runs": [], "retired": []})
        return self

    @property
    def ready(self) -> bool:
        return all(self._log(name).versions() for name in TABLES)

    def assessments(self) -> DataFrame:
        return self._rows("assessments").drop("batch")

    def overrides(self) -> DataFrame:
        return self._rows("overrides").drop("batch")

    def overrides_before(self, batch: str) -> DataFrame:
        """Overrides of all other batches; a replayed batch must not see itself."""
        return self._rows("overrides").where(F.col("batch") != batch).drop("batch")

    def assessments_of(self, keys: DataFrame) -> DataFrame:
        """Stored assessments with the ids in ``keys``, which is read more than once."""
        return self._found("assessments", keys).drop("batch")

    def overrides_of(self, keys: DataFrame, before: str) -> DataFrame:
        """Overrides of other batches than ``before`` with the ids in ``keys``."""
        return self._found("overrides", keys).where(F.col("batch") != before).drop("batch")

    def around(self, name: str, keys: DataFrame, before: str | None = None) -> DataFrame:
        """Rows of a table, of other batches than ``before``, among them all with the ids in
        ``keys``: for callers that join them by id anyway."""
        rows = self._found(name, keys, exact=False)
        return (rows if before is None else rows.where(F.col("batch") != before)).drop("batch")

    def append_assessments(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append new assessments; returns the rows refused for a repeated id.

        Of rows that share an id inside the batch the first is stored: the earliest
        ``created_at``, then the earliest row of the batch.  The others are refused.
        """
        return self._append("assessments", rows, batch)

    def append_overrides(self, rows: DataFrame, batch: str, look_back: bool = True
                         ) -> DataFrame:
        """Append overrides that were accepted; returns the refused ones.  Without
        ``look_back`` the caller vouches that no other batch has them."""
        return self._append("overrides", rows, batch, look_back)

    def stream(self, name: str) -> DataFrame:
        """Rows of a table as a stream of the files that appear; a merged row appears again."""
        path = f"{self.root.rstrip('/')}/{name}/data"
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(
            self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop_path)
        return self.spark.readStream.schema(T.StructType([
            *self._schema(name).fields, T.StructField("run", T.StringType()),
            T.StructField("bucket", T.IntegerType())])).parquet(path)

    def files(self, name: str) -> list[str]:
        """Files that count."""
        return sorted(self._rows(name).inputFiles())

    # ---- runs -----------------------------------------------------------------

    def _log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root.rstrip('/')}/{name}/commits")

    def _run_path(self, name: str, run: str) -> str:
        return f"{self.root.rstrip('/')}/{name}/data/run={run}"

    def _state(self, name: str) -> tuple[int, dict]:
        version, state = self._log(name).latest()
        if state is None:
            raise RuntimeError("There is no feedback store to read.")
        return version, state

    def _schema(self, name: str) -> T.StructType:
        return T.StructType([*TABLES[name].fields, T.StructField("batch", T.StringType())])

    def _read(self, name: str, runs: list[dict], buckets: set[int] | None = None) -> DataFrame:
        """Rows of some runs, all or some buckets."""
        paths = [f"{self._run_path(name, r['run'])}/bucket={b}"
                 for r in runs for b in r["buckets"] if buckets is None or b in buckets]
        if not paths:
            # without a job or Python worker, and joins with it fold away
            return self.spark.range(0).select(*[
                F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(name).fields
            ]).where("false")
        return self.spark.read.schema(self._schema(name)).parquet(*paths)

    def _rows(self, name: str) -> DataFrame:
        return self._read(name, self._state(name)[1]["runs"])

    def _found(self, name: str, keys: DataFrame, state: dict | None = None,
               exact: bool = True) -> DataFrame:
        """Stored rows with one of ``keys``, out of the buckets that keys fall into.  Unless
        ``exact``, all rows of these buckets if the keys are not few beside the stored rows."""
        state = state or self._state(name)[1]
        if not state["runs"]:
            return self._read(name, [])
        keys = keys.select(ID).where(F.col(ID).isNotNull())
        counts = keys.groupBy(_bucket(state["buckets"]).alias("bucket")).count().collect()
        rows = self._read(name, state["runs"], {r["bucket"] for r in counts})
        if not counts:
            return rows.where("false")
        if sum(r["count"] for r in counts) <= 50 * FEW_KEYS:
            few = keys.distinct().limit(FEW_KEYS + 1).collect()
            if len(few) <= FEW_KEYS:
                # equalities reach the row groups' Bloom filters and the page index
                return rows.where(_either([F.col(ID) == r[ID] for r in few]))
        stored = sum(r["rows"] for r in state["runs"])
        if exact or 10 * sum(r["count"] for r in counts) < stored:
            return rows.join(keys.distinct(), ID, "left_semi")
        return rows

    def _write(self, name: str, rows: DataFrame, count: int, buckets: int, level: int,
               batch: str | None) -> dict:
        """Write a run and describe it; it does not count before it is committed."""
        run = uuid.uuid4().hex[:16]
        pieces = max(1, -(-count // (FILE_ROWS * buckets)))
        bucketed = rows.withColumn("bucket", _bucket(buckets))
        piece = F.pmod(F.xxhash64(F.lit("piece"), ID), F.lit(pieces))
        (
            bucketed.repartition("bucket", piece).sortWithinPartitions("bucket", ID)
            .write.partitionBy("bucket")
            .option(f"parquet.bloom.filter.enabled#{ID}", "true")
            .parquet(self._run_path(name, run))
        )
        found = self.spark.read.parquet(self._run_path(name, run)) if count else None
        used = [] if found is None else [
            r["bucket"] for r in found.select("bucket").distinct().collect()]
        return {"run": run, "level": level, "batch": batch, "rows": count,
                "buckets": sorted(used)}

    def _append(self, name: str, rows: DataFrame, batch: str, look_back: bool = True
                ) -> DataFrame:
        version, state = self._state(name)
        schema = TABLES[name]
        rows = stage(
            rows.select(
                *[F.col(f.name).cast(f.dataType) for f in schema.fields],
                F.monotonically_increasing_id().alias("_row"),
            ), "append",
        )
        # time and position as one number: a fixed-width value folds in a hash aggregate
        turn = (
            F.coalesce(F.unix_micros("created_at"), F.lit(0)).cast("decimal(38,0)")
            * F.lit(str(1 << 63)).cast("decimal(20,0)") + F.col("_row")
        ).cast("decimal(38,0)")
        rows = rows.withColumn("_turn", turn)
        columns = [f.name for f in schema.fields]
        replaced = [r for r in state["runs"] if r["batch"] == batch]
        others = dict(state, runs=[r for r in state["runs"] if r["batch"] != batch])
        stored = self._found(name, rows, others, exact=False) if look_back else self._read(name, [])
        chosen = rows.groupBy(ID).agg(F.min("_turn").alias("_turn"), F.count("*").alias("_rows"))
        # a merged batch that is written again finds its own rows
        merged = stored.select(F.col(ID).alias("_id"), (F.col("batch") == batch).alias("_own"))
        judged = chosen.join(merged, F.col(ID).eqNullSafe(F.col("_id")), "left").drop("_id")
        # ids that come once and are not stored need no further look
        odd = stage(judged.where("_rows > 1 OR _own IS NOT NULL"), "odd")
        total = odd.agg(F.count("*"), F.sum("_rows"), F.count_if(F.col("_own").isNull())).first()
        size = rows.count()
        count = size - (total[1] or 0) + total[2]
        if not total[0]:
            fresh, refused = rows, rows.where("false")
        else:
            if (total[1] or 0) < size:
                once = rows.groupBy(ID).agg(F.min("_turn").alias("_turn")).join(
                    odd.select(F.col(ID).alias("_id")), F.col(ID).eqNullSafe(F.col("_id")),
                    "left_anti").select(ID, "_turn", F.lit(None).cast("boolean").alias("_own"))
                first = once.unionByName(odd.select(*once.columns))
            else:
                first = odd
            first = first.where("_own IS NULL OR _own").withColumnsRenamed(
                {ID: "_first", "_turn": "_first_turn"})
            # the pair of keys spreads an id that many rows share
            same = F.col(ID).eqNullSafe(F.col("_first")) & (
                F.col("_turn") == F.col("_first_turn"))
            fresh = rows.join(first.where("_own IS NULL"), same, "left_semi")
            refused = rows.join(first, same, "left_anti")
        # rows that are all stored already need no run
        run = self._write(name, fresh.select(*columns, F.lit(batch).alias("batch")), count,
                          state["buckets"], 0, batch) if count else None
        try:
            self._commit(name, version, state, [run] if run else [], replaced)
        except CommitConflict:
            # a stream of the table's files must not see what does not count
            if run:
                delete_path(self.spark, self._run_path(name, run["run"]))
            raise
        self._merge(name)
        return refused.select(*columns)

    def _commit(self, name: str, version: int, state: dict, new: list[dict],
                old: list[dict]) -> None:
        """Put ``new`` runs in the place of ``old`` ones, whose files readers may still use."""
        gone = {r["run"] for r in old}
        due = [r for r in state["retired"] if r["since"] <= version - KEPT]
        self._log(name).publish(version + 1, {
            "buckets": state["buckets"],
            "runs": [r for r in state["runs"] if r["run"] not in gone] + new,
            "retired": [r for r in state["retired"] if r not in due]
            + [{"run": r, "since": version + 1} for r in sorted(gone)]})
        for r in due:
            delete_path(self.spark, self._run_path(name, r["run"]))

    def _merge(self, name: str) -> None:
        """Merge the runs of every level that has too many."""
        level = 0
        while True:
            version, state = self._state(name)
            runs = [r for r in state["runs"] if r["level"] == level]
            if not runs:
                if all(r["level"] < level for r in state["runs"]):
                    return
            elif len(runs) > self.max_runs:
                # the newest batch may still be written again
                old = runs[:-1] if level == 0 else runs
                count = sum(r["rows"] for r in old)
                new = self._write(name, self._read(name, old), count, state["buckets"],
                                  level + 1, None)
                self._commit(name, version, state, [new], old)
            level += 1


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(ID), F.lit(buckets)).cast("int")


def _either(tests: list[Column]) -> Column:
    """A balanced disjunction."""
    if len(tests) < 3:
        return reduce(lambda a, b: a | b, tests)
    half = len(tests) // 2
    return _either(tests[:half]) | _either(tests[half:])

