"""Assessment requests and overrides as streams.

Each micro-batch runs the batch job under a name made of the query's persistent id and
the batch id.  A replayed micro-batch overwrites its earlier attempt and does not see it,
which makes the sinks idempotent; another stream, or the same one with a new checkpoint, has
names of its own.

State is kept by key in RocksDB, below the checkpoint.  ``override_stream`` remembers which
assessments there are and which have an override, so it does not read their history again.
``assess_stream`` can drop requests that come again within a time; what comes later than that
is left to ``answer_late``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions.ids import packed_id, unpacked_id
from riskweave.operators.assess import ENVELOPE
from riskweave.operators.models import Scorer
from riskweave.operators.overrides import override_problem
from riskweave.plans.serving import Memory, assessment_batch, override_pieces
from riskweave.session import delete_path, stage_path
from riskweave.sources.store import FeedbackStore

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# files that a task of a partitioned write keeps open, instead of sorting its rows
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# shuffle files go when the job that made them ends, not when the driver collects its garbage
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Pieces that a micro-batch of overrides is dealt into by id; of small ones so many are decided
# together that they have about this number of requests.
PIECES = 32
PIECE_ROWS = 4_000_000


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch; Spark keeps the query's id in the checkpoint."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("A micro-batch without the id of its query cannot be named.")
    return f"stream-{query}-{batch_id}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _state_settings(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB."""
    return _setting(spark, _PROVIDER, _ROCKSDB)


def unique_requests(requests: DataFrame, within: str, time_col: str = "requested_at",
                    key: str = "request_id") -> DataFrame:
    """The first of the requests that share a ``key`` and lie less than ``within`` apart.

    A request whose time is more than ``within`` behind the newest of the micro-batches before
    it is late and dropped, since its key may have been forgotten.
    """
    timed = requests.withColumn("_event_time", F.col(time_col).cast("timestamp"))
    return timed.withWatermark("_event_time", within).dropDuplicatesWithinWatermark(
        [key]).drop("_event_time")


def assess_stream(requests: DataFrame, accounts: DataFrame, scorer: Scorer,
                  store: FeedbackStore, responses: str, checkpoint: str,
                  id_width: int = 32, envelope=ENVELOPE, created_at: Column | None = None,
                  trigger: dict | None = None, unique_within: str | None = None
                  ) -> StreamingQuery:
    """Answer a stream of requests against a stored account table.

    With ``unique_within`` (an interval such as ``10 minutes``) repeated requests are answered
    once, see ``unique_requests``; late ones wait for ``answer_late``.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        # read by validation, lookup and hot-key counting
        batch.persist()
        try:
            assessment_batch(batch, accounts, scorer, store, responses,
                             batch_name(batch, batch_id), id_width, envelope, created_at)
        finally:
            batch.unpersist()

    if unique_within is not None:
        requests = unique_requests(requests, unique_within)
    with _state_settings(requests.sparkSession):
        return (
            requests.writeStream.foreachBatch(answer)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )


def late_requests(requests: DataFrame, responses: str, key: str = "request_id") -> DataFrame:
    """Of the requests of a table that have no answer one per key: the earliest, and of those
    the one with the least columns in their order."""
    spark = requests.sparkSession
    answered = spark.read.parquet(responses).select(key)
    waiting = requests.join(answered, key, "left_anti")
    first = F.struct(F.col("requested_at").alias("_time"), *requests.columns)
    return waiting.groupBy(F.col(key).alias("_key")).agg(F.min(first).alias("_first")).select(
        *[F.col("_first")[c].alias(c) for c in requests.columns])


def answer_late(requests: DataFrame, accounts: DataFrame, scorer: Scorer,
                store: FeedbackStore, responses: str, batch: str, **options) -> DataFrame:
    """Answer the requests of a table (what the stream has read) that the stream has dropped as
    late; to be run when the stream has ended or stands still."""
    return assessment_batch(late_requests(requests, responses), accounts, scorer, store,
                            responses, batch, **options)


def with_memory(requests: DataFrame, assessments: DataFrame, overrides: DataFrame,
                id_width: int) -> DataFrame:
    """Two kinds of rows per micro-batch: the requests (column ``request``), and for every id
    that a row brings (column ``key``) since when it has been ``stored``, ``overridden`` and
    ``requested``; ``now`` is the time of the micro-batch.

    ``assessments`` and ``overrides`` are streams of what is recorded.  The times are a running
    aggregate by packed id, so a request that many rows repeat is one row per task.
    """
    now = F.current_timestamp()
    valid = override_problem(requests, id_width).isNull()
    seen = requests.select(
        F.when(valid, F.col("assessment_id")).alias("assessment_id"), F.lit(2).alias("kind"))
    for kind, rows in enumerate((assessments, overrides)):
        seen = seen.unionByName(rows.select("assessment_id", F.lit(kind).alias("kind")))
    seen = seen.where("assessment_id IS NOT NULL").withColumn("at", now)
    times = seen.groupBy(packed_id(F.col("assessment_id")).alias("packed")).agg(
        *[F.min(F.when(F.col("kind") == kind, F.col("at"))).alias(name)
          for kind, name in enumerate(("stored", "overridden", "requested"))])
    asked = requests.select(F.struct(*requests.columns).alias("request"))
    return asked.unionByName(
        times.withColumn("key", unpacked_id(F.col("packed"))).drop("packed")
        .withColumn("now", now), allowMissingColumns=True)


def in_pieces(batch: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The two kinds of rows of a micro-batch ``with_memory``, some ids at a time.

    The micro-batch is computed once, as a compressed table dealt by id; rows kept in a cache
    would take several times the room.  The files of a piece go when the next one is asked for.
    """
    spark = batch.sparkSession
    path = stage_path(spark, "micro-batch")
    named = F.coalesce("request.assessment_id", "key")
    dealt = batch.withColumns({
        "_piece": F.pmod(F.xxhash64(named), F.lit(PIECES)).cast("int"),
        "_asked": F.col("request").isNotNull().cast("int")})
    # at the limit a task sorts the rest
    with _setting(spark, _OPEN_FILES, str(PIECES + 1)):
        # small row groups, as a task has one in memory for every file
        dealt.write.partitionBy("_piece", "_asked").option("compression", "zstd").option(
            "parquet.block.size", 2 << 20).parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    groups: list[list[int]] = []    # first piece, last piece, requests
    for piece, count in sorted(
            rows.where("_asked = 1").groupBy("_piece").count().collect()) or [(0, 0)]:
        if groups and groups[-1][2] + count <= PIECE_ROWS:
            groups[-1] = [groups[-1][0], piece, groups[-1][2] + count]
        else:
            groups.append([piece, piece, count])
    for first, last, _ in groups:
        some = rows.where(F.col("_piece").between(first, last))
        yield (some.where("_asked = 1").select("request.*"),
               some.where("_asked = 0").drop("request", "_piece", "_asked"))
        for piece in range(first, last + 1):
            delete_path(spark, f"{path}/_piece={piece}")


def override_stream(requests: DataFrame, store: FeedbackStore, outcomes: str,
                    checkpoint: str, arrival: Sequence[str], id_width: int = 32,
                    created_at: Column | None = None, trigger: dict | None = None
                    ) -> StreamingQuery:
    """Decide a stream of overrides; micro-batches arrive in order, earlier ones win.

    When an assessment was stored, first requested and overridden is state.  It is fed by the
    files of both tables as they appear, so what other jobs record is known, too, and history
    is not read again.  Of an id that was stored before it was requested, the first request
    has been recorded.  Ids that the state does not know (not stored, or stored while a run of
    available data goes on) and those that were requested too early are looked up by key.
    One stream or batch job at a time may write the table.  A micro-batch is decided some ids at
    a time, and so are its rows shuffled; its outcomes appear as they are decided.
    """

    def remembered(told: DataFrame) -> Memory:
        wanted = told.where("requested IS NOT NULL")

        def ids(condition: str) -> DataFrame:
            return wanted.where(condition).select(F.col("key").alias("assessment_id"))

        known = "coalesce(stored, overridden) IS NOT NULL"
        early = "requested < coalesce(stored, overridden)"
        return Memory(
            stored=ids(known),
            overridden=ids(f"overridden IS NOT NULL OR NOT {early} AND requested < now"),
            unsure=ids(f"NOT {known} OR overridden IS NULL AND {early}"))

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession      # the query's own
        spark.conf.set(_TIDY, "true")
        pieces = ((asked, remembered(told)) for asked, told in in_pieces(batch))
        override_pieces(spark, pieces, store, outcomes, batch_name(batch, batch_id), arrival,
                        id_width, created_at)

    told = with_memory(requests, store.stream("assessments"), store.stream("overrides"),
                       id_width)
    with _state_settings(requests.sparkSession):
        return (
            told.writeStream.outputMode("update").foreachBatch(decide)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that the state operators of a query's recent micro-batches found too late."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for progress in query.recentProgress
               for op in json.loads(progress.json)["stateOperators"])
