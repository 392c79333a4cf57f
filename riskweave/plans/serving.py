"""Assessment and override batches against the store; streams run the same batches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.ids import is_assessment_id
from riskweave.operators.assess import ENVELOPE, assess, to_record
from riskweave.operators.models import Scorer
from riskweave.operators.overrides import (
    accepted_overrides, decide_overrides, refuse_overrides,
)
from riskweave.session import scratch
from riskweave.sources.store import FeedbackStore


def assessment_batch(requests: DataFrame, accounts: DataFrame | None, scorer: Scorer | None,
                     store: FeedbackStore, responses: str, batch: str, id_width: int = 32,
                     envelope=ENVELOPE, created_at: Column | None = None) -> DataFrame:
    """Answer a batch, write the answers, record the scored ones.

    The answers are written first and read back, so recording does not score again.
    Writing the same batch again replaces it.  A store that is not there turns scores
    into errors: nothing is answered that could not be recorded.
    """
    spark = requests.sparkSession
    path = f"{responses.rstrip('/')}/batch={batch}"
    ready = store.ready
    with scratch(spark):
        answers = assess(requests, accounts, scorer, id_width, envelope, store_ready=ready)
        answers.write.mode("overwrite").parquet(path)
        answered = spark.read.parquet(path)
        if ready and scorer is not None and accounts is not None:
            store.append_assessments(to_record(answered, scorer.model_id, created_at), batch)
    return answered


@dataclass(frozen=True)
class Memory:
    """What is known of the assessments that a batch of overrides names: tables of ids."""

    stored: DataFrame
    overridden: DataFrame
    unsure: DataFrame    # ids that the store has to be asked for


def override_batch(requests: DataFrame, store: FeedbackStore, outcomes: str, batch: str,
                   arrival: Sequence[str], id_width: int = 32,
                   created_at: Column | None = None) -> DataFrame:
    """Decide a batch of overrides, write the outcomes, record the accepted ones.

    The store is asked for the ids that the requests name.
    """
    return override_pieces(requests.sparkSession, [(requests, None)], store, outcomes, batch,
                           arrival, id_width, created_at, look_back=True)


def override_pieces(spark: SparkSession, pieces: Iterable[tuple[DataFrame, Memory | None]],
                    store: FeedbackStore, outcomes: str, batch: str, arrival: Sequence[str],
                    id_width: int = 32, created_at: Column | None = None,
                    look_back: bool = False) -> DataFrame:
    """``override_batch`` for a batch in pieces, one or more, of which each has all requests of
    its ids.

    Pieces are decided one after the other and what one has staged goes before the next; their
    accepted overrides are recorded together, at the end.  The store is asked for the ids that a
    piece's memory is not sure of.  Without ``look_back`` the memories vouch for all others.
    """
    path = f"{outcomes.rstrip('/')}/batch={batch}"
    ready = store.ready
    with scratch(spark):
        for number, (requests, memory) in enumerate(pieces):
            with scratch(spark):
                decided = (
                    _decided(requests, memory, store, batch, arrival, id_width) if ready
                    else refuse_overrides(requests, id_width))
                decided.write.mode("append" if number else "overwrite").parquet(path)
        written = spark.read.parquet(path)
        if ready:
            store.append_overrides(accepted_overrides(written, created_at), batch, look_back)
    return written


def _decided(requests: DataFrame, memory: Memory | None, store: FeedbackStore, batch: str,
             arrival: Sequence[str], id_width: int) -> DataFrame:
    if memory is None:
        named = requests.select("assessment_id")
        wanted = named.where(is_assessment_id(F.col("assessment_id"), id_width))
    else:
        wanted = memory.unsure
    known = store.around("assessments", wanted).select("assessment_id")
    taken = store.around("overrides", wanted, batch).select("assessment_id")
    if memory is not None:
        known = known.union(memory.stored)
        taken = taken.union(memory.overridden)
    return decide_overrides(requests, known, taken, arrival, id_width)


def request_time() -> Column:
    """Use the request's own time instead of the clock (reproducible replays)."""
    return F.col("requested_at")
