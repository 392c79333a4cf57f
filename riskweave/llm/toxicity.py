"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: word beginnings that labelled toxic texts hold far more often than
clean ones, by a likelihood-ratio test.  A text then becomes sixteen numbers (lexicon
densities, hits near a second-person word, capitals, punctuation, disguised spellings), on
which MLlib's boosted trees are fitted; isotonic regression on rows the trees have not seen
turns their probability into a score.

Only the labelled sample (``MAX_LABELLED`` rows) is used for fitting.  All texts are scored
whole, in place, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import free_name
from riskweave.session import stage

# Labelled rows that are used for fitting at most; beyond it, a sample by hash of the id.
MAX_LABELLED = 20_000
# Entries of the learned lexicon at most, the most significant first.
MAX_LEXICON = 5_000
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 4
ROUNDS, DEPTH, RATE = 20, 3, 0.2
FIT_PARTITIONS = 8
SHORTEST, LONGEST = 3, 12
NEAR_WORDS = 5
REJECT_AT = 0.5

# Second-person words of the languages served, and common letter swaps.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "deiner deinen ihr euch euer usted ustedes vosotros ti tus tuyo tú".split()
)
SWAPS = str.maketrans("013457@$!|+", "oieastasiit")

FEATURES = (
    "log_words", "hits", "hit_density", "weight_density", "top_weight", "distinct_hits",
    "hits_near_second_person", "second_person_density", "capitals", "shouted_words",
    "punctuation", "exclamations", "symbols", "disguised_words", "disguised_hits", "stretched",
)
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = b"#$%&*+<=>@\\^_`{|}~"
_PIECE = 1 << 20


def pieces(text: str) -> Iterator[str]:
    """The text in parts of bounded size, cut at spaces where there are any."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + _PIECE) if len(text) - at > _PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def plain_word(token: str) -> tuple[str, bool]:
    """Letters of a token in lower case, swaps undone, and whether it was disguised: digits or
    signs between its letters."""
    core = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
    if core.isalpha() or not core:
        return core, False
    word = "".join(c for c in core.translate(SWAPS) if c.isalpha())
    return word, any(c.isalpha() for c in core)


def beginnings(word: str) -> list[str]:
    """Beginnings of a word, and ``word|`` for the whole of it."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f"{word}|"]


# ---- lexicon ------------------------------------------------------------------

def learn_lexicon(sample: DataFrame, max_entries: int = MAX_LEXICON) -> dict[str, float]:
    """Log-odds of word beginnings that mark toxic rows of ``sample`` (``text, label``).

    Counts are of documents.  An entry needs a likelihood ratio above ``2 ln m`` for ``m``
    beginnings in toxic texts, so that chance finds are rare whatever the sample's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush():
            names = list(toxic.keys() | clean.keys())
            rows = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()),
                 pa.array([clean[w] for w in names], pa.int64())],
                names=["entry", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return rows

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(),
                                   batch.column("label").to_pylist()):
                found = set()
                for piece in pieces(text):
                    for token in set(piece.split()):
                        found.update(beginnings(plain_word(token)[0]))
                (toxic if label else clean).update(found)
                if len(toxic) + len(clean) > 500_000:
                    yield flush()
        yield flush()

    totals = sample.groupBy("label").count().collect()
    rows = {r["label"]: r["count"] for r in totals}
    t_all, c_all = rows.get(1, 0), rows.get(0, 0)
    if not t_all or not c_all:
        return {}
    counts = stage(
        sample.select("text", "label").mapInArrow(run, "entry string, toxic long, clean long")
        .groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t > 0"),
        "lexicon")
    tested = max(counts.count(), 2)
    n, base = F.col("t") + F.col("c"), t_all / (t_all + c_all)

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("t"), n * base) + part(F.col("c"), n * (1 - base)))
    weight = F.log((F.col("t") + 0.5) / (t_all + 1)) - F.log((F.col("c") + 0.5) / (c_all + 1))
    best = (
        counts.withColumn("ratio", ratio).withColumn("weight", weight)
        .where((F.col("ratio") > 2 * math.log(tested)) & (F.col("weight") > 1.0))
        .orderBy(F.desc("ratio"), "entry").limit(max_entries)
    )
    return {r["entry"]: r["weight"] for r in best.collect()}


# ---- features -----------------------------------------------------------------

def feature_maker(lexicon: dict[str, float]) -> Callable[[str], list[float]]:
    """Function from a text to its ``FEATURES``.  It remembers the words it has met."""
    known: dict[str, tuple | None] = {}
    longest = max((len(e) for e in lexicon), default=0)

    def study(token: str) -> tuple | None:
        """(weight, entry, second person, shouted, disguised, stretched); None: nothing."""
        word, disguised = plain_word(token)
        weight, entry = 0.0, None
        for e in beginnings(word) if longest else ():
            w = lexicon.get(e)
            if w is not None and w > weight:
                weight, entry = w, e
        shouted = len(word) > 2 and token.isupper()
        stretched = any(a == b == c for a, b, c in zip(word, word[1:], word[2:]))
        second = word in SECOND_PERSON
        if len(known) > 200_000:
            known.clear()
        out = (weight, entry, second, shouted, disguised, stretched)
        out = out if entry or second or shouted or disguised or stretched else None
        known[token] = out
        return out

    def features(text: str) -> list[float]:
        words = hits = second = shouted = disguised = disguised_hits = stretched = 0
        total = top = 0.0
        entries, hit_at, second_at = set(), [], []
        for piece in pieces(text):
            tokens = piece.split()
            at_hand = {}
            for token, n in Counter(tokens).items():
                try:
                    about = known[token]
                except KeyError:
                    about = study(token)
                if about is None:
                    continue
                weight, entry, is_second, is_shouted, is_disguised, is_stretched = about
                if entry:
                    hits += n
                    total += n * weight
                    top = max(top, weight)
                    entries.add(entry)
                    disguised_hits += n * is_disguised
                    at_hand[token] = hit_at
                if is_second:
                    second += n
                    at_hand[token] = second_at
                shouted += n * is_shouted
                disguised += n * is_disguised
                stretched += n * is_stretched
            if hits and second and at_hand:
                for i, token in enumerate(tokens, words):
                    if token in at_hand:
                        at_hand[token].append(i)
            words += len(tokens)
        near = 0
        if hit_at and second_at:
            a, b = np.array(hit_at), np.array(second_at)
            spot = np.searchsorted(b, a)
            gap = np.minimum(np.abs(b[np.minimum(spot, len(b) - 1)] - a),
                             np.abs(a - b[np.maximum(spot - 1, 0)]))
            near = int((gap <= NEAR_WORDS).sum())
        body = text.encode()
        size = max(len(body), 1)
        count = lambda chars: len(body) - len(body.translate(None, chars))
        n = max(words, 1)
        return [
            math.log1p(words), float(hits), hits / n, total / n, top, float(len(entries)),
            near / n, second / n, count(_UPPER) / max(count(_LETTERS), 1), shouted / n,
            count(_PUNCTUATION) / size, (body.count(b"!") + body.count(b"?")) / size,
            count(_SYMBOLS) / size, disguised / n, disguised_hits / n, stretched / n,
        ]

    return features


def features_column(text: Column, lexicon: dict[str, float]) -> Column:
    """ARRAY<DOUBLE> of ``FEATURES``; a null text counts as empty.

    The lexicon has ``MAX_LEXICON`` entries at most and travels with the function.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = feature_maker(lexicon)
        for texts in batches:
            yield pd.Series([make(t) for t in texts])

    return run(F.coalesce(text, F.lit("")))


# ---- model --------------------------------------------------------------------

@dataclass
class ToxicityModel:
    """Learned parts; without both classes among the labels, only ``base_rate``."""

    lexicon: dict[str, float]
    base_rate: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with the column ``name``, 0 to 1; no row moves."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.base_rate))
        taken = [*docs.columns, name]
        names = []
        for part in ("_features", "_raw", "_probability", "_prediction", "_toxic", "_calibrated"):
            names.append(free_name([*taken, *names], part))
        array, raw, probability, prediction, toxic, calibrated = names
        trees = self.trees.copy()
        trees.setFeaturesCol(array).setRawPredictionCol(raw).setProbabilityCol(probability)
        trees.setPredictionCol(prediction)
        curve = self.calibration.copy().setFeaturesCol(toxic).setPredictionCol(calibrated)
        rows = docs.withColumn(
            array, array_to_vector(features_column(F.col(f"`{text_col}`"), self.lexicon)))
        rows = trees.transform(rows).withColumn(toxic, vector_to_array(probability)[1])
        rows = curve.transform(rows)
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(calibrated)))
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns], bounded.alias(name))


def fold(id_column: Column) -> Column:
    """``crc32`` of the id as text, modulo ``FOLDS``; fold ``HELD_OUT`` is never learned from."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    label_col: str, label_id_col: str, max_rows: int) -> DataFrame:
    """``id, text, label, fold`` of labelled rows that may be learned from, stored: one row per
    labelled id that ``docs`` has, ``max_rows`` at most.  Of several texts of an id the one with
    the smallest XXH64 is taken, so every label counts once."""
    ids = (
        labels.select(F.col(f"`{label_id_col}`").alias("_id"),
                      F.col(f"`{label_col}`").cast("int").alias("label"))
        .where("_id IS NOT NULL AND label IN (0, 1)")
        .withColumn("fold", fold(F.col("_id"))).where(F.col("fold") != HELD_OUT)
        .groupBy("_id", "fold").agg(F.max("label").alias("label"))
    )
    ids = stage(ids, "labels")
    if ids.count() > max_rows:  # the smallest hashes of the ids that have a text
        present = docs.select(F.col(f"`{id_col}`").alias("_doc")).distinct()
        ids = ids.join(present, F.col("_id") == F.col("_doc"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    text = docs.select(F.col(f"`{id_col}`").alias("_doc"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # at most max_rows ids are broadcast, so the texts stay where they are; each task folds the
    # rows of an id before they move
    joined = text.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    best = joined.groupBy("_id", "label", "fold").agg(
        F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("best"))
    return stage(best.select(F.col("_id").alias("id"), F.col("best.text").alias("text"), "label",
                             "fold").repartition(32), "labelled")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", label_id_col: str = "doc_id",
          max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> ToxicityModel:
    """Fit lexicon, trees and calibration on the labelled rows outside the held-out fold.

    Folds 1 to 4 give the lexicon, folds 1 to 3 the trees, fold 4 the calibration (all of
    them where a fold lacks a class).  Rows with a null id or a label other than 0 or 1 are
    not learned from; of several labels of one id the higher counts, of several texts one.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, label_id_col,
                             max_labelled)
    lexicon = learn_lexicon(sample)
    rows = stage(
        sample.select("id", features_column(F.col("text"), lexicon).alias("values"),
                      F.col("label").cast("double").alias("label"), "fold"), "features")
    # the same rows in the same places whatever the tasks before did, so the same trees
    rows = rows.repartition(FIT_PARTITIONS, "id").sortWithinPartitions("id", "values").select(
        array_to_vector("values").alias("features"), "label", "fold")
    seen = {(r["fold"] == CALIBRATION, r["label"]): r["n"] for r in
            rows.groupBy("fold", "label").agg(F.count("*").alias("n"))
            .groupBy((F.col("fold") == CALIBRATION).alias("c"), "label")
            .agg(F.sum("n").alias("n")).select(
                F.when(F.col("c"), CALIBRATION).otherwise(1).alias("fold"), "label", "n")
            .collect()}
    toxic = sum(n for (_, label), n in seen.items() if label == 1)
    total = sum(seen.values())
    base = toxic / total if total else 0.0
    if toxic in (0, total):
        return ToxicityModel(lexicon, float(base))
    apart = all(seen.get((c, y), 0) for c in (False, True) for y in (0.0, 1.0))
    fitted = rows.where(F.col("fold") != CALIBRATION) if apart else rows
    kept = rows.where(F.col("fold") == CALIBRATION) if apart else rows
    trees = GBTClassifier(maxIter=rounds, maxDepth=DEPTH, stepSize=RATE, seed=7,
                          maxBins=64).fit(fitted)
    judged = trees.transform(kept).select(
        vector_to_array("probability")[1].alias("features"), "label")
    calibration = IsotonicRegression(isotonic=True).fit(judged)
    return ToxicityModel(lexicon, float(base), trees, calibration)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    A null text is scored as the empty text.  Without labels of both classes every score is
    the share of toxic labels (0 without any).  Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return model.score(rows).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", reject_at: float = REJECT_AT, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``reject_at``, all columns as they were."""
    model = train(docs, labels, id_col, text_col, **options)
    name = free_name(docs.columns, "_score")
    scored = model.score(docs, text_col, name)
    return scored.where(F.col(name) < reject_at).select(*[F.col(f"`{c}`") for c in docs.columns])
