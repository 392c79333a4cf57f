"""The prefix trie of rebuilt conversations, from fingerprints that compose.

A rebuilt conversation is a head of another conversation followed by a suffix of its own.  No
rebuilt text is ever made.  A turn stands for the affine map ``x -> z * x + t`` modulo a prime;
the product of a sequence's maps is its fingerprint, kept as (length, constant term), two lanes
of 61 bits.  Products of every original prefix are enough: a suffix is a prefix with a shorter
one taken off, and base head and own suffix are put together by one multiplication.

The original conversations are scanned once, range-partitioned by conversation and turn.  Each
task has the products of its own rows; what it lacks from the tasks before it is one product
per partition, so a conversation of any length is spread over many tasks.

Nodes are the distinct (depth, fingerprint) pairs.  A group is verified, not trusted: all its
members must end in the same turn and have the same parent, which by induction makes their
sequences equal; and each turn fingerprint must stand for one (role, text), which is read from
the stored turns.  If either fails the trie is built again with other multipliers.

Sums over a subtree need no walk.  The smallest member of a node owns it; what a conversation
owns is one run of its depths, from ``top`` on.  A subtree's sums are then sums over the node's
members, folded map-side.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import stage

PRIME = (1 << 61) - 1
LANES = (1, 2)
BASE_EVERY = 100
MAX_HEAD = 5
ATTEMPTS = 5
# Characters of a row's text that take part in dealing rows to tasks.
RANGE_CHARS = 64
# Characters of one piece of a list that is digested.
PIECE_CHARS = 1 << 16

SCAN = ("conv_id long, part int, pos long, t1 long, t2 long, before1 long, before2 long, "
        "after1 long, after2 long, chars long, total long")
KEY = ["depth", "f1", "f2"]


# ---- products -------------------------------------------------------------------

def times(a: Column, b: Column) -> Column:
    """``a * b`` modulo the prime; both are below it, so the product has 37 digits at most."""
    wide = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return F.pmod(wide, F.lit(PRIME).cast("decimal(19,0)")).cast("long")


def multipliers(seed: int) -> tuple[int, int]:
    draw = random.Random(seed)
    return draw.randrange(1 << 32, PRIME), draw.randrange(1 << 32, PRIME)


def stored_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str,
                 text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
                  for c in (role_col, text_col))
    return conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")


def turn_prints(turns: DataFrame, seed: int, bits: int) -> list[Column]:
    """Two lanes of a turn's fingerprint, from 1 to the prime less one."""
    return [(F.pmod(F.xxhash64(F.lit(2 * seed + lane), "role", "text"),
                    F.lit(min(1 << bits, PRIME - 1))) + 1).alias(f"t{lane}") for lane in LANES]


def scan_turns(turns: DataFrame, seed: int, bits: int) -> DataFrame:
    """``SCAN``: every turn with its place in its conversation and the products before and
    after it."""
    z = multipliers(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, pos, total, power, value = None, 0, 0, [1, 1], [0, 0]
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for c, t1, t2, chars in zip(*(column.to_pylist() for column in batch.columns)):
                if c != conv:
                    conv, pos, total, power, value = c, 0, 0, [1, 1], [0, 0]
                before = value
                power = [power[0] * z[0] % PRIME, power[1] * z[1] % PRIME]
                value = [(value[0] + t1 * power[0]) % PRIME, (value[1] + t2 * power[1]) % PRIME]
                pos, total = pos + 1, total + chars
                for column, v in zip(out, (pos, *before, *value, total)):
                    column.append(v)
            whole = {c: pa.array(v, pa.int64()) for c, v in zip(
                ("pos", "before1", "before2", "after1", "after2", "total"), out)}
            own = dict(zip(("conv_id", "t1", "t2", "chars"), batch.columns))
            columns = whole | own | {"part": pa.array([part] * batch.num_rows, pa.int32())}
            names = [c.split()[0] for c in SCAN.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    by_turn = F.col("turn").asc_nulls_first()
    ranged = turns.repartitionByRange(
        F.col("conv_id"), by_turn, F.col("role"), F.substring("text", 1, RANGE_CHARS))
    ordered = ranged.sortWithinPartitions(F.col("conv_id"), by_turn, "role", "text")
    rows = ordered.select("conv_id", *turn_prints(turns, seed, bits),
                          F.length("text").cast("long").alias("chars"))
    scanned = stage(rows.mapInArrow(run, SCAN), "scanned")
    return _carried(scanned, z)


def _carried(scanned: DataFrame, z: tuple[int, int]) -> DataFrame:
    """Adds to each row what the earlier partitions have of its conversation."""
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    # in more than one partition: at most one conversation per partition goes on in the next
    spread = (ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
              .groupBy("conv_id").count().where("count > 1").select("conv_id"))
    pieces = scanned.join(F.broadcast(spread), "conv_id").groupBy("conv_id", "part").agg(
        F.max("pos").alias("pos"), F.max("total").alias("total"),
        F.max_by("after1", "pos").alias("after1"), F.max_by("after2", "pos").alias("after2"))

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        """One row per partition that has some of the conversation."""
        rows, n, total, value = [], 0, 0, [0, 0]
        for r in group.sort_values("part").itertuples():
            power = [pow(m, n, PRIME) for m in z]
            rows.append((r.conv_id, r.part, n, total, *power, *value))
            value = [(v + p * int(a)) % PRIME
                     for v, p, a in zip(value, power, (r.after1, r.after2))]
            n, total = n + int(r.pos), total + int(r.total)
        return pd.DataFrame(rows, columns=["conv_id", "part", "n0", "total0", "m1", "m2",
                                           "v1", "v2"])

    carries = pieces.groupBy("conv_id").applyInPandas(
        carry, "conv_id long, part int, n0 long, total0 long, m1 long, m2 long, v1 long, v2 long")
    joined = scanned.join(F.broadcast(stage(carries, "carries")), ["conv_id", "part"], "left")

    def moved(name: str, lane: int) -> Column:
        shifted = F.pmod(F.col(f"v{lane}") + times(F.col(f"m{lane}"), F.col(f"{name}{lane}")),
                         F.lit(PRIME))
        return F.when(F.col("n0").isNull(), F.col(f"{name}{lane}")).otherwise(shifted).alias(
            f"{name}{lane}")

    return joined.select(
        "conv_id", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), "t1", "t2", "chars",
        *(moved(name, lane) for name in ("before", "after") for lane in LANES),
        (F.col("total") + F.coalesce("total0", F.lit(0))).alias("total"))


# ---- rebuilt conversations --------------------------------------------------------

def rebuilt(turns: DataFrame, z: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: a row per conversation (its head and what turns its own products into
    those of the rebuilt one), and a row per turn that is the head of some conversation."""
    head = F.struct("pos", "t1", "t2", "before1", "before2", "after1", "after2", "chars", "total")
    own = stage(turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("pos") <= MAX_HEAD, head))).alias("heads")),
        "own")
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"),
                      F.col("heads").alias("base_heads"))
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MAX_HEAD + 1))
    joined = own.select(
        "*", cut.alias("cut"),
        (F.col("conv_id") - F.col("conv_id") % BASE_EVERY).alias("base")
    ).join(base, "base", "left").withColumn(
        "head", F.least("cut", F.coalesce("base_n", F.lit(0))))

    def at(heads: str, place: str, field: str) -> Column:
        """A field of the state after ``place`` turns."""
        return F.coalesce(F.get(F.col(heads), F.col(place).cast("int") - 1)[field], F.lit(0))

    longer = F.greatest(F.col("n") - F.col("cut"), F.lit(0))
    back = {lane: F.array(*(F.lit(pow(z[lane - 1], -j, PRIME)) for j in range(MAX_HEAD + 1)))
            for lane in LANES}
    convs = stage(joined.select(
        "conv_id", "base", "cut", "head", (F.col("head") + longer).alias("depth"),
        *(at("base_heads", "head", f"after{lane}").alias(f"add{lane}") for lane in LANES),
        *(at("heads", "cut", f"after{lane}").alias(f"off{lane}") for lane in LANES),
        *(F.get(back[lane], (F.col("cut") - F.col("head")).cast("int")).alias(f"by{lane}")
          for lane in LANES),
        at("base_heads", "head", "total").alias("add_total"),
        at("heads", "cut", "total").alias("off_total"),
        (at("base_heads", "head", "total") + F.when(
            F.col("n") > F.col("cut"), F.col("total") - at("heads", "cut", "total")
        ).otherwise(0)).alias("total")), "convs")
    heads = own.select(F.col("conv_id").alias("base"), F.explode("heads").alias("h")).select(
        "base", F.col("h.pos").alias("depth"), F.col("h.after1").alias("f1"),
        F.col("h.after2").alias("f2"), F.col("h.before1").alias("p1"),
        F.col("h.before2").alias("p2"), "h.t1", "h.t2", "h.chars", "h.total")
    return convs, heads


def own_members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per own turn of a rebuilt conversation: its depth, node and parent, stored."""
    def moved(name: str, lane: int) -> Column:
        rest = F.pmod(F.col(f"{name}{lane}") - F.col(f"off{lane}"), F.lit(PRIME))
        rest = F.when(F.col("cut") == F.col("head"), rest).otherwise(
            times(F.col(f"by{lane}"), rest))
        return F.pmod(F.col(f"add{lane}") + rest, F.lit(PRIME))

    joined = turns.withColumnRenamed("total", "own_total").join(
        convs, "conv_id").where("pos > cut")
    depth = F.col("head") + F.col("pos") - F.col("cut")
    return stage(joined.select(
        "conv_id", depth.alias("depth"),
        *(moved("after", lane).alias(f"f{lane}") for lane in LANES),
        *(moved("before", lane).alias(f"p{lane}") for lane in LANES), "t1", "t2", "chars",
        (F.col("add_total") + F.col("own_total") - F.col("off_total")).alias("total"),
        (depth == F.col("depth")).alias("ends")), "members")


def build_nodes(convs: DataFrame, heads: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node, stored, with the least and largest of what its members must share."""
    shared = ["p1", "p2", "t1", "t2", "chars", "total"]
    inside = convs.where("head > 0").select(
        "base", "conv_id", F.explode(F.sequence(F.lit(1).cast("long"), "head")).alias("depth"))
    of_heads = heads.join(inside.groupBy("base", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), ["base", "depth"])
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where(
        "n > 0").select("conv_id", "n", *(zero.alias(c) for c in (*KEY, *shared)))
    every = members.select("conv_id", F.lit(1).cast("long").alias("n"), *KEY, *shared)
    every = every.unionByName(of_heads.select("conv_id", "n", *KEY, *shared)).unionByName(root)
    return stage(every.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        *(F.min(c).alias(c) for c in shared), *(F.max(c).alias(f"max_{c}") for c in shared)),
        "nodes")


def unequal(turns: DataFrame, nodes: DataFrame, seed: int, bits: int) -> bool:
    """Whether some fingerprint stands for more than one turn or prefix."""
    differ = " OR ".join(f"{c} <> max_{c}" for c in ("p1", "p2", "t1", "t2", "chars", "total"))
    if nodes.where(differ).limit(1).count():
        return True
    said = F.struct("role", "text")
    texts = turns.select(*turn_prints(turns, seed, bits), said.alias("said")).groupBy(
        "t1", "t2").agg(F.min("said").alias("least"), F.max("said").alias("most"))
    return bool(texts.where("least <> most").limit(1).count())


def list_digests(rows: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256``: the SHA-256 of the ids of each key, ascending and
    comma-joined.

    Ids are sorted by ranges of key and id and joined to long pieces, so the task that digests
    a key's list reads a row per piece.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        done: list[tuple] = []

        def batch():
            types = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(list(zip(*done)) or [()] * 5, types)],
                names=[*KEY, "first", "piece"])

        for part in batches:
            for *k, conv in zip(*(column.to_pylist() for column in part.columns)):
                if held and (k != key or size > PIECE_CHARS):
                    done.append((*key, first, ",".join(held)))
                    held, size = [], 0
                    if len(done) >= 4096:
                        yield batch()
                        done = []
                if not held:
                    key, first = k, conv
                held.append(str(conv))
                size += len(held[-1])
        if held:
            done.append((*key, first, ",".join(held)))
        yield batch()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def batch():
            types = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(list(zip(*done)) or [()] * 4, types)],
                names=[*KEY, "ends_sha256"])

        for part in batches:
            for *k, piece in zip(*(column.to_pylist() for column in part.columns)):
                if k != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(done) >= 4096:
                yield batch()
                done = []
        if state is not None:
            done.append((*key, state.hexdigest()))
        yield batch()

    order = [*KEY, "conv_id"]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(
        *order).mapInArrow(join, "depth long, f1 long, f2 long, first long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(
        *KEY, "piece").mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(convs: DataFrame, heads: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with their parents, children and sums over subtrees."""
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")
    ).agg(F.count("*").alias("n_children"))
    before = (F.col("total") - F.col("chars")).alias("before")
    nodes = stage(nodes.select(*KEY, "conv_id", "p1", "p2", "n_convs", before).join(
        children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
        "nodes")

    # what a conversation owns begins at depth top, after total_before characters
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.min("before").alias("total_before"),
        F.max(F.when(F.col("n_children") == 0, 1)).alias("leaf"))
    convs = stage(convs.join(owned, "conv_id", "left").select(
        "conv_id", "base", "head", "depth", F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.coalesce("top", F.col("depth") + 1).alias("top"),
        F.coalesce("total_before", "total").alias("total_before")), "convs")

    def sums(rows: DataFrame, *by: str) -> DataFrame:
        not_first = F.col("top") > F.col("depth")
        return rows.groupBy(*by).agg(
            F.sum("leaf").alias("n_leaves"), F.count_if(not_first).alias("n_later"),
            F.sum(F.when(not_first, F.col("total_before")).otherwise(0)).alias("later_total"))

    scalars = convs.select("conv_id", "leaf", "top", "total_before")
    inside = convs.select("base", "leaf", "top", "total_before", F.explode(
        F.sequence(F.lit(0).cast("long"), "head")).alias("depth"))
    zero = F.lit(0).cast("long")
    at_root = sums(inside.where("depth = 0"), "depth").select(
        "*", zero.alias("f1"), zero.alias("f2"))
    at_heads = sums(inside.where("depth > 0"), "base", "depth").join(
        heads.select("base", *KEY), ["base", "depth"])
    found = sums(members.select("conv_id", *KEY).join(scalars, "conv_id"), *KEY)
    columns = [*KEY, "n_leaves", "n_later", "later_total"]
    found = found.unionByName(at_heads.select(columns)).unionByName(at_root.select(columns))
    found = found.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in columns[3:]))

    head_ends = convs.where("head = depth AND head > 0").join(
        heads.select("base", *KEY), ["base", "depth"]).select("conv_id", *KEY)
    root_ends = convs.where("depth = 0").select(
        "conv_id", "depth", zero.alias("f1"), zero.alias("f2"))
    ends = members.where("ends").select("conv_id", *KEY).unionByName(
        head_ends).unionByName(root_ends)

    # only the first node that a conversation owns has another owner's node above it
    first = nodes.join(owned.select("conv_id", "top"), "conv_id").where("depth = top")
    above = nodes.where("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
        F.col("conv_id").alias("parent"))
    linked = first.where("depth > 1").select(*KEY, "p1", "p2").join(
        above, ["depth", "p1", "p2"]).select(*KEY, "parent")
    root = F.lit(convs.agg(F.min("conv_id")).first()[0]).cast("long")
    every = nodes.join(found, KEY).join(linked, KEY, "left").join(list_digests(ends), KEY, "left")
    parent = F.coalesce("parent", F.when(F.col("depth") == 1, root), "conv_id")
    return every.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves",
        (F.col("later_total") - F.col("n_later") * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", seed: int = 13,
                bits: int = 61) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversation c is rebuilt from the first h turns of conversation c - c % 100 (fewer if it
    has fewer, none if it is absent) and its own turns after its first h, where h is the CRC-32
    of c in decimal, modulo 6.  A node is a distinct sequence of the first d rebuilt turns.

    Turns are ordered by turn (null first), then role and text; equal rows are turns of their
    own.  A null role or text is empty; empty and very long texts are texts like any other.
    Rows without a conversation id cannot be rebuilt and are left out.  Other columns are
    ignored.  An empty table gives no node.

    ``seed`` chooses the fingerprints; ``bits`` narrows those of turns, so that tests meet
    collisions, which are found and end in another attempt.
    """
    turns = stored_turns(conversations, conv_col, turn_col, role_col, text_col)
    for attempt in range(ATTEMPTS):
        # a narrow fingerprint is widened where it was not enough
        drawn, width = seed + attempt, 61 if attempt else bits
        scanned = scan_turns(turns, drawn, width)
        convs, heads = rebuilt(scanned, multipliers(drawn))
        members = own_members(scanned, convs)
        nodes = build_nodes(convs, heads, members)
        if not unequal(turns, nodes, drawn, width):
            return trie(convs, heads, members, nodes)
    raise RuntimeError(f"Fingerprints collided {ATTEMPTS} times")
