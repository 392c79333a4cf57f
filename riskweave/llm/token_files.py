"""Token ids as flat binary files with 64-bit document offsets, and reading them back.

Format, below one folder: per shard ``ids`` (unsigned 16- or 32-bit, little-endian, nothing
else), ``offsets`` (n + 1 signed 64-bit: position of each document in the whole corpus, and the
end of the last) and ``docs`` (n signed 64-bit document ids).  ``index.json`` lists the shards
in order with their bases; it is written last, so a folder without it is unfinished.

Documents are range-partitioned by id.  Each task writes its shard under a name of its own
attempt, so a retried or speculative task disturbs nothing; the files of attempts that did not
count are deleted at the end.  A shard's base is the prefix sum of the shard sizes before it,
and a second, small job turns document lengths into global offsets.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import id_and_bytes, regroup

BLOCK_BYTES = 4 << 20
# Text of one shard, and so of one task.
SHARD_BYTES = 64 << 20
# Spans and words that a task remembers, and the longest it does.  An encoder that outlives its
# task remembers fewer.
MAX_KNOWN = 1_000_000
KEPT_KNOWN = 800_000
LONGEST_KNOWN = 64
# A single space between other characters begins a new pre-token in byte-level BPE, so the ids
# of the spans between such borders are the ids of the text.
_UNSAFE = re.compile(r" (?:(?=\s)|(?<=\s ))")
_BORDER = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the pre-token pattern of byte-level BPE, for spans of the characters below;
# other spans are left to the library.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORDS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_SETTLED = re.compile(f"[\t\n\r\x20-\x7e{_LETTERS}]*")
_MARKS = frozenset(".,;:!?")
_PLAIN = re.compile(f"[{_LETTERS}]+[.,;:!?]?").fullmatch


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, as the shared folder names it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def spans(text: str) -> list[str]:
    """The text cut at safe borders, without the space at each border."""
    unsafe = text[:1] == " " or text[-1:] == " " or _UNSAFE.search(text)
    return _BORDER.split(text) if unsafe else text.split(" ")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself,
    if it is printable and no space, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """Ids of texts, after ``lead``; what is missing is encoded on the way.

    With ``word``, which encodes one pre-token, spans of letters and at most a mark after them
    are not searched for pre-tokens."""

    def __init__(self, encode: Callable[[str], bytes], most: int, lead: str = "",
                 word: Callable[[str], bytes] | None = None):
        super().__init__()
        self.encode, self.most, self.word, self.lead = encode, most, word, lead

    def __missing__(self, text: str) -> bytes:
        if self.word is None or not _PLAIN(text):
            out = self.encode(self.lead + text)
        elif text[-1] in _MARKS:
            out = self[text[:-1]] + self.encode(text[-1])
        else:
            out = self.word(self.lead + text)
        if len(text) <= LONGEST_KNOWN:
            if len(self) >= self.most:
                self.clear()
            self[text] = out
        return out


class SpanEncoder:
    """Ids of texts by the tokenizers library, whose model sees each distinct word once.

    The library alone splits and encodes about 1.5 MB of text a second here, most of it words
    that it has met before.
    """

    def __init__(self, tokenizer_json: str, dtype: np.dtype, end_id: int,
                 max_known: int = MAX_KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", ())]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.characters, self.dtype = byte_characters(), dtype
        self.code = "H" if dtype.itemsize == 2 else "I"
        # how letters, marks and the space are spelt in the vocabulary
        self.spelt = {c: "".join(self.characters[b] for b in chr(c).encode())
                      for c in range(0x250) if c == 32 or c > 126}
        word = None if any(t[:1].isalpha() for t in added) else self.plain_ids
        self.first = _Remembered(self.span_ids, max_known, "", word)
        self.rest = _Remembered(self.span_ids, max_known, " ", word)
        self.words = _Remembered(self.word_ids, max_known)
        self.end = self.packed([end_id])

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def span_ids(self, span: str) -> bytes:
        plain = span.isascii() and span.isprintable() or _SETTLED.fullmatch(span)
        if not plain or self.added.search(span):
            return self.packed(self.tokenizer.encode(span, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, _WORDS.findall(span)))

    def plain_ids(self, word: str) -> bytes:
        """Ids of a pre-token of letters, perhaps after a space."""
        return array(self.code, [t.id for t in self.model.tokenize(
            word.translate(self.spelt))]).tobytes()

    def word_ids(self, word: str) -> bytes:
        spelt = word.encode().decode("latin-1").translate(self.characters)
        return self.packed([t.id for t in self.model.tokenize(spelt)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, the end id last."""
        out = []
        for text in texts:
            parts = spans(text)
            first = self.first[parts[0]]
            out.append(first + b"".join(map(self.rest.__getitem__, parts[1:])) + self.end)
        return out


def kept_encoder(tokenizer_json: str, dtype: np.dtype, end_id: int) -> SpanEncoder:
    """The encoder that this Python worker has used last, if it is such a one, else a new one.

    Spark gives a worker one task after another; the words that it remembers are bounded by
    ``KEPT_KNOWN``, whatever the number of tasks."""
    place = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    key = (hash(tokenizer_json), str(dtype), end_id)
    if getattr(place, "key", None) != key:
        place.key, place.encoder = key, SpanEncoder(tokenizer_json, dtype, end_id, KEPT_KNOWN)
    return place.encoder


def byte_level(tokenizer_json: str) -> bool:
    """Whether spans may be encoded one by one: byte-level pre-tokens and no normaliser."""
    rules = json.loads(tokenizer_json)
    pre = rules.get("pre_tokenizer") or {}
    return (rules.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in rules.get("added_tokens", ())))


def id_type(tokenizer_json: str, end_id: int) -> str:
    """Little-endian unsigned numbers as wide as the largest id needs."""
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1, end_id)
    return "<u2" if largest < 1 << 16 else "<u4"


SHARD_SCHEMA = "part int, name string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text",
                      shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode every text, append ``end_id``, write the files in ascending order of the id;
    returns the index.

    A null text is empty and has the end id alone.  Null ids come first and are stored as the
    smallest 64-bit number.  Documents that share an id are ordered by the XXH64 of their text.
    An empty table gives an index without shards.  Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        rules = file.read()
    if not byte_level(rules):
        raise ValueError("Only byte-level tokenizers without a normalizer are supported")
    dtype = id_type(rules, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(path)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
        encoder, n_docs, n_tokens = None, 0, 0
        system.create_dir(root, recursive=True)
        width = np.dtype(dtype).itemsize
        # words and ids make no cycles; a collector would walk all of them again and again
        gc.disable()
        try:
            with (system.open_output_stream(f"{root}/{name}.ids") as ids_file,
                  system.open_output_stream(f"{root}/{name}.lengths") as lengths_file,
                  system.open_output_stream(f"{root}/{name}.docs") as docs_file):
                for table in regroup(batches, BLOCK_BYTES):
                    encoder = encoder or SpanEncoder(rules, np.dtype(dtype), end_id)
                    packed = encoder.encode(
                        [b.decode() for b in table.column("body").to_pylist()])
                    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
                    ids_file.write(b"".join(packed))
                    lengths_file.write(sizes.astype("<i8").tobytes())
                    docs_file.write(table.column("doc_id").to_numpy().astype("<i8").tobytes())
                    n_docs, n_tokens = n_docs + len(packed), n_tokens + int(sizes.sum())
        finally:
            gc.enable()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "name": [name],
            "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    smallest = F.lit(-(1 << 63)).cast("long")
    rows = id_and_bytes(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), smallest).alias("doc_id"),
        F.xxhash64("body").alias("text_key"), "body")
    keys = ["doc_id", "text_key"]
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    ranged = rows.repartitionByRange(-(-size // shard_bytes) or 1, *keys)
    written = ranged.sortWithinPartitions(*keys).mapInArrow(write, SHARD_SCHEMA).collect()
    # one row per task; the bases are their prefix sums
    parts = sorted((r for r in written if r["n_docs"]), key=lambda r: r["part"])
    bases = np.concatenate(([0], np.cumsum([r["n_tokens"] for r in parts], dtype=np.int64)))
    index = {"dtype": dtype, "end_id": end_id, "n_tokens": int(bases[-1]), "shards": [
        {"name": r["name"], "base": int(b), "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]}
        for r, b in zip(parts, bases)]}
    _write_offsets(docs.sparkSession, path, index)
    system, root = open_folder(path)
    known = {s["name"] for s in index["shards"]}
    for file in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if file.base_name.partition(".")[0] not in known or file.extension == "lengths":
            system.delete_file(file.path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/index.json") as file:
        file.write(json.dumps(index).encode())
    return index


def _shard_rows(spark: SparkSession, index: dict) -> DataFrame:
    rows = [(s["name"], s["base"]) for s in index["shards"]]
    return spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))


def _write_offsets(spark: SparkSession, path: str, index: dict) -> None:
    """Global 64-bit offsets of each shard: its base and the running sum of its lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(path)
        for batch in batches:
            for name, base in zip(batch["name"].to_pylist(), batch["base"].to_pylist()):
                with system.open_input_file(f"{root}/{name}.lengths") as file:
                    lengths = np.frombuffer(file.read(), "<i8")
                offsets = np.concatenate(([base], base + np.cumsum(lengths))).astype("<i8")
                spare = f"{root}/{name}.offsets-{uuid.uuid4().hex[:12]}"
                with system.open_output_stream(spare) as file:
                    file.write(offsets.tobytes())
                system.move(spare, f"{root}/{name}.offsets")
            yield batch.select(["name"])

    if index["shards"]:
        _shard_rows(spark, index).mapInArrow(run, "name string").count()


def read_index(path: str) -> dict:
    system, root = open_folder(path)
    with system.open_input_file(f"{root}/index.json") as file:
        return json.loads(file.read())


def mapped(system: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is a local path, else read."""
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids before the document, ``n_tokens`` its own with the end id;
    ``ids_crc32`` is the unsigned CRC-32 of them as little-endian unsigned 32-bit integers.
    """
    index = read_index(path)
    dtype = index["dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(path)
        for batch in batches:
            for name, base in zip(batch["name"].to_pylist(), batch["base"].to_pylist()):
                ids = mapped(system, f"{root}/{name}.ids", dtype)
                offsets = mapped(system, f"{root}/{name}.offsets", "<i8")
                docs = mapped(system, f"{root}/{name}.docs", "<i8")
                for at in range(0, len(docs), 8192):
                    bounds = np.asarray(offsets[at:at + 8193])
                    local = (bounds - base).tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                            for a, b in zip(local, local[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.asarray(docs[at:at + 8192])), pa.array(bounds[:-1].copy()),
                        pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _shard_rows(spark, index).mapInArrow(run, schema)
