"""SentencePiece encoding and decoding by a forward pass that words share.

A text is cut into marked words (``▁word``; a run of marks stays with the word after it), and
these between letters and signs that no piece joins.  The distinct parts of a block of documents are sorted, which lists a trie depth first; the forward
state of every prefix stays on a stack, so words with a common beginning work it out once.

* Unigram models: the state is the best score of the prefix and where its last piece begins
  (Viterbi).
* BPE models: merges do not maximise a sum of scores, so Viterbi would return other ids than
  the model means.  Their state is where the last piece of the prefix's own encoding begins.
  It is extended by the one piece that merges would leave standing beside the piece before it;
  that is known from the two pieces alone, so the pass is as local and as shareable.

BPE ids are those that the sentencepiece library gives for the model file.  Unigram ids have the
best sum of scores; where the library's 32-bit sums over a whole text round two segmentations
to one score, it may return the other.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_and_bytes, regroup

MARK = "▁"
UNIGRAM, BPE = 1, 2
# Fixed values of the library: how much worse than the worst piece an unknown character is,
# and how an unknown id reads.
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "
BLOCK_BYTES = 8 << 20
# Words and pairs of pieces that a task remembers.
MAX_WORDS = 400_000
# Words that are learned at a time.
MAX_FRESH = 100_000
_WORDS_AT_HAND = 200_000
MAX_PAIRS = 1_000_000


@dataclass
class PieceModel:
    """What encoding and decoding need of a model file."""

    kind: int
    score: dict[str, float]
    id_of: dict[str, int]
    byte_ids: tuple[int, ...]
    unknown_id: int
    dummy_prefix: bool
    texts: list[bytes | None]

    def __post_init__(self):
        joined: set[str] = set()
        for piece in self.score:
            joined.update(map("".join, zip(piece, piece[1:])))
        # no piece goes on into the next marked word
        self.separable = not any(j[1] == MARK != j[0] for j in joined)
        # characters that no piece has beside a letter or a mark: parts end there
        single = [c for c in self.score if len(c) == 1]
        letters = {c for c in single if c.isalpha() or c == MARK}
        signs = {c for c in [*single, "\n", "\t"] if not c.isalnum() and c != MARK}
        signs -= {j[0] for j in joined if j[1] in letters} | {
            j[1] for j in joined if j[0] in letters}
        one, other = ("[" + "".join(map(re.escape, sorted(x))) + "]" for x in (letters, signs))
        self.border = re.compile(
            f"(?<={one})(?={other})|(?<={other})(?={one})" if letters and signs else "(?!)")


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver; its vocabulary travels with the tasks."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        return parse_model(file.read(), proto)


def parse_model(data: bytes, proto) -> PieceModel:
    model = proto.ModelProto()
    model.ParseFromString(data)
    kinds = proto.ModelProto.SentencePiece
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("Only models that leave the text as it is are supported")
    if model.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces:
        raise ValueError("Words must be marked at their beginning")
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("Only unigram and BPE models are supported")
    score, id_of, bytes_, texts, unknown = {}, {}, {}, [], 0
    for i, piece in enumerate(model.pieces):
        text = b""
        if piece.type == kinds.NORMAL:
            score[piece.piece], id_of[piece.piece] = piece.score, i
            text = piece.piece.replace(MARK, " ").encode()
        elif piece.type == kinds.BYTE:
            bytes_[int(piece.piece[3:5], 16)] = i
            text = None
        elif piece.type == kinds.UNKNOWN:
            unknown, text = i, UNKNOWN_TEXT.encode()
        elif piece.type != kinds.CONTROL:
            raise ValueError(f"Pieces like {piece.piece!r} are not supported")
        texts.append(text)
    return PieceModel(
        model.trainer_spec.model_type, score, id_of,
        tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else (), unknown,
        rules.add_dummy_prefix, texts,
    )


# ---- encoding -----------------------------------------------------------------

class WordEncoder:
    """Ids of marked words; shares the forward pass among sorted words.

    An automaton over the pieces says, character by character, which pieces end there; it is
    made as far as words need it.  The stacks hold, per prefix of the word in hand, the
    automaton's state, the last piece and where it begins; for unigram models, the best score.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.worst = min(model.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.unigram = model.kind == UNIGRAM
        # beginnings of pieces are the states
        self.beginnings = {p[:n] for p in model.score for n in range(1, len(p) + 1)}
        self.names, self.number = [""], {"": 0}
        self.moves: dict[int, tuple] = {}
        # whether two neighbouring pieces, or one alone, are what merging leaves of their text
        self.pairs: dict[int, bool] = {}
        self.whole: dict[str, bool] = {}

    def _move(self, state: int, char: str) -> tuple:
        """(next state, pieces that end with the character as (length, id, score), the longest
        first).  A character that is no piece is one whose id is its code point beyond all ids."""
        model, text = self.model, self.names[state] + char
        while text and text not in self.beginnings:
            text = text[1:]
        if text not in self.number:
            self.number[text] = len(self.names)
            self.names.append(text)
        ends = [(len(p), model.id_of[p], model.score[p])
                for p in (text[i:] for i in range(len(text))) if p in model.score]
        if char not in model.score:
            ends.append((1, len(model.texts) + ord(char), self.worst))
        self.moves[state << 21 | ord(char)] = out = (self.number[text], tuple(ends))
        return out

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) for each word; sorted words share most."""
        before, states, begins, last, scores = "", [0], [0], [0], [0.0]
        stacks = (states, begins, last, scores)
        extend = self._extend_unigram if self.unigram else self._extend_bpe
        size = len(self.model.texts)
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            for stack in stacks:
                del stack[shared + 1:]
            extend(word, shared, *stacks)
            # follow the last pieces back from the word's end
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = begins[end]
            ids.reverse()
            yield word, self._spelt(ids) if ids and max(ids) >= size else ids
            before = word

    def _spelt(self, ids: list[int]) -> list[int]:
        """Characters that are no piece become their bytes, or one unknown id a run."""
        out, model, size, fresh = [], self.model, len(self.model.texts), True
        for i in ids:
            if i < size:
                out.append(i)
                fresh = True
            elif model.byte_ids:
                out.extend(model.byte_ids[b] for b in chr(i - size).encode())
            elif fresh:
                out.append(model.unknown_id)
                fresh = False
        return out

    def _extend_unigram(self, word, shared, states, begins, last, scores) -> None:
        moves, state = self.moves, states[-1]
        for end, char in enumerate(word[shared:], shared + 1):
            state, ends = moves.get(state << 21 | ord(char)) or self._move(state, char)
            best = None
            for length, piece, gain in ends:
                score = scores[end - length] + gain
                if best is None or score > best:
                    best, begin, chosen = score, end - length, piece
            states.append(state)
            begins.append(begin)
            last.append(chosen)
            scores.append(best)

    def _extend_bpe(self, word, shared, states, begins, last, scores) -> None:
        moves, pairs, state = self.moves, self.pairs, states[-1]
        for end, char in enumerate(word[shared:], shared + 1):
            state, ends = moves.get(state << 21 | ord(char)) or self._move(state, char)
            for length, piece, _ in ends:
                start = end - length
                if start:
                    stands = pairs.get(last[start] << 21 | piece)
                    if stands is None:
                        stands = self._stands(last[start] << 21 | piece,
                                              word[begins[start]:start], word[start:end])
                else:
                    stands = self.whole.get(word[:end])
                    if stands is None:
                        stands = self._merge(word[:end]) == [word[:end]]
                        self.whole[word[:end]] = stands
                if stands:
                    break
            else:
                raise ValueError(f"No encoding of {word[:end]!r}: this is no BPE model")
            states.append(state)
            begins.append(start)
            last.append(piece)

    def _stands(self, key: int, left: str, right: str) -> bool:
        """Whether merging the two pieces' text yields just these two."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = out = self._merge(left + right) == [left, right]
        return out

    def _merge(self, text: str) -> list[str]:
        """Merges in the order of their scores, the leftmost first."""
        get, parts = self.model.score.get, list(text)
        found = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = max((s for s in found if s is not None), default=None)
            if best is None:
                return parts
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1])


def marked_words(text: str, model: PieceModel) -> list[str]:
    """The text's marked words in order; together they are the text as the model sees it."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    if model.dummy_prefix:
        marked = MARK + marked
    if not model.separable:
        return [marked]
    first, *rest = marked.split(MARK)
    words = [first] if first else []
    if "" not in rest:
        words.extend([MARK + w for w in rest])
        return words
    run = 0
    for w in rest:
        run += 1
        if w:
            words.append(MARK * run + w)
            run = 0
    if run:
        words.append(MARK * run)
    return words


def parts_of(word: str, model: PieceModel) -> list[str]:
    """The word cut between letters and signs that no piece has side by side."""
    return model.border.split(word)


class Lexicon(dict):
    """Numbers words as they are met, and keeps the ids of each word once it has been encoded."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder
        self.forget()

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def numbers(self, text: str) -> array:
        out = array("i", map(self.__getitem__, marked_words(text, self.encoder.model)))
        if len(self.fresh) > MAX_FRESH:
            self.learn()
        return out

    def learn(self) -> None:
        """Encode the words met since the last time."""
        model, fresh = self.encoder.model, self.fresh
        cut = {w: parts_of(w, model) for w in fresh if not w[1:].isalpha()}
        distinct = {w for w in fresh if w not in cut}
        distinct.update(p for parts in cut.values() for p in parts)
        found = dict(self.encoder.encode(sorted(distinct)))
        ids, sizes = [], []
        for word in fresh:
            before = len(ids)
            for part in cut.get(word) or (word,):
                ids += found[part]
            sizes.append(len(ids) - before)
        self.ids = np.concatenate((self.ids, np.array(ids, np.int32)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)))
        self.fresh = []

    def ids_of(self, texts: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as word numbers, and where each text's begin (and the end)."""
        words = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(t, np.int32)
                                                         for t in texts)]).astype(np.int64)
        starts, sizes = self.ends[words], self.ends[words + 1] - self.ends[words]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *map(len, texts)])]
        return flat, bounds


def encode_block(texts: list[str], lexicon: Lexicon) -> list[list[int]]:
    """Ids of each text."""
    numbers = [lexicon.numbers(t) for t in texts]
    lexicon.learn()
    flat, bounds = lexicon.ids_of(numbers)
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def decode(ids: Iterable[int], model: PieceModel) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, control ids nothing."""
    return _joined(ids, _pieces_as_bytes(model), model.dummy_prefix)


def _joined(ids: Iterable[int], table: list[bytes], dummy_prefix: bool) -> str:
    text = b"".join(map(table.__getitem__, ids))
    if dummy_prefix and text.startswith(b" "):
        text = text[1:]
    return text.decode("utf-8", "replace")


# ---- jobs ---------------------------------------------------------------------

Block = tuple[pa.Table, np.ndarray, np.ndarray]


def _encoded(batches: Iterator[pa.RecordBatch], model: PieceModel,
             block_bytes: int) -> Iterator[Block]:
    """Some rows, all ids of their texts, and where each text's begin.

    The words of a whole block are learned at a time, so that many share their beginnings; ids
    are then laid out for a few rows at a time.
    """
    lexicon = Lexicon(WordEncoder(model))
    # words and ids make no cycles, but the collector would walk all of them again and again
    collecting = gc.isenabled()
    gc.disable()
    try:
        for table in regroup(batches, block_bytes):
            if len(lexicon) > MAX_WORDS:
                lexicon.forget()
            numbers = [lexicon.numbers(b.as_py().decode()) for b in table.column("body")]
            lexicon.learn()
            start = 0
            while start < len(numbers):
                end, words = start, 0
                while end < len(numbers) and (end == start or words < _WORDS_AT_HAND):
                    words += len(numbers[end])
                    end += 1
                yield table.slice(start, end - start), *lexicon.ids_of(numbers[start:end])
                start = end
    finally:
        if collecting:
            gc.enable()


def _id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_bytes(docs, id_col, text_col).select(
        F.col("doc_id").cast("long"), F.xxhash64("body").alias("text_key"), "body")


def _read(lists: Iterable[np.ndarray], table: list[bytes], dummy_prefix: bool) -> list[pa.Array]:
    """``n_tokens, ids_crc32, text`` of ids."""
    texts, counts, sums = [], [], []
    for ids in lists:
        texts.append(_joined(ids.tolist(), table, dummy_prefix))
        counts.append(len(ids))
        sums.append(zlib.crc32(ids.astype("<i4").tobytes()))
    return [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string())]


def _pieces_as_bytes(model: PieceModel) -> list[bytes]:
    byte_of = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
    return [byte_of.get(i, b"") if t is None else t for i, t in enumerate(model.texts)]


READ = "n_tokens long, ids_crc32 long, text string"


def encode_table(docs: DataFrame, model: PieceModel, id_col: str = "doc_id",
                 text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text_key, ids``: one row per row of ``docs``, no shuffle.  ``text_key`` is the
    XXH64 of the text, to compare a decoded text with.

    Null and empty texts have no ids.  Other columns are ignored; rows that share an id or a
    text are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, bounds in _encoded(batches, model, block_bytes):
            same = [rows.column(c).combine_chunks() for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*same, _id_lists(ids, bounds)],
                                             names=["doc_id", "text_key", "ids"])

    return _keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text_key long, ids array<int>")


def decode_table(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """Add ``n_tokens, ids_crc32, text`` to ``doc_id, text_key, ids``; null ids count as none.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian 32-bit integers.
    """
    kept = ["doc_id", "text_key", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces_as_bytes(model)
        for batch in batches:
            lists = [np.empty(0, np.int32) if ids.values is None else ids.values.to_numpy()
                     for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *_read(lists, table, model.dummy_prefix)],
                names=[*kept, "n_tokens", "ids_crc32", "text"])

    return encoded.select(*kept).mapInArrow(
        run, f"doc_id long, text_key long, ids array<int>, {READ}")


def encode_and_decode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id",
                      text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``decode_table(encode_table(docs))`` in one step, so ids do not leave the task between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces_as_bytes(model)
        for rows, ids, bounds in _encoded(batches, model, block_bytes):
            same = [rows.column(c).combine_chunks() for c in ("doc_id", "text_key")]
            texts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*same, _id_lists(ids, bounds), *_read(texts, pieces, model.dummy_prefix)],
                names=["doc_id", "text_key", "ids", "n_tokens", "ids_crc32", "text"])

    return _keyed(docs, id_col, text_col).mapInArrow(
        run, f"doc_id long, text_key long, ids array<int>, {READ}")
