"""License notices by conditional compression, confirmed by wording.

Around the cues of a block, windows as long as each template's notice are compressed alone and
with the template as a raw zstandard dictionary, both as lower-case words.  Templates are ranked
by the bytes they save; a window of which a template saves little, compared with what it saves of
itself, is no candidate for it.  The best of the ranking, and those that save nearly as much, are
then compared with the window word by word: of those that still have most of their words the one
with the most words found, less those that differ, wins; without any difference it is exact, else
it is returned as modified, with the differences.  If none of them is confirmed, the next in the ranking are tried.
A block can hold several notices: windows that reach into one that was found are cut there and
compressed again.

Blocks are lines around a cue, one of a few strings of which every template has one.  All text
is searched for cues; a line without any is no notice.  Long blocks are cut between notices: a
notice that begins before a cut is whole in the block before it, any other in the one after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import takewhile
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_and_bytes, slices
from riskweave.llm.license_texts import TEMPLATES

CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "mozilla public")
# A notice is at most this much longer than twice the longest template (blanks, comment marks and
# names included).
LEAD_CHARS = 200
# The fast strategy leaves literals as they are: with entropy coding, what the words around a notice
# do to its statistics can be more than a short template saves.
COMPRESSION = {"strategy": zstandard.STRATEGY_FAST, "target_length": 1, "min_match": 5}
# A window is a candidate for a template that saves this share of what it saves of itself.
MIN_SAVING = 0.25
# What is saved depends on the words around a notice too, so all candidates that save this share
# of the largest saving are winners, of which wording chooses.
NEARLY = 0.5
# Share of a template's words that a modified notice still has, in order.
MIN_SHARED = 0.8
# Characters of blocks whose findings a task remembers.
MAX_REMEMBERED = 16_000_000
WILD = "<*>"
# Words between two found words that a wildcard covers at most.
WILD_WORDS = 12

_WORD = re.compile(r"<\*>|[^\W_]+(?:\.[0-9]+)*")
# every cue begins in one of these
_CUE_WORD = re.compile("|".join(c.split()[0] for c in CUES))


def lowered(text: str) -> str:
    """Lower case, as long as the text: letters that would grow stay as they are."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lower


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def cues_of(words: Sequence[str]) -> list[int]:
    return [i for i, w in enumerate(words) if _CUE_WORD.search(w)]


def stretched(words: Sequence[str]) -> int:
    """Words that these words of a template cover at most."""
    return len(words) + (WILD_WORDS - 1) * words.count(WILD)


def begin_of_word(text: str, at: int, floor: int) -> int:
    """``at``, or if it is inside a word (not one of hundreds of characters), where that begins."""
    low = max(floor, at - 100)
    begin = at
    while begin > low and begin < len(text) and text[begin].isalnum() and text[begin - 1].isalnum():
        begin -= 1
    return begin


class Candidate(NamedTuple):
    """A template for the words ``low`` to ``high`` of a block."""
    lost: int  # bytes saved, negative
    license: str
    low: int
    high: int


@dataclass(frozen=True)
class Finding:
    license: str
    # share of what the template saves of itself
    saving: float
    exact: bool
    # (template's words, block's words) where they differ
    differences: tuple[tuple[str, str], ...]
    # the stretch, in characters of the block
    start: int
    end: int


class Scanner:
    """Compares blocks with templates; remembers blocks, since notices repeat."""

    def __init__(self, templates: Mapping[str, str]):
        for name, text in templates.items():
            if not any(c in text.lower() for c in CUES):
                raise ValueError(f"Template {name} has none of the cues {CUES}")
        self.words = {name: words_of(text) for name, text in templates.items()}
        how = zstandard.ZstdCompressionParameters.from_level(1, **COMPRESSION)
        self.alone = zstandard.ZstdCompressor(compression_params=how)
        self.given, self.worth, self.reach = {}, {}, {}
        for name, words in self.words.items():
            plain = [w for w in words if w != WILD]
            dictionary = zstandard.ZstdCompressionDict(
                " ".join(plain).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(compression_params=how, dict_data=dictionary)
            self.worth[name] = self.saved(name, plain)
            if self.worth[name] <= 0:
                raise ValueError(f"Template {name} is too short to save anything")
            # words of a notice at most before and from one of its cues on, some put in
            cues, slack = cues_of(words), len(plain) // 4
            self.reach[name] = (stretched(words[:cues[-1]]) + slack,
                                stretched(words[cues[0]:]) + slack, slack)
        self.longest = max(map(len, templates.values()), default=0)
        self.vocabulary = {w for words in self.words.values() for w in words}
        self.known: dict[str, tuple[Finding, ...]] = {}
        self.remembered = 0

    # ---- blocks -------------------------------------------------------------------------
    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Stretches of whole lines around cues, in order and disjoint; very long ones are cut
        where no notice lies across."""
        lower = lowered(text)
        spots = sorted({m.start() for c in CUES for m in re.finditer(re.escape(c), lower)})
        # no notice is longer than reach; a block that is cut goes on for twice that
        done, reach = 0, 2 * self.longest + LEAD_CHARS
        room = 2 * reach
        for at in spots:
            if at < done:
                continue
            start = max(text.rfind("\n", 0, at) + 1, begin_of_word(text, max(at - reach, 0), 0), done)
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            cut = end > at + room
            end = min(end, at + room)
            # lines beside it that are made of the templates' words belong to the notice
            while not cut and end < len(text):
                stop = text.find("\n", end + 1)
                stop = len(text) if stop < 0 else stop
                # paragraphs of a notice have blank lines between them
                while stop < len(text) and stop <= at + room and not _WORD.search(text, end, stop):
                    stop = text.find("\n", stop + 1)
                    stop = len(text) if stop < 0 else stop
                if not self._familiar(text[end:min(stop, end + room)]):
                    break
                cut = stop > at + room
                end = min(stop, at + room)
            while start > done and text[start - 1] == "\n" and start > at - reach:
                first = max(text.rfind("\n", 0, start - 1) + 1, at - reach, done)
                while first > max(at - reach, done) and not _WORD.search(text, first, start):
                    first = max(text.rfind("\n", 0, first - 1) + 1, at - reach, done)
                if not self._familiar(text[first:start]):
                    break
                start = first
            done = self._between(text, start, end, end - reach) if cut else end
            yield start, done

    def _between(self, text: str, start: int, end: int, at: int) -> int:
        """The first place from ``at`` on that no notice of ``text[start:end]`` lies across.

        Notices that begin before ``at`` end before ``end``; later ones may go on beyond it, and
        are left to the next block."""
        for f in sorted(self.findings(text[start:end]), key=lambda f: f.start):
            if start + f.start < at:
                at = max(at, start + f.end)
        return begin_of_word(text, at, start)

    def _familiar(self, line: str) -> bool:
        words = words_of(line)
        known = sum(w in self.vocabulary for w in words)
        return known >= 0.8 * len(words) if len(words) > 2 else 0 < known == len(words)

    # ---- comparison ---------------------------------------------------------------------
    def saved(self, name: str, words: Sequence[str]) -> int:
        """Bytes that the template saves when the words are compressed."""
        body = " ".join(words).encode()
        return len(self.alone.compress(body)) - len(self.given[name].compress(body))

    def rank(self, block: str) -> list[Candidate]:
        """Candidates of a block, those that save most first, then those of the template that
        saves least of itself, then by name and place."""
        return self._ranked(words_of(block))

    def _ranked(self, words: list[str]) -> list[Candidate]:
        cues, out = cues_of(words), []
        for name in self.words:
            out += self._windows(name, words, cues, 0, len(words))
        return self._sorted(out)

    def _sorted(self, candidates: Iterable[Candidate]) -> list[Candidate]:
        return sorted(candidates, key=lambda c: (c.lost, self.worth[c.license], c))

    def _windows(self, name: str, words: list[str], cues: list[int], low: int, high: int
                 ) -> Iterator[Candidate]:
        """Candidates for one template around the cues of ``words[low:high]``.

        A window has room for every notice that has one of its cues at the window's cue or in
        the ``slack`` words after that, so those get no window of their own."""
        before, behind, slack = self.reach[name]
        after = low
        for k in cues[bisect_left(cues, low):bisect_left(cues, high)]:
            if k >= after:
                after = k + slack + 1
                begin, end = max(low, k - before), min(high, k + behind + slack)
                saved = self.saved(name, words[begin:end])
                if saved >= MIN_SAVING * self.worth[name]:
                    yield Candidate(-saved, name, begin, end)

    def findings(self, block: str) -> tuple[Finding, ...]:
        """The notices a block holds, in order."""
        found = self.known.get(block)
        if found is None:
            if self.remembered >= MAX_REMEMBERED:
                self.known.clear()
                self.remembered = 0
            self.remembered += len(block)
            found = self.known[block] = tuple(
                sorted(self._findings(block), key=lambda f: f.start))
        return found

    def _findings(self, block: str) -> Iterator[Finding]:
        found = list(_WORD.finditer(lowered(block)))
        words, spans = [m.group() for m in found], [m.span() for m in found]
        cues, ranked = cues_of(words), self._ranked(words)
        compared: dict[Candidate, tuple | None] = {}
        while ranked:
            most = ranked[0].lost
            best = list(takewhile(lambda c: c.lost <= NEARLY * most, ranked))
            for c in best:
                if c not in compared:
                    compared[c] = self._confirmed(c, words)
            winners = [compared[c] for c in best if compared[c]]
            if not winners:
                ranked = ranked[len(best):]
                continue
            _, lost, name, i, j, differences = min(winners)
            yield Finding(name, round(-lost / self.worth[name], 4), not differences,
                          differences, spans[i][0], spans[j - 1][1])
            beside = [c for c in ranked if c.high <= i or c.low >= j]
            into = {(c.license, *part) for c in ranked if c.low < j and c.high > i
                    for part in ((c.low, i), (j, c.high)) if part[0] < part[1]}
            for name, low, high in into:
                beside += self._windows(name, words, cues, low, high)
            ranked = self._sorted(set(beside))

    def _confirmed(self, c: Candidate, words: list[str]) -> tuple | None:
        """What a winner's wording says, the best confirmation first; None without enough of it."""
        template = self.words[c.license]
        shared, differences, (i, j) = compare(template, words[c.low:c.high])
        if shared < MIN_SHARED:
            return None
        found = round(shared * sum(w != WILD for w in template))
        differing = sum(len(side.split()) for pair in differences for side in pair)
        return differing - found, c.lost, c.license, c.low + i, c.low + j, tuple(differences)


def compare(template: list[str], words: list[str]) -> tuple[float, list[tuple[str, str]],
                                                            tuple[int, int]]:
    """Share of the template's words found in order, the differences between the first and the
    last of them, and where in ``words`` these are.  A wildcard differs from no few words."""
    spot = exactly(template, words)
    if spot:
        return 1.0, [], spot
    matcher = SequenceMatcher(None, template, words, autojunk=False)
    near = matcher.find_longest_match()
    if not near.size:
        return 0.0, [], (0, 0)
    # around the longest common run first, or words far off are taken for the notice's
    slack = len(template) // 4 + 1 + WILD_WORDS * template.count(WILD)
    low = max(0, near.b - near.a - slack)
    high = near.b + len(template) - near.a + slack
    shared, differences, (i, j) = _aligned(
        template, words[low:high], SequenceMatcher(None, template, words[low:high], autojunk=False))
    if shared >= MIN_SHARED:
        return shared, differences, (low + i, low + j)
    return _aligned(template, words, matcher)


def exactly(template: list[str], words: list[str]) -> tuple[int, int] | None:
    """The shortest, then first stretch of ``words`` that is the template word for word."""
    runs: list[list[str]] = [[]]
    for w in template:
        if w == WILD:
            runs.append([])
        else:
            runs[-1].append(w)
    runs = [run for run in runs if run]  # a wildcard at an end covers nothing
    if not runs:
        return None
    best = None
    for begin in (i for i, w in enumerate(words) if w == runs[0][0]):
        # where the runs so far can end
        ends = {begin + len(runs[0])} if words[begin:begin + len(runs[0])] == runs[0] else set()
        for run in runs[1:]:
            ends = {k + len(run) for e in ends for k in range(e, e + WILD_WORDS + 1)
                    if words[k:k + len(run)] == run}
        if ends and (best is None or min(ends) - begin < best[1] - best[0]):
            best = begin, min(ends)
    return best


def _aligned(template: list[str], words: list[str], matcher: SequenceMatcher
             ) -> tuple[float, list[tuple[str, str]], tuple[int, int]]:
    matches = [m for m in matcher.get_matching_blocks() if m.size]
    if not matches:
        return 0.0, [], (0, 0)
    shared = sum(m.size for m in matches) / sum(w != WILD for w in template)
    differences, i, j = [], 0, matches[0].b
    for m in [*matches, None]:
        a, b = (m.a, m.b) if m else (len(template), j)
        missing, extra = template[i:a], words[j:b]
        if (missing or extra) and not (missing == [WILD] and len(extra) <= WILD_WORDS):
            differences.append((" ".join(missing), " ".join(extra)))
        if m:
            i, j = m.a + m.size, m.b + m.size
    return shared, differences, (matches[0].b, j)


FOUND = ("doc_id long, n_blocks long, licenses array<string>, modified array<string>, "
         "notices array<struct<start:long,end:long,license:string,saving:double,exact:boolean,"
         "differences:array<struct<template:string,block:string>>>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_blocks`` with a cue, ``licenses`` whose
    wording is there without a difference, ``modified`` ones with some, and all ``notices``
    (block in code points, saving, differences).

    A null or empty text has none; other columns are ignored; rows that share an id or a text are
    rows of their own.  Of templates found equally well the one that saves more counts, then the
    name that sorts first.  No row moves between tasks.
    """
    templates = dict(templates)
    notice = pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()),
        ("saving", pa.float64()), ("exact", pa.bool_()),
        ("differences", pa.list_(pa.struct([("template", pa.string()), ("block", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in slices(batches, 8 << 20):
            counts, exact, modified, notices = [], [], [], []
            for body in batch.column("body").to_pylist():
                text = body.decode()
                rows, n = [], 0
                for start, end in scanner.blocks(text):
                    n += 1
                    rows += [{"start": start, "end": end, "license": f.license,
                              "saving": f.saving, "exact": f.exact,
                              "differences": [dict(zip(("template", "block"), d))
                                              for d in f.differences]}
                             for f in scanner.findings(text[start:end])]
                counts.append(n)
                notices.append(rows)
                exact.append(sorted({r["license"] for r in rows if r["exact"]}))
                modified.append(sorted({r["license"] for r in rows if not r["exact"]}))
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(exact, names),
                 pa.array(modified, names), pa.array(notices, pa.list_(notice))],
                names=["doc_id", "n_blocks", "licenses", "modified", "notices"])

    rows = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, FOUND)
