"""Template residue and error-page text: labelled exemplars, an inverted index, TF-IDF containment (problem 10)."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exemplars import CONCEPTS, PLACEHOLDERS, labelled

#: How much of an exemplar's TF-IDF weight a passage window must hold.
CONTAINED = 0.75
#: Share of a text's passages, chrome left aside, from which residue is the main part of it.
MAIN_PART = 0.5
#: Words that the open end of an exemplar takes in at most.
SLOT_WORDS = 4
#: Long exemplars, of which any part may be taken: label -> (words of a window, how many of them the exemplar must hold,
#: how many of these as they stand, not by their ending alone).
PARTS = {"latin": (5, 3, 2), "mashed": (3, 3, 3)}
#: Letters of a word's ending.
ENDING = 3

_TERM = re.compile(r"[\u3400-\u9fff]|[^\W\d_\u3400-\u9fff]+|\d+|[©«]")
_ZERO_WIDTH = regex.compile(r"[\u200b-\u200d\u2060\ufeff\u00ad]")
_FENCE = regex.compile(r"(?ms)^?(```|~~~).*?(?:\1|\Z)")
_TICKED = regex.compile(r"`[^`\n]+`")
_INDENTED = regex.compile(r"(?m)^(?:\t| {4,})(?!at |File ).*$")
_QUOTED = regex.compile(r"(?<![\w:\[{,])[\"“„»‘](?:(?![.!?…] )[^\"“”„\n]){2,}[\"”“](?![\w])")
_PUNCTUATED = regex.compile(r"(?m)^\s*[{<].*$")
_TAG = regex.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<\?xml[^<>]*\?>", regex.I)
_HEX = re.compile(r"\b[0-9a-f]{8,}\b")
#: Where a passage ends: at a line break, after a sentence.
_PASSAGE = regex.compile(r"[\r\n]+|(?<=[.!?…])\s+|(?<=[。！？])")
_SHAPES = [(literals, regex.compile(p, regex.I)) for literals, p in PLACEHOLDERS]


def terms(text: str) -> list[str]:
    """The terms of a text: lower-case words, words of one meaning by the name of that meaning, single Han characters,
    and for numbers ``4xx`` (an HTTP error) or ``#``."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _ZERO_WIDTH.sub("", text)).replace("’", "'")
    text = _HEX.sub("0", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    found, concept = _TERM.findall(text.replace("'", "").lower()), CONCEPTS.get
    return [concept(t, t) if t[0] > "9" else "4xx" if len(t) == 3 and t[0] in "45" else "#" if t.isdigit() else t for t in found]


def outside_code(text: str) -> str:
    """A text without what is code: fenced blocks, ticked spans, indented lines (stack frames are none)."""
    return _INDENTED.sub(" ", _TICKED.sub(" ", _FENCE.sub(" ", text)))


def outside_quotes(text: str) -> str:
    """A text without short quotations; lines that are markup or data keep theirs."""
    return "\n".join(line if _PUNCTUATED.match(line) or '": ' in line else _QUOTED.sub(" ", line) for line in text.split("\n"))


def has_placeholder(text: str) -> bool:
    """Whether a placeholder stands unfilled in the running text, outside code and quotations. The shapes to look for
    are retrieved by the literals they can't be without."""
    low = text.lower()
    shapes = [p for literals, p in _SHAPES if any(x in low for x in literals)]
    if not any(p.search(text) for p in shapes):
        return False
    running = outside_quotes(outside_code(text))
    return any(p.search(running) for p in shapes)


class ExemplarIndex:
    """The labelled exemplars with their TF-IDF weights and an inverted index.

    An exemplar is retrieved by its heaviest terms: so many that what is left of it is less than must be contained, so
    a passage that holds enough of it can't be without one of them.
    """

    def __init__(self, documents: int = 0, frequency: dict[str, int] | None = None, exemplars: Iterable[tuple[str, str]] | None = None):
        frequency = frequency or {}

        def idf(t: str) -> float:
            return math.log((documents + 1) / (frequency.get(t, 0) + 1)) + 1

        self.exemplars: list[tuple[str, dict[str, float], int, float, bool]] = []
        self.index: dict[str, list[int]] = defaultdict(list)
        self.parts: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        long: dict[str, set[str]] = defaultdict(set)
        seen = set()
        for label, text in labelled() if exemplars is None else exemplars:
            words = [t for t in terms(text.replace("*", " ")) if t != "#"]
            if label in PARTS:
                long[label].update(words)
                continue
            if not words or (label, tuple(words)) in seen:
                continue
            seen.add((label, tuple(words)))
            weight = {t: idf(t) for t in words}
            left = sum(weight.values())
            enough = CONTAINED * left
            for t in sorted(weight, key=lambda t: (-weight[t], t)):
                if left < enough - 1e-9:
                    break
                self.index[t].append(len(self.exemplars))
                left -= weight[t]
            open_end = text.rstrip(".'\"").endswith("*")
            self.exemplars.append((label, weight, len(weight), enough, open_end))
        # what a tenth of the corpus (and twenty texts) says isn't peculiar to filler, nor is the ending of such a word
        usual = {t for t in frequency if frequency[t] > max(20, documents / 10)}
        for label, words in long.items():
            if PARTS[label][2] == PARTS[label][0]:  # no endings count
                self.parts[label] = frozenset(words), frozenset()
                continue
            endings = {w[-ENDING:] for w in words if len(w) > ENDING} - {w[-ENDING:] for w in usual}
            self.parts[label] = frozenset(words - usual), frozenset(endings)
        self.keys = frozenset(self.index).union(*(own for own, _ in self.parts.values()))

    @staticmethod
    def vocabulary(exemplars: Iterable[tuple[str, str]] | None = None) -> set[str]:
        """Every term whose document frequency matters."""
        return {t for _, text in (labelled() if exemplars is None else exemplars) for t in terms(text)}

    def _retrieved(self, present: set[str]) -> list[int]:
        """The exemplars of which a text with these terms may hold enough."""
        found = {e for t in self.keys & present for e in self.index.get(t, ())}
        return [e for e in sorted(found) if sum(w for t, w in self.exemplars[e][1].items() if t in present) >= self.exemplars[e][3] - 1e-9]

    def may_show(self, present: set[str]) -> bool:
        """Whether a text with these terms can hold an exemplar or a part of a long one."""
        return any(own & present for own, _ in self.parts.values()) or bool(self._retrieved(present))

    def _mark(self, words: list[str], marks: list[str | None], end_of: list[int]) -> None:
        spots: dict[str, list[int]] | None = None
        for e in self._retrieved(set(words)):
            label, weight, size, enough, open_end = self.exemplars[e]
            if spots is None:
                spots = defaultdict(list)
                for i, t in enumerate(words):
                    spots[t].append(i)
            hits = sorted((i, t) for t in weight for i in spots.get(t, ()))
            reach, low, held, count = size + 3, 0, 0.0, defaultdict(int)
            for high, (i, t) in enumerate(hits):
                count[t] += 1
                held += weight[t] if count[t] == 1 else 0
                while i - hits[low][0] >= reach:
                    gone = hits[low][1]
                    count[gone] -= 1
                    held -= weight[gone] if not count[gone] else 0
                    low += 1
                if held >= enough - 1e-9:
                    # what stands between its words, or after them if it ends so, fills the exemplar's slots
                    for k in range(hits[low][0], min(i + SLOT_WORDS, end_of[i]) + 1 if open_end else i + 1):
                        if marks[k] in (None, "chrome"):
                            marks[k] = label

    def _mark_parts(self, words: list[str], marks: list[str | None]) -> None:
        """Mark windows of which a long exemplar holds nearly all: its words in any order, or words that end as its do."""
        at = [i for i, t in enumerate(words) if t != "#"]
        for label, (own, endings) in self.parts.items():
            size, enough, sure = PARTS[label]
            held = [2 if words[i] in own else 1 if len(words[i]) > ENDING and words[i][-ENDING:] in endings else 0 for i in at]
            for k in range(len(at) - size + 1):
                window = held[k : k + size]
                if window[0] and size - window.count(0) >= enough and window.count(2) >= sure:
                    for j in range(k, k + size):
                        if held[j]:
                            marks[at[j]] = label

    @staticmethod
    def _passages(words: list[str], marks: list[str | None], tally: dict[str, int]) -> None:
        """Count one passage: as the kinds of residue it is made of, as content, or as nothing if all is chrome.

        Residue that content precedes (a text that breaks off into an error page) counts beside that content; where
        content follows it or stands in it, it is only being talked about.
        """
        shown = [m for t, m in zip(words, marks) if m != "chrome" and t != "#"]
        plain = [k for k, m in enumerate(shown) if m is None]
        residue = shown[plain[-1] + 1 :] if plain else shown
        if len(plain) <= 0.2 * len(shown):
            plain, residue = [], [m for m in shown if m]
        if plain:
            tally["content"] += 1
            if len(residue) < 2:
                return
        last = None
        for m in residue:
            if m != last:
                tally[m] += 1
            last = m

    def share(self, text: str) -> tuple[float, str | None]:
        """The share of residue among a text's passages, chrome left aside, and its most frequent label."""
        text = _ZERO_WIDTH.sub("", text)
        running = outside_quotes(outside_code(text))
        ends, words, end_of = [], [], []
        for passage in _PASSAGE.split(running):
            words += terms(passage or "")
            end_of += [len(words) - 1] * (len(words) - len(end_of))
            ends.append(len(words))
        marks: list[str | None] = [None] * len(words)
        self._mark(words, marks, end_of)
        self._mark_parts(words, marks)
        tally: dict[str, int] = defaultdict(int)
        start = 0
        for end in ends:
            if end > start:
                self._passages(words[start:end], marks[start:end], tally)
            start = end
        # a text that is all code or quotation is content
        tally["content"] += not tally and bool(terms(text))
        for made_up in ("latin", "mashed"):
            tally["filler"] += tally.pop(made_up, 0)
        residue = sum(v for k, v in tally.items() if k != "content")
        if not residue:
            return 0.0, None
        return residue / (residue + tally["content"]), max((k for k in tally if k != "content"), key=lambda k: (tally[k], k))

    def residue(self, text: str) -> str | None:
        """The kind of residue a text shows, None if it shows none."""
        if has_placeholder(_ZERO_WIDTH.sub("", text)):
            return "placeholder"
        if not self.may_show(set(terms(text))):
            return None
        share, label = self.share(text)
        return label if share >= MAIN_PART else None


def exemplar_index(documents: DataFrame, text: str, exemplars: list[tuple[str, str]] | None = None) -> ExemplarIndex:
    """The index with document frequencies counted over all texts, by the same ``terms`` that the matching reads. Only
    the exemplars' own terms are counted, and only their counts (a fixed number) reach the driver."""
    wanted = frozenset(ExemplarIndex.vocabulary(exemplars))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row per term and task; the null term counts the texts
        count: dict[str | None, int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                count[None] += 1
                for term in wanted.intersection(terms(t)):
                    count[term] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["t", "count"])

    held = documents.select(F.col(text)).where(F.col(text).isNotNull())
    counts = held.mapInArrow(tally, "t string, count bigint").groupBy("t").agg(F.sum("count").alias("count"))
    frequency = {r["t"]: r["count"] for r in counts.collect()}
    return ExemplarIndex(frequency.pop(None, 0), frequency, exemplars)


def residue_kinds(documents: DataFrame, key: str, text: str, exemplars: list[tuple[str, str]] | None = None) -> DataFrame:
    """(``key``, kind) of every text that shows residue where content should be: ``placeholder`` if one is left
    unfilled in running text, else ``filler``, ``error`` or ``scripts`` if such text is its main part.

    ``exemplars`` is the labelled table, (label, text) with "*" for what differs from case to case; without it the
    general ones of ``exemplars.py`` are used. An exemplar is retrieved by the terms it can't be without; a passage window
    that holds three quarters of its TF-IDF weight is marked. Of long exemplars (made-up Latin, typed filler) any part
    may be taken, so there the share of the window counts (``PARTS``). Placeholders are exemplars of shape, retrieved by
    their literals. A text is a case if half of its passages (sentences or lines) or more are residue, what stands around
    every page left aside. Code and quotations are never residue. Null, empty and blank texts are no
    cases; repeated rows give a row each; an empty table gives none. One pass counts document frequencies over the
    whole corpus, the second reads every whole text; nothing is shuffled but the counts of the exemplars' terms. The
    exemplars are broadcast: they are a table made by hand, and don't grow with the corpus.
    """
    index = documents.sparkSession.sparkContext.broadcast(exemplar_index(documents, text, exemplars))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [index.value.residue(t) for t in batch.column(1).to_pylist()]
            rows = pa.array([i for i, k in enumerate(kinds) if k], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([k for k in kinds if k], pa.string())], names=[key, "kind"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(find, f"`{key}` {kind}, kind string")
