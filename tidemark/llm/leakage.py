"""Evaluation texts leaking into training text: matching lengths from a generalised suffix automaton (problem 9)."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise

#: A leaked stretch has at least this many words of the passage, and at most one in so many is changed.
STRETCH, ONE_IN = 30, 6
#: Shortest run of equal words that counts as a seed.
SEED = 3
#: Words of a text that the exact check looks at in one go, besides the reach of a stretch.
WINDOW = 500
#: Words of evaluation items in one automaton; more items make more automata, one after the other.
BLOCK_WORDS = 1_000_000

_INLINE = regex.compile(r"</?(?:a|b|i|u|s|em|strong|span|code|sub|sup|small|mark|font|del|ins|q|cite|abbr)(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", regex.S)
_NOTE = regex.compile(r"\[\^?\d{1,3}\]")
_LINK = regex.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_BROKEN = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n[ \t]*(?=\p{Ll})")
_DROP = regex.compile(r"[^\p{L}\p{N}\s]+|_+")
_FORMAT = regex.compile(r"[\p{Cf}\p{Mn}]+")


def words_of(text: str) -> list[str]:
    """The words of a text, without what doesn't count: letter case, punctuation, spacing, line breaks, markup
    (tags, entities, emphasis, links, note marks) and character variants (width, ligatures, accents, soft hyphens)."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub(" ", _INLINE.sub("", text)))
    if "[" in text:
        text = _NOTE.sub("", _LINK.sub(r"\1", text))
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKD", text))
    text = _DROP.sub("", _BROKEN.sub("", text))
    return text.casefold().split()


class SuffixAutomaton:
    """All runs of words of several passages, with where they end.

    Reading a text word by word, ``step`` keeps the longest run that ends here and occurs in any passage; runs don't
    cross passages. ``ends`` of a state holds every (passage, end) of its runs of ``SEED`` words and more.
    """

    def __init__(self, passages: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        found: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(passages):
            last = 0
            for at, w in enumerate(words):
                last = self._grow(last, w, found)
                found[last].append((k, at))
        by_length = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in by_length:
            if self.link[s] > 0:
                found[self.link[s]].extend(found[s])
        #: For each state the state that stands for its last SEED words, -1 if it is shorter.
        self.seed = [-1] * len(self.link)
        for s in reversed(by_length):
            if self.length[s] >= SEED:
                up = self.link[s]
                self.seed[s] = self.seed[up] if up > 0 and self.length[up] >= SEED else s
        used = set(self.seed) - {-1}
        self.ends = {s: np.array(sorted(set(found[s])), np.int32).reshape(-1, 2) for s in used}

    def _new(self, length: int, edges: dict, link: int, found: list) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        found.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int, found: list) -> int:
        """The state of the runs of ``q`` no longer than those that ``p`` leads to by ``w``."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], found)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _grow(self, last: int, w: int, found: list) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another passage has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w, found)
        new, p = self._new(self.length[last] + 1, {}, 0, found), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, found)
        return new

    def seeds(self, words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end in the text, passage, end in the passage) of every common run of ``SEED`` words."""
        state, length = 0, 0
        nexts, links, lengths, seed, ends = self.next, self.link, self.length, self.seed, self.ends
        at, got = [], []
        for i, w in enumerate(words):
            if w < 0:
                state = length = 0
                continue
            while state and w not in nexts[state]:
                state = links[state]
                length = lengths[state]
            to = nexts[state].get(w)
            if to is None:
                state = length = 0
                continue
            state, length = to, length + 1
            if length >= SEED:
                at.append(i)
                got.append(ends[seed[state]])
        if not at:
            none = np.zeros(0, np.int64)
            return none, none, none
        hits = np.concatenate(got).astype(np.int64)
        return np.repeat(np.array(at), [len(g) for g in got]), hits[:, 0], hits[:, 1]


def longest_looked_at(stretch: int, one_in: int) -> int:
    """Longer stretches within the limit need no look of their own: one half is within it too, and long enough without
    the edits at the cut."""
    return 2 * -(-stretch * one_in // (one_in - 1)) - 1


def holds_any_stretch(passage: np.ndarray, text: np.ndarray, stretch: int = STRETCH, one_in: int = ONE_IN) -> bool:
    """Whether any ``stretch`` passage words or more, first and last of them kept, stand anywhere in a text with at most
    one in ``one_in`` edited.

    Edit distances of passage[s : s + size] to the nearest part of the text, for all starts ``s`` at once, up to the
    size of ``longest_looked_at``.
    """
    n, m = len(passage), len(text)
    longest = min(longest_looked_at(stretch, one_in), n)
    never, ramp = longest + 1, np.arange(m + 1, dtype=np.int32)
    starts = np.arange(max(0, n - stretch + 1))
    d = np.full((len(starts), m + 1), never, np.int32)
    d[:, 1:][text == passage[starts][:, None]] = 0
    for size in range(2, longest + 1):
        # starts whose distance is beyond that of the longest stretch, or that end with the passage, are done
        alive = (starts + size <= n) & (d.min(axis=1, initial=never) <= longest // one_in)
        starts, d = starts[alive], d[alive]
        if not len(starts):
            return False
        same = text == passage[starts + size - 1][:, None]
        if size >= stretch and (d[:, :-1][same] * one_in <= size).any():
            return True
        row = d + 1
        row[:, 1:] = np.minimum(row[:, 1:], d[:, :-1] + ~same)
        d = np.minimum.accumulate(row - ramp, axis=1) + ramp
    return False


class Matcher:
    """Finds leaked passages in texts. Small enough to broadcast: it grows with the evaluation items alone."""

    def __init__(self, items: list[tuple[int, str]], stretch: int = STRETCH, one_in: int = ONE_IN):
        self.stretch, self.one_in, self.ids = stretch, one_in, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        words = [words_of(p) for _, p in items]
        codes = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in p] for p in words]
        self.passages = [np.array(c, np.int64) for c in codes]
        self.automaton = SuffixAutomaton(codes)
        # with e edits a stretch of n words keeps n - e of them in at most e + 1 runs: so many seeds at least
        edits = stretch // one_in
        self.least = max(1, stretch - edits - (SEED - 1) * (edits + 1))
        # a word dropped or added moves the diagonal by one, so the seeds of one stretch span as many diagonals as the
        # longest stretch looked at has edits: two neighbouring buckets hold them all
        self.band = longest_looked_at(stretch, one_in) // one_in + 1

    def leaked(self, text: str) -> list[int]:
        """The items of which ``text`` holds a stretch."""
        look = self.vocabulary.get
        words = [look(w, -1) for w in words_of(text)]
        at, item, end = self.automaton.seeds(words)
        if len(at) < self.least:
            return []
        # seeds by item and bucket of diagonals; two neighbouring buckets hold all those of a stretch
        diagonal = (at - end) // self.band
        low, wide = diagonal.min(), int(diagonal.max() - diagonal.min()) + 2
        keys, count = np.unique(item * wide + diagonal - low, return_counts=True)
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        enough = keys[count + np.where(follows, np.append(count[1:], 0), 0) >= self.least]
        out, codes = [], np.array(words, np.int64)
        for key in enough.tolist():
            k, b = divmod(key, wide)
            if out and out[-1] == self.ids[k]:
                continue
            near = (item == k) & ((diagonal - low == b) | (diagonal - low == b + 1))
            if self._confirmed(self.passages[k], codes, np.sort(at[near])):
                out.append(self.ids[k])
        return out

    def _confirmed(self, passage: np.ndarray, text: np.ndarray, at: np.ndarray) -> bool:
        """The exact check, around each group of seeds that could belong to one stretch."""
        longest = longest_looked_at(self.stretch, self.one_in)
        reach = longest + longest // self.one_in  # words of the text that a stretch can take up
        for part in np.split(at, np.flatnonzero(np.diff(at) > reach) + 1):
            if len(part) < self.least:
                continue
            for lo in range(max(0, int(part[0]) - reach), int(part[-1]) + 1, WINDOW):
                if holds_any_stretch(passage, text[lo : min(lo + WINDOW, int(part[-1])) + reach], self.stretch, self.one_in):
                    return True
        return False


def leaked_items(
    documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, passage: str,
    stretch: int = STRETCH, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(``key``, ``item_key``) of every text that holds, in order, at least ``stretch`` words of an item's passage with
    at most one word in ``one_in`` changed, dropped or added (see ``words_of`` for what doesn't count). A stretch
    begins and ends with kept words.

    The passages' suffix automaton gives the longest matching run at every word of a text; runs of three words and
    more are the seeds. A stretch within the limits can't have fewer seeds near one diagonal than ``Matcher.least``,
    so only around that many is every part of the passage compared with the text, and none is missed. The evaluation items are streamed to the driver in blocks of
    ``block_words`` words; one block's matcher at a time is built and broadcast, which bounds both whatever the number
    of items. The corpus is read once per block without a shuffle, and blocks before the last are written as they are
    done. Null, empty and blank texts
    and passages match nothing; passages shorter than ``stretch`` can't leak; a repeated row gives its own rows.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())

    def against(block: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        matcher = spark.sparkContext.broadcast(Matcher(block, stretch, one_in))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = matcher.value
            for batch in batches:
                found = [(row, i) for row, t in enumerate(batch.column(1).to_pylist()) for i in m.leaked(t)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _ in found], pa.int64())), pa.array([i for _, i in found], pa.int64())], names=[key, item_key]
                )

        return slim.mapInArrow(match, f"`{key}` {kind}, `{item_key}` bigint"), matcher

    out, waiting = None, None
    for block in _blocks(items.select(F.col(item_key).cast("bigint"), passage), block_words):
        if waiting is not None:  # more than one block: each is written before the next is built
            part, matcher = against(waiting)
            part = materialise(part, "leaked")
            matcher.unpersist()
            out = part if out is None else out.unionByName(part)
        waiting = block
    part, _ = against(waiting)
    return part if out is None else out.unionByName(part)


def _blocks(items: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    """The items (id, passage) in blocks of about ``words`` words, streamed to the driver in order of their ids, one
    partition at a time; one empty block if there are none."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.where(items[0].isNotNull() & items[1].isNotNull()).distinct().orderBy(*items.columns).toLocalIterator():
        n = r[1].count(" ") + 1
        if block and size + n > words:
            yield block
            block, size = [], 0
        block.append((int(r[0]), r[1]))
        size += n
    yield block
