"""Encoding of the whole corpus with a public tokenizer, by prefix dynamic programming (problem 8)."""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie; a parameter of everything that needs one.
TOKENIZERS = "/opt/tokenizers"

# ---- fixed values -------------------------------------------------------------------------------------------
#: The pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How many characters from its start on the pattern may look at to decide on a piece that ends before them.
LOOK = 3
# ---- end of fixed values ------------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level vocabulary file: a token in base64 and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixTable:
    """The last token of the encoding of every prefix of one piece.

    Of all tokens that end a prefix exactly one can end its encoding: the one that is stable beside the last token of
    the prefix before it. So the table grows a byte at a time, whatever comes later, and the encoding of any prefix
    is read off backwards.
    """

    __slots__ = ("coder", "data", "last")

    def __init__(self, coder: PrefixEncoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        self.extend(data)

    def extend(self, more: bytes) -> PrefixTable:
        """Append bytes; nothing known about the earlier prefixes changes."""
        ranks, stable, longest = self.coder.ranks, self.coder.stable, self.coder.longest
        data, last, done = self.data + more, self.last, len(self.data)
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and stable(last[start], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.data = data
        return self

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes, of all by default."""
        out, at = [], len(self.data) if length is None else length
        while at:
            out.append(self.last[at])
            at -= len(self.coder.tokens[self.last[at]])
        return out[::-1]


class PrefixEncoder:
    """Byte-level byte-pair encoding by prefix tables, without special tokens."""

    #: Entries kept of known pieces and pairs; when full they are dropped and filled anew. Only speed depends on it.
    KNOWN = 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the definition: join the adjacent pair of lowest rank, leftmost first, as long as there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank > len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stable(self, before: int, token: int) -> bool:
        """Whether ``token`` stays as it is right after ``before`` (-1: at the start)."""
        known = self._pairs.get((before, token))
        if known is None:
            if len(self._pairs) >= self.KNOWN:
                self._pairs.clear()
            if before < 0:
                known = self.merged(self.tokens[token]) == [token]
            else:
                known = self.merged(self.tokens[before] + self.tokens[token]) == [before, token]
            self._pairs[before, token] = known
        return known

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece."""
        ids = self._pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None and self.stable(-1, whole) else PrefixTable(self, data).ids()
            if len(piece) <= 64:
                if len(self._pieces) >= self.KNOWN:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text; an empty one has none."""
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.piece(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8")


class EncodedText:
    """An encoded text that can be appended to and edited; only pieces near the change are encoded anew."""

    def __init__(self, coder: PrefixEncoder, text: str = ""):
        self.coder, self.text, self.starts, self._ids = coder, "", [], []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        """The ids of the whole text as it is now."""
        return [i for piece in self._ids for i in piece]

    def append(self, more: str) -> int:
        """Add to the end; -> number of pieces encoded anew."""
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of ``text[start:end]``; -> number of pieces encoded anew."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("not a span of the text")
        old, shift = self.starts, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        ends = [*old[1:], len(self.text) - shift]
        # a piece before the edit stands if neither it nor what it had to look at reaches the edit
        keep = bisect_left(old, start)
        while keep and (ends[keep - 1] >= start or old[keep - 1] + LOOK > start):
            keep -= 1
        rest = bisect_left(old, end)
        fresh, ids = [], []
        for m in self.coder.pattern.finditer(self.text, old[keep] if keep < len(old) else (ends[-1] if keep and ends else 0)):
            at = m.start() - shift
            while rest < len(old) and old[rest] < at:
                rest += 1
            if at >= end and rest < len(old) and old[rest] == at:
                break
            fresh.append(m.start())
            ids.append(self.coder.piece(m.group()))
        else:
            rest = len(old)
        self.starts = old[:keep] + fresh + [s + shift for s in old[rest:]]
        self._ids = self._ids[:keep] + ids + self._ids[rest:]
        return len(fresh)


def encode_corpus(documents: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(``key``, ids): the token ids of every row's text; an empty or null text has an empty list.

    ``vocabulary`` is a rank file; the driver reads it and broadcasts its ranks (a fixed 50,000 entries, whatever the
    corpus). No shuffle: batches stream through Arrow, each worker keeps the ids of pieces it has met. Repeated rows
    give a row each, texts of any length are encoded whole, an empty table gives no rows.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixEncoder(ranks.value)
        for batch in batches:
            ids = [coder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.fromiter((x for i in ids for x in i), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
