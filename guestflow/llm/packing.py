"""Best-fit packing of tokenised documents with swap-based local search."""
from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import stored, text_slices

#: Pieces packed together by one task.
GROUP_ROWS = 20_000
#: Entries of the younger generation of a task's table of encoded words.
CACHE = 300_000
_SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž0-9!-&(-/:-@\[-`{-~ \n]+")
_PIECES = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Recent(dict):
    """A bounded table: when it is full its entries become the elder generation,
    from which those still in use come back; the rest go with the next change."""

    def __init__(self, size: int, make):
        self.size, self.make, self.elder = size, make, {}

    def __missing__(self, key: str) -> bytes:
        v = self.elder.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.size:
            self.elder = dict(self)
            self.clear()
        self[key] = v
        return v


class WordEncoder:
    """Token ids of whole texts from ids of their words, exactly as the tokenizer's.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    so a text's ids are those of its space-separated chunks in turn. Texts of
    plain Latin letters, digits and marks (already in composed form, without an
    apostrophe or a special token) are lower-cased as a whole; their chunks are
    cut at the pre-tokenizer's own borders and the pieces merged by the
    tokenizer's model. The chunks of any other text go to the tokenizer as they
    are. All tables are bounded."""

    def __init__(self, path: str | None):
        self.tokenizer, self.symbols = _tokenizer(path), byte_symbols()
        self.merge = self.tokenizer.model.tokenize
        self.plain = Recent(CACHE, self._chunk)
        self.other = Recent(CACHE // 8, self._whole)

    def _whole(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, p: str) -> bytes:
        if not p.isascii():
            p = p.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.merge(p)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if word and len(word) < len(chunk):
            return self.plain[word] + self.plain[chunk[len(word):]]
        if word.isalpha() or not word:
            return self._piece(chunk) if chunk else b""
        return b"".join(map(self.plain.__getitem__, pieces)) if len(pieces := _PIECES.findall(chunk)) > 1 else self._piece(chunk)

    def close(self) -> None:
        """Empty the tables (they and the encoder refer to each other)."""
        for t in (self.plain, self.other):
            t.clear()
            t.elder = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.plain.__getitem__, text.lower().replace("\n", " ").split(" ")))
        return b"".join(map(self.other.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def _tokenizer(path: str | None):
    """The tokenizer, read once per worker; the word tables live as long as a task,
    so that idle workers hold no memory that other stages need."""
    from tokenizers import Tokenizer
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids plus end_id, cut at capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer_path)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in text_slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for r, t in enumerate(b.column("text").to_pylist()):
                ids = enc.encode(t or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    row.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.close()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = defaultdict(list)
    spaces: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        k = bisect_left(spaces, n)
        if k < len(spaces):
            s = spaces[k]
            b = by_space[s].pop()
            if not by_space[s]:
                spaces.pop(k)
            bins[b].append(i)
            s -= n
        else:
            b, s = len(bins), capacity - n
            bins.append([i])
        if s > 0:
            if not by_space[s]:
                insort(spaces, s)
            by_space[s].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges with fuller ones.

    Each pass attacks every underfull bin, emptiest first: one or two of its
    pieces go into a fuller bin, for none or for one of that bin's, by the step
    of largest gain, until no step is left. The fuller bin always gains, which
    raises the sum of squared fills, so the search ends: at the least possible
    number of bins, or when a whole pass finds every bin stuck. Bins are indexed
    by the sizes they hold, each with its largest space, so that a step looks at
    sizes, not at bins."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    left, least = sum(map(bool, bins)), -(-sum(fill) // capacity)
    moved = True
    while moved and left > least:
        moved = False
        spaces = _Spaces(bins, lengths, fill, capacity)
        queue = [(fill[b], b) for b in range(len(bins)) if bins[b] and fill[b] < capacity]
        heapify(queue)
        while queue and left > least:
            f, source = heappop(queue)
            if f != fill[source]:
                if fill[source] < capacity:
                    heappush(queue, (fill[source], source))
                continue
            spaces.drop(source)
            while bins[source] and (step := _step({lengths[i] for i in bins[source]}, bins[source], lengths, spaces.most)):
                out, s = step
                dst = spaces.bin(s)
                back = [next(i for i in bins[dst] if lengths[i] == s)] if s else []
                out = [_take(bins[source], lengths, n) for n in out]
                for i in back:
                    bins[dst].remove(i)
                spaces.drop(dst, back)
                gain = sum(lengths[i] for i in out) - s
                bins[dst] += out
                bins[source] += back
                fill[dst] += gain
                fill[source] -= gain
                spaces.add(dst)
                moved = True
            left -= not bins[source]
    return [b for b in bins if b]


def _take(members: list[int], lengths: list[int], n: int) -> int:
    return members.pop(next(k for k, i in enumerate(members) if lengths[i] == n))


class _Spaces:
    """For every size (0 for none) the largest space of the open bins that hold it."""

    def __init__(self, bins: list[list[int]], lengths: list[int], fill: list[int], capacity: int):
        self.bins, self.lengths, self.fill, self.capacity = bins, lengths, fill, capacity
        self.heaps: dict[int, list] = defaultdict(list)
        self.stamp = [0] * len(bins)
        self.most = np.zeros(capacity + 1, np.int64)
        for b in range(len(bins)):
            if bins[b]:
                self.add(b)

    def add(self, b: int) -> None:
        space = self.capacity - self.fill[b]
        if space > 0:
            for s in {0, *(self.lengths[i] for i in self.bins[b])}:
                heappush(self.heaps[s], (-space, b, self.stamp[b]))
                self.most[s] = max(self.most[s], space)

    def drop(self, b: int, also: list[int] = ()) -> None:
        """Take a bin out (``also``: pieces it held until now)."""
        self.stamp[b] += 1
        for s in {0, *(self.lengths[i] for i in self.bins[b]), *(self.lengths[i] for i in also)}:
            heap = self.heaps[s]
            while heap and heap[0][2] != self.stamp[heap[0][1]]:
                heappop(heap)
            self.most[s] = -heap[0][0] if heap else 0

    def bin(self, s: int) -> int:
        return self.heaps[s][0][1]


def _step(sizes: set[int], mine: list[int], lengths: list[int], most: np.ndarray) -> tuple[tuple[int, ...], int] | None:
    """The sizes to give and the size to get (0 for none) of the largest gain."""
    u = np.array(sorted(sizes))
    twice = {n for n, k in Counter(lengths[i] for i in mine).items() if k > 1}
    first, second = np.triu_indices(len(u))
    ok = (first != second) | np.isin(u[first], list(twice))
    sums = np.concatenate([u, u[first[ok]] + u[second[ok]]])
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    got = np.flatnonzero(most)
    at = np.searchsorted(ranked, got + most[got], "right") - 1
    gain = np.where(at >= 0, ranked[at] - got, 0)
    if not len(gain) or gain.max() <= 0:
        return None
    k = int(gain.argmax())
    pick = int(order[at[k]])
    if pick < len(u):
        return (int(u[pick]),), int(got[k])
    pair = np.flatnonzero(ok)[pick - len(u)]
    return (int(u[first[pair]]), int(u[second[pair]])), int(got[k])


def _pack_group(capacity: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        seq, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], offset[i] = ((int(key[0]) << 24) + b) * 2 + level, at
                at += lengths[i]
            fill[members] = at
        return pdf.assign(sequence_id=seq, offset=offset, fill=fill)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]
    return run


def _packed(df: DataFrame, rows: int, capacity: int, level: int) -> DataFrame:
    groups = max(1, -(-rows // GROUP_ROWS))
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
              "sequence_id bigint, offset bigint, fill bigint")
    # the row's number spreads equal rows
    row = F.monotonically_increasing_id()
    return (df.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", row), F.lit(groups)))
            .groupBy("g").applyInPandas(_pack_group(capacity, level), schema))


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and place in it.

    Null text counts as empty: such a document is the one id ``end_id``. Pieces
    are dealt by hash into groups of about GROUP_ROWS; each group is packed by
    best fit and improved by local search. What a group leaves underfull (a few
    bins) is packed once more across groups. Bounded memory at any size: a task
    holds one group's lengths. Repeated rows are packed each; an empty table
    gives no rows; other columns are not read."""
    parts = stored(pieces(docs, capacity, end_id, tokenizer_path), "pieces")
    first = stored(_packed(parts, parts.count(), capacity, 0), "packed")
    loose = first.where(F.col("fill") < capacity)
    again = _packed(loose.drop("sequence_id", "offset", "fill"), loose.count(), capacity, 1)
    return first.where(F.col("fill") >= capacity).unionByName(again).drop("fill")
