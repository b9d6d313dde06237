"""Substring dedup: words covered by 20-word windows that also occur earlier."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import stored, text_key, text_slices
from guestflow.llm.manifest import numbered

#: Words of the prefix that groups suffixes, and bytes kept of a window's hash
#: beside the 64-bit hash of its group's prefix.
PREFIX, KEPT = 8, 5
#: Windows of a group; larger groups are split by further bits of the windows' hashes.
GROUP_WINDOWS = 200_000
_M = 0xFF51AFD7ED558CCD


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and the ASCII control blanks 09-0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHash(dict):
    """Word to 64-bit hash; a full table is started anew."""

    def __missing__(self, w: bytes) -> int:
        import xxhash
        if len(self) >= 600_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w, 7)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_M)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def path_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, by doubling (length len(w) - k + 1)."""
    base, out, power, done = np.uint64(0x9E3779B97F4A7C15), None, np.uint64(1), 0
    part, size, mult = w, 1, base
    while True:
        if k & size:
            out = part if out is None else _join(out, done, part, mult)
            done += size
        if 2 * size > k:
            return out[:len(w) - k + 1]
        part = _join(part, size, part, mult)
        mult, size = mult * mult, 2 * size


def _join(left: np.ndarray, n: int, right: np.ndarray, mult: np.uint64) -> np.ndarray:
    m = len(right) - n
    return left[:m] * mult + right[n:n + m]


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    size, m = 1, h
    while 2 * size <= k:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = k - size
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def _first(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows already in (doc, at) order: index of each key's first row, and
    whether the row is that place."""
    key = keys[0] if len(keys) == 1 else _mix(keys[0] * np.uint64(_M) + keys[1])
    _, first, inv = np.unique(key, return_index=True, return_inverse=True)
    lead = first[inv]
    return lead, (doc == doc[lead]) & (at == at[lead])


def _runs(*breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, given where a new run begins (True)."""
    start = np.flatnonzero(np.logical_or.reduce(breaks))
    return start, np.diff(np.append(start, len(breaks[0])))


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, start, n): runs of window starts whose word sequence starts earlier too.

    The windows are the paths of depth ``window`` in the tree of all word
    suffixes: a path shared by two suffixes is a deep internal node, and all its
    leaves but the smallest are repeats. Whole suffixes would ship each word
    ``window`` times, so the tree is cut up by prefix: a window's group is the
    smallest hash among its own PREFIX-word pieces. Equal windows always fall
    into one group, neighbouring windows mostly share one, and a run of
    neighbours ships one prefix and KEPT bytes per window. Inside a task the
    repeats of a slice are settled before the shuffle, so a passage copied into
    a third of all documents sends one row per slice, not one per copy. A short
    phrase with different words around it has different windows in one group:
    groups are counted first, and those beyond GROUP_WINDOWS split by the windows'
    own hashes, which keeps equal windows together."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = dealt_windows(docs, window).repartition("prefix").sortWithinPartitions("prefix", "doc_id", "start")
    return dealt.mapInArrow(_subtree, f"doc_id {kind}, start int, n int")


def dealt_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(kind, prefix, doc_id, start, n, paths): runs of windows under their group's prefix."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    counted = docs.mapInArrow(_slice_counts(window), "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    large = counted.where(F.col("n") > GROUP_WINDOWS).toPandas().sort_values("key")
    split = large["key"].to_numpy(np.int32), -(-large["n"].to_numpy(np.int64) // GROUP_WINDOWS)
    shared = docs.sparkSession.sparkContext.broadcast(split)
    return docs.mapInArrow(_slice_paths(window, shared), f"kind int, prefix bigint, doc_id {kind}, start int, n int, paths binary")


def _key(low: np.ndarray) -> np.ndarray:
    """The bits of a prefix under which its windows are counted."""
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _split(low: np.ndarray, paths: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Prefixes, with those of large groups made longer by bits of the window's hash
    that are not kept beside it."""
    if not len(keys):
        return low
    key = _key(low)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    large = np.flatnonzero(keys[at] == key)
    out = low.copy()
    with np.errstate(over="ignore"):
        sub = (paths[large] >> np.uint64(8 * KEPT)) % parts[at[large]].astype(np.uint64)
        out[large] = _mix(low[large] + sub * np.uint64(_M))
    return out


def _slice_counts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, low, _, _, once in _slices(batches, window):
            key, n = np.unique(_key(low[once]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])
    return run


def _slice_paths(window: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, at, low, paths, own, once in _slices(batches, window):
            yield from _emit(1, np.zeros(0, np.uint64), doc, at, ~own, None)
            yield from _emit(0, _split(low, paths, *shared.value), doc, at, once, paths)
    return run


def _slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of each slice: place, prefix, path, whether it is its path's first
    place, and whether it is to be dealt."""
    table = WordHash()
    for b in text_slices(batches):
        b = b.take(pc.sort_indices(b.column("doc_id")))
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        words, sizes = [], []
        for t in b.column("text").to_pylist():
            ws = words_of(t)
            if len(ws) >= window:
                words += map(table.__getitem__, ws)
            sizes.append(len(ws) if len(ws) >= window else 0)
        sizes = np.array(sizes)
        if not sizes.sum():
            continue
        with np.errstate(over="ignore"):
            w = np.array(words, np.uint64)
            paths = _mix(path_hashes(w, window))
            low = _sliding_min(_mix(path_hashes(w, PREFIX)), window - PREFIX + 1)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)[:len(paths)]
        at = (np.arange(len(paths)) - (ends - sizes)[row]).astype(np.int32)
        inside = at <= sizes[row] - window
        paths, low, row, at = paths[inside], low[inside], row[inside], at[inside]
        doc = ids[row]
        lead, own = _first([paths], doc, at)
        yield doc, at, low, paths, own, own & (lead == np.arange(len(lead)))


def _emit(kind: int, low, doc, at, keep, paths) -> Iterator[pa.RecordBatch]:
    idx = np.flatnonzero(keep)
    if not len(idx):
        return
    d, s = doc[idx], at[idx]
    brk = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)))
    if kind == 0:
        p = low[idx]
        brk[1:] |= p[1:] != p[:-1]
    start, n = _runs(brk)
    if kind == 0:
        raw = paths[idx].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]
        off = np.append(start, len(idx)) * KEPT
        body = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off.astype(np.int32).tobytes()),
                                                               pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
        prefix = p[start].view(np.int64)
    else:
        # settled already: dealt anywhere, passed through
        body = pa.nulls(len(start), pa.binary())
        prefix = (d[start].astype(np.int64) * 31 + s[start])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(start), kind, np.int32)), pa.array(prefix), pa.array(d[start]), pa.array(s[start].astype(np.int32)),
         pa.array(n.astype(np.int32)), body], ["kind", "prefix", "doc_id", "start", "n", "paths"])


def _subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (prefix, doc_id, start) order: every path's first leaf stays, the others go out.

    Only the paths of the last prefix of a batch are held for the next batch."""
    held_prefix, held = None, None
    for b in batches:
        settled = b.filter(pc.equal(b.column("kind"), 1))
        if settled.num_rows:
            yield settled.select(["doc_id", "start", "n"])
        b = b.filter(pc.equal(b.column("kind"), 0))
        if not b.num_rows:
            continue
        n = b.column("n").to_numpy()
        prefix = np.repeat(b.column("prefix").to_numpy().view(np.uint64), n)
        doc = np.repeat(b.column("doc_id").to_numpy(), n)
        at = np.repeat(b.column("start").to_numpy(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        body = pa.concat_arrays([b.column("paths")]).cast(pa.large_binary())
        raw = np.frombuffer(b"".join(body.to_pylist()), np.uint8).reshape(-1, KEPT)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :KEPT] = raw
        path = wide.view("<u8")[:, 0]
        with np.errstate(over="ignore"):
            lead, own = _first([prefix, path], doc, at)
        if held is not None and prefix[0] == held_prefix:
            # a path already seen: repeated unless it is the very same place
            here = np.flatnonzero(prefix == held_prefix)
            k = np.minimum(np.searchsorted(held[0], path[here]), len(held[0]) - 1)
            seen = held[0][k] == path[here]
            same = (held[1][k] == doc[here]) & (held[2][k] == at[here])
            own[here[seen]] = same[seen]
        else:
            held = None
        tail = np.flatnonzero(prefix == prefix[-1])
        kept = [x[tail] for x in (path, doc, at)]
        if held is not None and prefix[-1] == held_prefix:
            kept = [np.concatenate(x) for x in zip(held, kept)]
        first = np.unique(kept[0], return_index=True)[1]
        held_prefix, held = prefix[-1], [x[first] for x in kept]
        for out in _emit(1, None, doc, at, ~own, None):
            yield out.select(["doc_id", "start", "n"])


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, place, text): ``place`` numbers the documents in their order.

    It is the doc_id itself, unless some doc_id has several texts: then each of its
    texts is a document of its own, by text key, and (doc_id, text key) pairs are
    numbered in that order (range-partitioned, counts per partition added up)."""
    rows = docs.select("doc_id", "text", text_key().alias("of"))
    several = (rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("of").alias("low"), F.max("of").alias("high"))
               .where("low <> high"))
    if several.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("place"), "text")
    pairs = rows.where("doc_id is not null").select(F.lit("").alias("tree"), "doc_id", "of").distinct()
    order = stored(numbered(stored(pairs, "places"), ["doc_id", "of"], "places"), "places").select(
        F.col("doc_id").alias("_id"), F.col("of").alias("_of"), F.col("pos").alias("place"))
    return rows.join(order, (F.col("doc_id") == F.col("_id")) & (F.col("of") == F.col("_of")), "left").select("doc_id", "place", "text")


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: in a smaller doc_id, or earlier in the same document. Windows are
    judged on the input. Null and empty texts have no words. Rows that repeat a
    doc_id and its text are one document, none is earlier than the other, and each
    gets the same result; rows that repeat a doc_id with another text are documents of
    their own (``placed``). Rows with a null doc_id keep all their words. An empty
    table gives no rows, and other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = placed(docs)
    gone = (repeated_windows(docs.select(F.col("place").alias("doc_id"), "text"), window).withColumnRenamed("doc_id", "place").groupBy("place")
            .agg(F.collect_list(F.struct("start", "n")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            n_words, n_removed, kept = [], [], []
            runs = b.column("runs")
            for r, text in enumerate(b.column("text").to_pylist()):
                ws, cover = words_of(text), runs[r].as_py()
                n_words.append(len(ws))
                if cover:
                    edge = np.zeros(len(ws) + 1, np.int32)
                    np.add.at(edge, [x["start"] for x in cover], 1)
                    np.add.at(edge, [min(len(ws), x["start"] + x["n"] + window - 1) for x in cover], -1)
                    stay = (np.cumsum(edge[:-1]) == 0).tolist()
                    ws = [w for w, s in zip(ws, stay) if s]
                n_removed.append(n_words[-1] - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return (docs.join(gone, "place", "left")
            .mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string"))

