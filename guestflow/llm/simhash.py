"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import stored, text_slices
from guestflow.llm.components import connected_components

SEED = 42
#: Rows compared at once, and rows of a group that one task compares.
TILE, CELL = 1024, 16384
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, shingle: int = 3) -> int:
    """Majority bits over the XXH64 (seed 42) of the word shingles; 0 without words."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in
                  zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):
        part = h[lo:lo + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit form of each whole text's SimHash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            fp = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each row's component, for links i-j between rows 0..n-1."""
    lab = np.arange(n)
    while True:
        low, old = np.minimum(lab[i], lab[j]), lab.copy()
        np.minimum.at(lab, old[i], low)
        np.minimum.at(lab, old[j], low)
        while (lab[lab] != lab).any():
            lab = lab[lab]
        if (lab == old).all():
            return lab


def tile_links(fp: np.ndarray, radius: int) -> np.ndarray:
    """Component label of every fingerprint of one cell, from exact tiled comparison.

    Rows are sorted by population count; a pair of tiles whose counts differ by
    more than the radius holds no link (each differing bit changes the count by
    one) and is skipped. Others are compared whole with exclusive-or and bit
    counts. Each tile pair keeps a spanning forest of its links, so a dense
    group costs links in proportion to its rows."""
    pop = np.bitwise_count(fp)
    order = np.argsort(pop, kind="stable")
    f, p, n = fp[order], pop[order].astype(np.int16), len(fp)
    keep_i, keep_j = [], []
    for a in range(0, n, TILE):
        x, top = f[a:a + TILE], int(p[min(a + TILE, n) - 1])
        for b in range(a, n, TILE):
            if int(p[b]) - top > radius:
                break
            y = f[b:b + TILE]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if b == a:
                up = i < j
                i, j = i[up], j[up]
            if not len(i):
                continue
            j = j + (b - a)
            rows = np.unique(np.concatenate((i, j)))
            lab = stars(len(rows), np.searchsorted(rows, i), np.searchsorted(rows, j))
            moved = lab != np.arange(len(rows))
            keep_i.append(rows[moved] + a)
            keep_j.append(rows[lab[moved]] + a)
    lab = np.arange(n)
    if keep_i:
        lab = stars(n, np.concatenate(keep_i), np.concatenate(keep_j))
    out = np.empty(n, np.int64)
    out[order] = order[lab]
    return out


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of blocks - radius blocks of the 64 bits.

    Two fingerprints within the radius agree on at least that many whole blocks,
    so they agree under one of the masks."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    out = [sum(c) for c in combinations(bits, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def simhash_links(reps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """Links (a, b) that connect all representatives ``reps(fp, rep)`` within the radius.

    Comparing all tiles of the corpus with each other would grow with its
    square, so the tiles are dealt out first: rows meet where they agree under
    one of ``masks``, which loses no pair. A group beyond CELL rows is split by
    a hash into parts, and every pair of parts becomes a cell of its own task."""
    ms = masks(radius, blocks)
    keyed = (reps.where("rep is not null")
             .withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                  for k, m in enumerate(ms)])))
             .select("m.way", "m.key", "fp", "rep"))
    hot = (keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
           .select("way", "key", F.ceil(F.col("n") / CELL).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    cells = (keyed.join(hot, ["way", "key"], "left").withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
             .select("way", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", "rep"))
    cells = cells.repartition("way", "key", "p", "q").sortWithinPartitions("way", "key", "p", "q")
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(tables: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(tables)
            fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            fp, first = np.unique(fp, return_index=True)
            rep = rep[first]
            lab = tile_links(fp, radius)
            moved = lab != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[lab[moved]])], ["a", "b"])

        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            # whole cells only: the last cell of a batch may go on in the next
            key = [b.column(c).to_numpy() for c in ("way", "key", "p", "q")]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            last = 0
            if held and b.num_rows and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in ("way", "key", "p", "q")):
                cut = np.concatenate(([0], cut))
            for c in cut.tolist():
                if rows + c - last >= TILE:
                    yield linked([*held, pa.Table.from_batches([b.slice(last, c - last)])])
                    held, rows, last = [], 0, c
            if last < b.num_rows:
                held.append(pa.Table.from_batches([b.slice(last)]))
                rows += b.num_rows - last
        if held:
            yield linked(held)

    return cells.mapInArrow(run, f"a {kind}, b {kind}")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): groups of documents linked within ``radius`` bits.

    Null and empty texts, and texts without words, have fingerprint zero and
    link like any other. Equal fingerprints are one node, so copies cost nothing
    beyond a map-side minimum. component_id is the smallest doc_id reachable.
    Rows with a null doc_id take the group of their fingerprint (null when no
    other row has it). Repeated rows stay, an empty table gives no rows, and
    other columns of ``docs`` are not read. ``blocks`` trades copies of the
    fingerprints against comparisons: 4 gives 4 copies and groups of about
    n / 65,536; 6 gives 20 copies and n / 2^32 for very large corpora."""
    fps = stored(fingerprints(docs, shingle), "simhash")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(simhash_links(reps, radius, blocks))
    named = reps.join(roots, reps["rep"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates_removed(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the group.

    Rows with a null doc_id stay. Of repeated rows with the group's id all stay."""
    groups = simhash_components(docs, shingle, radius)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
