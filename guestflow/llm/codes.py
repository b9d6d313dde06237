"""Product codes of vectors: codebooks trained and searched by Orchard's algorithm."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestflow.llm.common import stored

#: Parts of a vector, entries per part's codebook, training rounds, steps per unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components beyond this count as this, so that squared distances stay exact.
LIMIT = 1 << 21
#: Vectors searched at once in a task, and neighbours looked at per step.
BATCH, STEP = 16_384, 8
#: Labels up to which their sums are broadcast, and salts of the join beyond.
FEW_LABELS, SALTS = 100_000, 16


class Orchard:
    """Nearest entries of one codebook (entries x width, integers).

    For every entry the others stand in a list sorted by distance from it. A search
    walks the list of its best entry so far, skips entries it has visited, jumps to
    the list of an entry that is nearer (or as near with a lower index), and ends
    where the list is farther than twice the best distance: what lies beyond is
    farther than the best. Exact; all vectors of a batch take their steps together,
    STEP neighbours at a time."""

    def __init__(self, book: np.ndarray):
        self.book, self.size = book.astype(np.float64), len(book)
        gaps = ((self.book[:, None, :] - self.book[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(gaps, -1)  # an entry heads its own list
        order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.lists, self.gaps = order, np.take_along_axis(gaps, order, axis=1)
        axis = self.book.std(0) if self.size else np.zeros(book.shape[1])
        self.axis = axis
        self.along = np.argsort(self.book @ axis, kind="stable")
        self.marks = (self.book @ axis)[self.along]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each vector's nearest entry; ties go to the lower index."""
        q = q.astype(np.float64)
        n, k = len(q), self.size
        every = np.arange(n)
        best = self.along[np.minimum(np.searchsorted(self.marks, q @ self.axis), k - 1)]  # any start gives the same end
        dist = ((q - self.book[best]) ** 2).sum(1).astype(np.int64)
        visited = np.zeros((n, k), bool)
        visited[every, best] = True
        cursor, active = np.zeros(n, np.int64), every if k > 1 else every[:0]
        while len(active):
            here = cursor[active, None] + np.arange(STEP)
            entry = self.lists[best[active, None], np.minimum(here, k - 2)]
            near = (here < k - 1) & (self.gaps[best[active, None], np.minimum(here, k - 2)] <= 4 * dist[active, None])
            row, col = np.nonzero(near & ~visited[active[:, None], entry])
            found = entry[row, col]
            visited[active[row], found] = True
            rank = np.full(entry.shape, np.iinfo(np.int64).max)
            rank[row, col] = ((q[active[row]] - self.book[found]) ** 2).sum(1).astype(np.int64) * k + found
            low = rank.min(1)
            jump = low < dist[active] * k + best[active]
            to = active[jump]
            dist[to], best[to] = low[jump] // k, low[jump] % k
            cursor[active] = np.where(jump, 0, cursor[active] + STEP)
            active = active[jump | near.all(1)]
        return best, dist


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def integers(lists: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, rows x width; shorter vectors end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)
    if (sizes == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = whole
    return out


def batches_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            part = b.slice(lo, BATCH)
            yield part, integers(part.column("v"), width)


def first_books(kept: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The smallest kept vec_ids' parts, ascending: parts x entries x width of a part."""
    rows = kept.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()  # entries rows
    ints = integers(pa.array([r[0] for r in rows], pa.list_(pa.float64())), width)
    return ints.reshape(len(rows), parts, width // parts).swapaxes(0, 1)


def trained(kept: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` of assigning all parts and averaging them.

    A task sends one sum and count per entry component, so what meets and what the
    driver reads is bounded by the codebooks' size per task and in all."""
    parts, size, width = books.shape
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            search = [Orchard(b) for b in books]
            count, total = np.zeros((parts, size), np.int64), np.zeros(books.shape, np.int64)
            for _, x in batches_of(batches, parts * width):
                for p in range(parts):
                    mine = x[:, p * width:(p + 1) * width]
                    code, _ = search[p].nearest(mine)
                    count[p] += np.bincount(code, minlength=size)
                    np.add.at(total[p], code, mine)
            p, e, c = (a.ravel() for a in np.indices(books.shape))
            seen = count[p, e] > 0
            if seen.any():
                yield pa.record_batch([pa.array(a[seen], pa.int64()) for a in (p, e, c, count[p, e], total[p, e, c])], names=["p", "e", "c", "n", "s"])

        if not size:
            return books
        found = kept.mapInArrow(sums, "p long, e long, c long, n long, s long").groupBy("p", "e", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in found.collect():  # one row per component of a codebook at most
            books[r["p"], r["e"], r["c"]] = r["s"] // r["n"]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector."""
    parts, _, width = books.shape
    hexes = np.array([f"{i:02x}" for i in range(256)])
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(b) for b in books]
        for b, x in batches_of(batches, parts * width):
            found = [search[p].nearest(x[:, p * width:(p + 1) * width]) for p in range(parts)]
            text = hexes[np.stack([c for c, _ in found], 1)]
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(["".join(t) for t in text], pa.string()),
                                   pa.array(sum(d for _, d in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(codes, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels (nulls together).

    The sums go out by broadcast if they are at most FEW_LABELS rows; else each is
    copied to SALTS salts and the rows, dealt by label and salt, meet their copy."""
    sums = stored(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = sums.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")), "left").drop("l", "s", "salt")


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    Rows whose vector is null or holds null or non-finite components go. Components
    become floor(SCALE * x), those beyond LIMIT count as LIMIT. The width is the
    longest vector's, up to a multiple of ``parts``; shorter vectors count as ending
    in zeros (a table of empty ones as one zero per part). Of equal vec_ids the
    smaller vector comes first among the starting entries; null vec_ids are coded but
    give none, and without any vec_id the books are one zero entry. With fewer
    vectors than ``entries`` there are as many entries as vectors. No usable row: no
    result. ``entries`` is at most 256. Other columns are ignored."""
    kept = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = first_books(kept, width, parts, entries)
    if not books.shape[1]:
        books = np.zeros((parts, 1, width // parts), np.int64)
    books = trained(kept, books, rounds)
    rows = stored(encoded(kept, books), "codes")
    return with_label_error(rows).withColumn("codebooks_sha256", F.lit(books_digest(books)))
