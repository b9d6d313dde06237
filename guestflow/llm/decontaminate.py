"""Benchmark decontamination by a broadcast set of test-item word windows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import text_key, text_slices, without

#: Words of benchmark text indexed and broadcast at once; a larger benchmark is
#: scanned in several such blocks, one broadcast each.
BLOCK_WORDS = 2_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WindowIndex:
    """The windows of one benchmark block: a word table, and per window length a
    sorted array of rolling hashes with the exact windows behind them."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, n: int):
        self.n, self.vocab, self.windows = n, {}, {}

    def add(self, item: str, words: list[bytes]) -> None:
        ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words)
        k = min(self.n, len(ids))
        for i in range(len(ids) - k + 1 if ids else 0):
            self.windows.setdefault(k, {}).setdefault(ids[i:i + k], set()).add(item)

    def freeze(self) -> "WindowIndex":
        self.hashes = {k: np.unique(np.array([self.rolling(np.array(w, np.uint64), k)[0] for w in ws], np.uint64))
                       for k, ws in self.windows.items()}
        return self

    def rolling(self, ids: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(ids) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                h = h * np.uint64(self.BASE) + ids[i:len(ids) - k + 1 + i]
        return h

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(start, length) of every window occurrence, and the items they belong to."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        spans, items = [], set()
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for k, hs in self.hashes.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            at = at[np.isin(self.rolling(ids, k)[at], hs)]
            for p in at.tolist():
                hit = self.windows[k].get(tuple(ids[p:p + k].tolist()))
                if hit:
                    spans.append((p, k))
                    items |= hit
        return spans, items


def _blocks(benchmark: DataFrame, n: int) -> Iterator[WindowIndex]:
    """Window indexes of at most BLOCK_WORDS words (or one item) each."""
    index, held = WindowIndex(n), 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    for r in rows.toLocalIterator():
        words = item_words(r["text"])
        if held and held + len(words) > BLOCK_WORDS:
            yield index.freeze()
            index, held = WindowIndex(n), 0
        index.add(r["item_id"], words)
        held += len(words)
    yield index.freeze()


_HITS = "hits array<struct<start:int,length:int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, of, n_words, hits, items) of every row: where test windows occur in it
    (``of`` is the key of its text).

    A window is n consecutive words of an item; an item of fewer words, but not
    none, is one window. Null and empty texts have no words and no hits; null
    items and items without words have no windows, repeated items count once. A
    repeated document row gives a row each; an empty table gives none. Every
    scan of the documents reads one bounded broadcast block; the usual benchmark
    is one block."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = "cast(array() as array<struct<start:int,length:int>>) as hits", "cast(array() as array<string>) as items"
    df = docs.select("doc_id", text_key().alias("of"), "text", *map(F.expr, empty))
    blocks = _blocks(benchmark, n)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        text = "text string, " if following is not None else ""
        df = df.mapInArrow(_scan(sc.broadcast(block), bool(text)), f"doc_id {kind}, of bigint, {text}{_HITS}, n_words bigint")
        block, last = following, df
        df = df.drop("n_words")
    return last


def _scan(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in text_slices(batches):
            hits, items, counts = b.column("hits").to_pylist(), b.column("items").to_pylist(), []
            for r, text in enumerate(b.column("text").to_pylist()):
                words = item_words(text)
                spans, found = index.find(words)
                if spans:
                    hits[r] = [*hits[r], *({"start": s, "length": k} for s, k in spans)]
                    items[r] = sorted({*items[r], *found})
                counts.append(len(words))
            out = {"doc_id": b.column("doc_id"), "of": b.column("of")} | ({"text": b.column("text")} if keep_text else {})
            out |= {"hits": pa.array(hits, b.column("hits").type), "items": pa.array(items, b.column("items").type),
                    "n_words": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def n_hit():
    """Distinct words covered by the hits: total length of their merged spans."""
    ordered = F.array_sort("hits")
    covered = F.aggregate(
        ordered, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(s["end"], h["start"].cast("bigint")))).cast("bigint").alias("n"),
            F.greatest(s["end"], (h["start"] + h["length"]).cast("bigint")).alias("end")))
    return covered["n"]


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """Per document the counts and the rule: contaminated if 1 word in ``share`` or more is hit."""
    found = contamination(docs, benchmark, n).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits", "items", "of")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without its contaminated documents; all others stay as they are. Null and
    repeated ids are told apart by their texts."""
    return without(docs, report(docs, benchmark, n, share).where("contaminated"))
