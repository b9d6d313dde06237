"""Quality by Bradley-Terry ranking learned from preference pairs."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import slots, stored, text_slices
from guestflow.llm.learning import held_out, learnable

#: Labelled rows are compared in blocks of about so many, every good one with every
#: bad one; of the rarer class a block has about MATES or more.
BLOCK, MATES = 1024, 64
#: Ranks of the knots are right to one in so many rows.
ACCURACY = 10_000
_SENTENCE = re.compile(rb"[.!?]\s")
BASE = ("log_chars", "word_length", "word_length_spread", "capitals", "digits", "marks", "odd_marks", "bars", "exclamations",
        "full_stops", "commas", "distinct_words", "top_word", "top_line", "line_words", "sentence_words", "mark_words",
        "short_words", "repeated_pairs", "upper_words")


def features(text: str | None) -> list[float]:
    """Dense features of the whole text (see BASE): lengths, character classes,
    repetition of words, pairs and lines, and line and sentence shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8)
    words, lines = raw.split(), raw.split(b"\n")
    n, chars = max(len(words), 1), max(len(a), 1)
    kinds = np.bincount(a, minlength=256)
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    letters = upper + lower + kinds[128:].sum()
    marks = chars - letters - digits - kinds[9:14].sum() - kinds[32]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    odd = sum(int(kinds[ord(c)]) for c in "#$%&*|<>{}[]=+~^@\\/_")
    return [float(np.log1p(len(a))), float(lengths.mean()), float(lengths.std()), upper / max(letters, 1), digits / chars, marks / chars,
            odd / chars, kinds[124] / n, kinds[33] / n, kinds[46] / n, kinds[44] / n, len(counts) / n,
            max(counts.values(), default=0) / n, max(Counter(lines).values()) / len(lines), float(np.log1p(n / len(lines))),
            float(np.log1p(n / (1 + len(_SENTENCE.findall(raw))))), sum(1 for w in counts if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:") / max(len(counts), 1),
            float((lengths <= 2).mean()), pairs / max(len(words) - 1, 1), sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n]


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            x = [[float(v) for v in features(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, x array<double>")


class Ranker:
    """Bradley-Terry strengths: a linear score of standardised features, each also
    by its place among quantile knots, so that a strength may rise and fall."""

    KNOTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

    def __init__(self, mean: np.ndarray, scale: np.ndarray, knots: np.ndarray):
        self.mean, self.scale, self.knots = mean, scale + 1e-9, knots
        self.w = np.zeros(len(mean) * (1 + len(knots)))
        self.cut, self.spread = 0.0, 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, *((x > k).astype(float) for k in self.knots)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.w

    def slopes(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Of the log likelihood that each good row beats each bad one, at these
        strengths: gradient, curvature (row by row) and the number of pairs."""
        g, b = self.expand(good), self.expand(bad)
        p = 1 / (1 + np.exp(-np.clip((g @ self.w)[:, None] - (b @ self.w)[None, :], -30, 30)))
        q, v = 1 - p, p * (1 - p)
        cross = g.T @ (v @ b)
        hess = (g * v.sum(axis=1)[:, None]).T @ g + (b * v.sum(axis=0)[:, None]).T @ b - cross - cross.T
        return np.concatenate([g.T @ q.sum(axis=1) - b.T @ q.sum(axis=0), hess.ravel(), [p.size]])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, at the threshold quantile exactly 0.3."""
        u = 3 * (self.strength(x) - self.cut) / self.spread + np.log(0.3 / 0.7)
        return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of feature lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(BASE))


def _labelled(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, x) of every labelled row that may be learned from. Null labels are
    none; of repeated label rows the largest counts; repeated documents count once
    (of different texts that with the smallest features)."""
    ids = (labels.where(F.col("quality").isNotNull() & learnable(5, 0)).groupBy("doc_id")
           .agg(F.max(F.col("quality").cast("int")).alias("y")))
    once = featured.where(learnable(5, 0)).groupBy("doc_id").agg(F.min("x").alias("x"))
    return once.join(ids, "doc_id").select("doc_id", "y", "x")


def _standardised(rows: DataFrame) -> Ranker:
    """A ranker with mean, spread and knots of all rows and no strengths yet."""
    each = [F.col("x")[i] for i in range(len(BASE))]
    got = rows.agg(F.array(*[F.avg(c) for c in each]).alias("mean"), F.array(*[F.stddev_pop(c) for c in each]).alias("scale"),
                   F.array(*[F.percentile_approx(c, list(Ranker.KNOTS), ACCURACY) for c in each]).alias("knots")).first()
    return Ranker(np.array(got["mean"]), np.array(got["scale"]), np.array(got["knots"]).T)


def _blocks(rows: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """(good, bad): the features of each block's rows of either class, as bytes. A hash
    of the doc_id deals every row to a block; rows of a class too rare to have MATES
    in each go to several, a row of the other class to one."""
    n = -(-(n_bad + n_good) // BLOCK)
    rare, few = (1, n_good) if n_good <= n_bad else (0, n_bad)
    copies = min(n, -(-n * MATES // few))
    own = F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.lit(n))
    turns = F.sequence(F.lit(0), F.when(F.col("y") == rare, copies - 1).otherwise(0))
    dealt = rows.select("doc_id", "y", "x", own.alias("_own"), F.explode(turns).alias("_turn"))
    dealt = dealt.select("doc_id", "y", "x", ((F.col("_own") + F.col("_turn")) % n).alias("block"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("doc_id")
        x, y = np.array(block["x"].tolist(), float), block["y"].to_numpy()
        return pd.DataFrame({"good": [x[y == 1].tobytes()], "bad": [x[y == 0].tobytes()]})

    return dealt.groupBy("block").applyInPandas(pack, "good binary, bad binary")


def _fit(ranker: Ranker, blocks: DataFrame, ridge: float = 1e-2, steps: int = 12) -> None:
    """Newton steps for the logistic loss of the blocks' preference pairs, with a ridge.
    A step is one pass over the blocks; each task sends one sum."""
    d = len(ranker.w)
    for _ in range(steps):
        shared = blocks.sparkSession.sparkContext.broadcast(ranker)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d * d + d + 1)
            for b in batches:
                for good, bad in zip(b.column("good"), b.column("bad"), strict=True):
                    total += shared.value.slopes(*(np.frombuffer(v.as_py()).reshape(-1, len(BASE)) for v in (good, bad)))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        total = sum(np.frombuffer(r["total"]) for r in blocks.mapInArrow(run, "total binary").collect())
        shared.unpersist()
        grad, hess = total[:d] / total[-1] - ridge * ranker.w, total[d:-1].reshape(d, d) / total[-1] + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        ranker.w = ranker.w + step
        if np.abs(step).max() < 1e-6:
            break


def _threshold(ranker: Ranker, rows: DataFrame, n_bad: int, n: int) -> None:
    """The strength quantile of all rows that leaves above it as many as are labelled
    good, exactly: approximate quantiles name a narrow range around it, whose
    strengths are then counted one by one."""
    shared = rows.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.strength(_matrix(b.column("x"))))], ["s"])

    s = stored(rows.select("x").mapInArrow(run, "s double"), "strengths")
    around = [max(0.0, n_bad / n - 10 / ACCURACY), min(1.0, (n_bad + 1) / n + 10 / ACCURACY)]
    seen = s.agg(F.stddev_pop("s").alias("spread"), F.percentile_approx("s", around, ACCURACY).alias("range")).first()
    low, high = seen["range"]
    below = s.where(F.col("s") < low).count()
    near = s.where(F.col("s").between(low, high)).groupBy("s").count().orderBy("s").collect()
    upto = below + np.cumsum([r["count"] for r in near])
    last, next_ = (near[int(np.searchsorted(upto, k))]["s"] for k in (n_bad, n_bad + 1))
    ranker.cut, ranker.spread = float(last + (next_ - last) * (1 - n_bad / n)), float(seen["spread"]) + 1e-9


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Strengths are learned from every labelled row outside the held-out fold: each is
    compared with all rows of the other class in its block (a good before a bad
    document). Mean, spread and knots of the features are those of all these rows; the
    threshold is their exact strength quantile at the share of bad ones; the score is a
    logistic map of the strength that puts the threshold at 0.3. Features are computed
    once per row and stored. Null and empty texts have the features of an empty text.
    Without labelled rows of both classes every score is the share of label 1
    (0 without labels). Repeated rows give a row each, an empty table none;
    other columns are not read."""
    out = [F.col("doc_id"), held_out(5, 0)]
    featured = stored(_featured(docs, ["doc_id"]), "features")
    rows = stored(_labelled(featured, labels), "labelled")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        share = float(next(iter(n), 0))
        return docs.select(*out, F.lit(share).alias("score"), F.lit(int(share >= 0.3)).alias("predicted"))
    ranker = _standardised(rows)
    _fit(ranker, stored(_blocks(rows, n[0], n[1]), "blocks").coalesce(slots(docs)))
    _threshold(ranker, rows, n[0], n[0] + n[1])
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(_matrix(b.column("x"))))], ["doc_id", "score"])

    scored = featured.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(*out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
