"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import stored, text_slices
from guestflow.llm.learning import MAX_ROWS, held_out, labelled_sample

#: Terms of the learned lexicon at most, the documents a term must mark, and
#: the log-odds it must show.
LEXICON, LEAST_DOCS, LEAST_ODDS = 400, 4, 1.5
#: FIXED VALUES: second-person words of the corpus languages, and the usual
#: stand-ins for letters in obfuscated words.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
                          "ihr euch euer sie usted ustedes ti tus vosotros vuestro".split())
STAND_INS = str.maketrans("013457@$!", "oieastasi")
NEAR = 5
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\w]|_")
_REPEAT = re.compile(r"(.)\1{2,}")
FEATURES = ("hits", "hit_density", "weight_density", "distinct_hits", "max_weight", "near_second_person",
            "near_density", "obfuscated_density", "obfuscated_hits", "capitals", "shouted_words", "exclamations",
            "punctuation", "second_person_density", "log_words")


def plain(token: str) -> tuple[str, bool]:
    """A token's bare lower-case word, and whether it was obfuscated: stand-ins
    for letters, marks between letters, or a letter three times in a row."""
    core = _EDGE.sub("", token.lower())
    if core.isalpha() and not _REPEAT.search(core):
        return core, False
    word = _REPEAT.sub(r"\1", _INNER.sub("", core.translate(STAND_INS)))
    if not any(c.isalpha() for c in core):
        return "", False
    return word, word != core


class Tokens(dict):
    """Token to (bare word, obfuscated); a full table is started anew."""

    def __missing__(self, t: str) -> tuple[str, bool]:
        if len(self) >= 400_000:
            self.clear()
        v = self[t] = plain(t)
        return v


class Marks(dict):
    """Token to (lexicon weight, second person, obfuscated), None for plain tokens."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, t: str):
        if len(self) >= 400_000:
            self.clear()
        word, odd = plain(t)
        w, you = self.lexicon.get(word, 0.0), word in SECOND_PERSON
        v = self[t] = (w, you, odd) if w or you or odd else None
        return v


def features(text: str | None, marks: Marks) -> list[float]:
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    found = list(map(marks.__getitem__, tokens))
    special = [(i, m) for i, m in enumerate(found) if m is not None]
    hits = [(i, m) for i, m in special if m[0] > 0]
    you = np.array([i for i, m in special if m[1]])
    near = 0
    if len(you) and hits:
        at = np.array([i for i, _ in hits])
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    upper = ((raw >= 65) & (raw <= 90)).sum()
    letters = upper + ((raw >= 97) & (raw <= 122)).sum()
    marks_ = ((raw > 32) & (raw < 127)).sum() - letters
    per, chars = max(n, 1), max(len(raw), 1)
    weight = sum(m[0] for _, m in hits)
    odd = sum(1 for _, m in special if m[2])
    return [len(hits), len(hits) / per, weight / per, len({round(m[0], 9) for _, m in hits}), max((m[0] for _, m in hits), default=0.0),
            near, near / per, odd / per, sum(1 for _, m in hits if m[2]), upper / max(letters, 1),
            text.count("!!") / per, (raw == 33).sum() / per, marks_ / chars, len(you) / per, float(np.log1p(n))]


def _featured(docs: DataFrame, keep: list[str], lexicon: dict[str, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(shared.value)
        for b in text_slices(batches):
            x = [[float(v) for v in features(t, marks)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, x array<double>")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words that mark toxic documents: smoothed log-odds of their document counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in text_slices(batches):
            seen: dict[str, list[int]] = {}
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                for w in {tokens[x][0] for x in (t or "").split()}:
                    seen.setdefault(w, [0, 0])[y > 0] += 1
            seen.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                                              pa.array([v[0] for v in seen.values()], pa.int64())], ["word", "bad", "good"])

    n = sample.agg(F.sum("y").alias("bad"), F.count("*").alias("all")).first()
    if not n["bad"] or n["bad"] == n["all"]:
        return {}
    counts = sample.select("text", "y").mapInArrow(run, "word string, bad bigint, good bigint").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = (F.log((F.col("bad") + 0.5) / (n["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (n["all"] - n["bad"] + 1.0)))
    top = (counts.where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
           .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(LEXICON))
    return {r["word"]: round(r["odds"], 6) for r in top.collect()}


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) of every row.

    The lexicon, the trees and the calibration are learned from at most about
    ``max_rows`` labelled rows outside the held-out fold: the lexicon and trees
    from nine tenths of them, the isotonic map from the other tenth joined with
    them (the trees' own rows weigh a quarter). Scores keep a twentieth of the
    uncalibrated probability, so calibration steps do not tie documents. Null and
    empty texts have zero features and are scored like any other. Without
    labelled rows of both classes every score is the share of label 1 (0 without
    labels). Repeated rows give a row each, an empty table none; other columns
    are not read."""
    out = [F.col("doc_id"), held_out(4, 2)]
    sample = stored(labelled_sample(docs, labels, "toxic", 4, 2, max_rows), "labelled")
    tally = sample.agg(F.sum("y").alias("bad"), F.count("*").alias("all"), F.sum(F.when(F.col("part") > 0, F.col("y"))).alias("fit")).first()
    if not tally["fit"] or tally["bad"] == tally["all"]:
        share = (tally["bad"] or 0) / max(tally["all"], 1)
        return docs.select(*out, F.lit(share).alias("score"), F.lit(int(share >= 0.3)).alias("predicted"), F.lit(0).cast("bigint").alias("hits"))
    lexicon = learn_lexicon(sample.where("part > 0"))
    rows = stored(_featured(sample, ["doc_id", "y", "part"], lexicon), "features").withColumn("v", array_to_vector("x"))
    trees = GBTClassifier(featuresCol="v", labelCol="y", maxIter=24, maxDepth=3, stepSize=0.2, seed=7, maxBins=32,
                          minInstancesPerNode=5).fit(rows.where("part > 0"))
    trees.setRawPredictionCol("raw").setProbabilityCol("p").setPredictionCol("")
    prob = vector_to_array("p")[1]
    fitted = trees.transform(rows).select("y", prob.alias("q"), F.when(F.col("part") == 0, 1.0).otherwise(0.25).alias("w"))
    iso = IsotonicRegression(featuresCol="q", labelCol="y", weightCol="w", predictionCol="iso").fit(
        fitted.withColumn("y", F.col("y").cast("double")))
    scored = trees.transform(_featured(docs, ["doc_id"], lexicon).withColumn("v", array_to_vector("x")))
    scored = iso.transform(scored.select("doc_id", prob.alias("q"), F.col("x")[0].cast("bigint").alias("hits")))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.95 * F.col("iso") + 0.05 * F.col("q")))
    return scored.select(*out, score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), "hits")
