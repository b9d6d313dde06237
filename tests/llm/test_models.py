"""op1, op6 and op10: held-out accuracy, and nothing learned from held-out rows."""
import math

import brute
import numpy as np
import pytest
from conftest import AWKWARD, SF01, frame
from pyspark.sql import functions as F

from guestflow.llm import langid, quality, toxicity


def table(spark, name):
    return spark.read.parquet(f"{SF01}/{name}.parquet")


def test_kneser_ney_sums_to_one_and_backs_off():
    texts = {0: ["the cat sat on the mat", "a cat and a hat"], 1: ["le chat est sur le tapis"]}
    symbols = langid.Symbols()
    lang, gram, n = [], [], []
    for k, ts in texts.items():
        sym, _ = symbols(ts)
        g = langid._grams(sym, langid.ORDER)[sym[langid.ORDER - 1:] != langid.START]
        u, c = np.unique(g, return_counts=True)
        lang += [k] * len(u)
        gram.append(u)
        n.append(c)
    kn = langid.KneserNey(["en", "fr"], np.array(lang), np.concatenate(gram), np.concatenate(n))
    alphabet = np.unique(np.concatenate(gram) & np.uint64(0xFFFF))
    for ctx in ("the", " ca", "zzz", "at "):
        base = np.uint64(0)
        for c in ctx:
            base = (base << np.uint64(16)) | np.uint64(ord(c))
        p = np.exp(kn.score((base << np.uint64(16)) | alphabet, langid.ORDER).astype(float))
        other = np.exp(kn.score(np.array([(base << np.uint64(16)) | np.uint64(ord("Q"))]), langid.ORDER).astype(float))
        assert np.allclose(p.sum(axis=0) + other.sum(axis=0), 1, atol=2e-3), ctx


def test_symbols():
    sym, row = langid.Symbols()(["  Ab, c!", None, "1 2", "𝒜é"])
    one = [chr(c) if c != langid.START else "^" for c in sym[row == 0]]
    assert "".join(one) == "^^^ab c " and (sym[row == 1] == langid.START).all() and (sym[row == 2] == langid.START).all()
    assert (sym[row == 3] != langid.START).sum() == 3


def test_languages_held_out(spark):
    docs = table(spark, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (brute.fold(r["doc_id"], 3) == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert sum(r["rejected"] for r in got) <= 3 and all(0 <= r["score"] <= 1 for r in got)
    # languages of held-out rows are not looked at
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(blind).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}


def test_languages_reject_strangers_awkward_and_empty(spark, awkward, empty):
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000_001, "Ελληνικό κείμενο που δεν μοιάζει με τίποτα " * 5, None), (10_000_002, "123 !!", None),
                                 (10_000_003, "xq zvkj wqx kzzj vxq " * 30, None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs.unionByName(odd)).where("doc_id > 10000000").collect()}
    assert all(got[d]["rejected"] for d in got) and got[10_000_002]["lang_pred"] == "und" and got[10_000_002]["score"] == 0
    rows = langid.identify(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(empty).count() == 0
    unlabelled = langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert langid.identified(awkward).columns == awkward.columns


@pytest.mark.parametrize("cells", [100_000, 40_000])
def test_languages_beyond_the_broadcast_bound(spark, awkward, monkeypatch, cells):
    """A rare language beside larger ones, with whole languages and with hash ranges of one as parts."""
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    rare = [(20_000_000 + i, f"vaka moana {w} te whenua o {w} me nga tangata katoa ki {w}", "mi")
            for i, w in enumerate(["aroha", "kumara", "tikanga", "whare", "rangi", "marae", "iwi", "awa", "maunga", "kai", "wai", "hau"])]
    docs = docs.unionByName(spark.createDataFrame(rare, docs.schema)).unionByName(awkward.select("doc_id", "text", "lang"))
    def answers():
        rows = [(r["doc_id"] or 0, r["lang_pred"], r["rejected"], round(r["score"], 4)) for r in langid.identify(docs).collect()]
        return sorted(rows)
    want = answers()
    assert sum(r[1] == "mi" and not r[2] for r in want) >= len(rare)
    monkeypatch.setattr(langid, "MAX_CELLS", cells)
    counted = []
    monkeypatch.setattr(langid, "cross_entropies_in_parts", lambda *a, whole=langid.cross_entropies_in_parts: counted.append(1) or whole(*a))
    got = answers()
    assert counted == [1]
    for a, b in zip(want, got, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01


def held_accuracy(rows, labels, col):
    y = {r["doc_id"]: r[col] for r in labels.collect()}
    held = [(r["predicted"], y[r["doc_id"]]) for r in rows if r["held_out"] and y.get(r["doc_id"]) is not None]
    return sum(a == b for a, b in held) / len(held)


@pytest.mark.parametrize("run, col, k, out, least", [(toxicity.toxicity, "toxic", 4, 2, 0.93), (quality.quality, "quality", 5, 0, 0.95)])
def test_classifiers_held_out(spark, run, col, k, out, least):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = run(docs, labels).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (brute.fold(r["doc_id"], k) == out) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert held_accuracy(rows, labels, col) > least
    flipped = labels.withColumn(col, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == out, 1 - F.col(col)).otherwise(F.col(col)))
    again = {r["doc_id"]: r["score"] for r in run(docs, flipped).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], abs_tol=1e-9) for r in rows)


@pytest.mark.parametrize("run, col", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_awkward_and_empty(spark, awkward, empty, run, col):
    labels = spark.createDataFrame([(d, d % 2, None) for d in (1, 2, 3, 4, 5, 5, 6, 7, -3)] + [(None, 1, None), (99, 1, None), (4, None, None)],
                                   f"doc_id bigint, {col} int, extra string")
    rows = run(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert run(empty, labels).count() == 0
    none = run(awkward, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_quality_learns_from_every_labelled_row(spark):
    """All good rows lie where a hash sample of 20,000 rows used to leave them out."""
    mark = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    text = F.when(F.col("good"), F.lit("Plain sentences follow here. They end as they should, one by one. ")).otherwise(F.lit("BUY!!! || now $$$ "))
    docs = (spark.range(30_000).select(F.col("id").alias("doc_id"), (mark > 0.97).alias("good"))
            .select("doc_id", "good", F.repeat(text, (F.col("doc_id") % 4 + 1).cast("int")).alias("text")))
    labels = docs.select("doc_id", F.col("good").cast("int").alias("quality"))
    got = quality.quality(docs, labels).join(labels, "doc_id").groupBy("quality", "predicted").count().collect()
    assert {(r["quality"], r["predicted"]) for r in got} == {(0, 0), (1, 1)}


def test_quality_threshold_is_the_exact_quantile_of_all_rows(spark):
    x = np.random.default_rng(3).normal(size=(5000, len(quality.BASE)))
    x[:2000, 0] = 0.0  # repeated values
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id bigint, x array<double>")
    for n_bad in (1, 700, 2500, 4999):
        ranker = quality.Ranker(np.zeros(len(quality.BASE)), np.ones(len(quality.BASE)), np.zeros((1, len(quality.BASE))))
        ranker.w[0] = 1.0
        quality._threshold(ranker, rows, n_bad, len(x))
        s = ranker.strength(x)
        assert math.isclose(ranker.cut, np.quantile(s, n_bad / len(x)), abs_tol=1e-12) and math.isclose(ranker.spread, s.std(), rel_tol=1e-6)


def test_quality_blocks_hold_every_row(spark, monkeypatch):
    """Blocks of a rare class: each row of the other class once, each block with both."""
    monkeypatch.setattr(quality, "BLOCK", 50)
    monkeypatch.setattr(quality, "MATES", 8)
    x = lambda i: [float(i)] * len(quality.BASE)
    for good in (3, 40, 500):
        rows = spark.createDataFrame([(i, int(i < good), x(i)) for i in range(1000)], "doc_id bigint, y int, x array<double>")
        blocks = quality._blocks(rows, 1000 - good, good).collect()
        ids = lambda c: [int(v) for r in blocks for v in np.frombuffer(r[c]).reshape(-1, len(quality.BASE))[:, 0]]
        assert len(blocks) == 20 and all(r["good"] and r["bad"] for r in blocks)
        assert set(ids("good")) == set(range(good)) and sorted(ids("bad")) == list(range(good, 1000))


def test_obfuscated_words_are_read_plain():
    assert toxicity.plain("Idiot!!!") == ("idiot", False)
    for t in ("1d1ot", "i.d.i.o.t", "idiiiiot", "!d!ot's"):
        assert toxicity.plain(t)[1] is True
    assert toxicity.plain("i.d.i.o.t")[0] == toxicity.plain("1d1ot")[0] == "idiot"
    assert toxicity.plain("###") == ("", False) and toxicity.plain("2024") == ("", False)


def test_language_verdicts_go_by_rows(spark):
    """A rejected text goes and a clean one with the same id, or without one, stays."""
    from conftest import frame
    from guestflow.llm.langid import identified
    words = {"en": "the house and the garden are near the old river bank", "es": "la casa y el jardín están cerca del viejo río grande"}
    rows = [(i, f"{words[k]} {words[k]} {i}", k) for i in range(40) for k in ("en", "es")]
    rows += [(500, words["en"], "en"), (500, "12345 67890", "en"), (None, words["es"], None), (None, "???", None), (501, None, "en")]
    kept = sorted((r.doc_id or -1, r.text) for r in identified(frame(spark, rows)).where("doc_id is null or doc_id >= 500").collect())
    assert kept == [(-1, words["es"]), (500, words["en"])]
