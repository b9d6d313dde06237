"""op4 substring dedup and op5 decontamination against brute force."""
import random

import brute
from conftest import AWKWARD, frame

from guestflow.llm import decontaminate, substring


def passages(rnd, n_docs, vocab=400):
    base = [[f"w{rnd.randrange(vocab)}" for _ in range(rnd.randint(20, 90))] for _ in range(12)]
    docs = {}
    for d in range(n_docs):
        ws = []
        for _ in range(rnd.randint(0, 4)):
            p = list(rnd.choice(base))
            if rnd.random() < 0.5:
                p[rnd.randrange(len(p))] = "x"
            lo = rnd.randrange(len(p))
            ws += p[lo:] if rnd.random() < 0.5 else p
            ws += [f"u{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(0, 15))]
        docs[d * 3 - 20] = rnd.choice([" ", "\n", "  "]).join(ws)
    return docs


def test_substring_matches_brute_force(spark):
    for seed, vocab in ((1, 400), (2, 3), (3, 2)):
        docs = passages(random.Random(seed), 60, vocab)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in
               substring.substring_dedup(frame(spark, list(docs.items()))).collect()}
        assert got == brute.substring_dedup(docs)


def test_subtree_holds_a_prefix_over_batches(spark):
    """A hot passage in every document, read back in tiny Arrow batches."""
    rnd = random.Random(4)
    hot = [f"h{i}" for i in range(30)]
    docs = {d: " ".join([f"a{rnd.randrange(10 ** 6)}" for _ in range(5)] + hot + [f"b{d}"]) for d in range(120)}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in
               substring.substring_dedup(frame(spark, list(docs.items()))).collect()}
    finally:
        spark.conf.set(key, old)
    assert got == brute.substring_dedup(docs)


def test_groups_of_a_short_common_phrase_are_split(spark, monkeypatch):
    """A phrase of 12 words in every document, the words around it its own, some copied."""
    rnd = random.Random(8)
    phrase = " ".join(f"p{i}" for i in range(12))
    docs = {d: " ".join([*(f"a{rnd.randrange(10 ** 6)}" for _ in range(25)), phrase, *(f"b{rnd.randrange(10 ** 6)}" for _ in range(25))])
            for d in range(300)}
    docs |= {d + 1000: docs[d] for d in range(0, 300, 7)}
    monkeypatch.setattr(substring, "GROUP_WINDOWS", 100, raising=False)
    table = frame(spark, list(docs.items()))
    dealt = substring.dealt_windows(table).where("kind = 0").groupBy("prefix").sum("n").collect()
    assert max(r[1] for r in dealt) <= 200
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.substring_dedup(table).collect()}
    assert got == brute.substring_dedup(docs)


def test_substring_awkward_and_empty(spark, awkward, empty):
    rows = substring.substring_dedup(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["kept_text"] == ""
    assert (by[4]["n_words"], by[4]["n_removed"]) == (90_000, 90_000 - 3)
    assert substring.substring_dedup(empty).count() == 0
    text = " ".join(f"t{i}" for i in range(40))
    rows = substring.substring_dedup(frame(spark, [(9, text), (9, text), (10, text), (None, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (9, 0), (9, 0), (10, 40)]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    """Runs of one text are never taken out of another; equal rows share a result."""
    rnd = random.Random(5)
    words = lambda k: " ".join(f"{k}{i}" for i in range(25))
    rows = [(3, words("a")), (5, words("a") + " " + words("b")), (5, words("c")), (5, words("c")), (5, words("a") + " tail"), (8, words("c") + " " + words("d")),
            (None, words("a")), (9, "short")]
    rows += [(7, " ".join(rnd.choice([words("a"), words("b"), words("x")]) for _ in range(3))) for _ in range(6)]
    got = sorted((r["doc_id"] or -1, r["kept_text"]) for r in substring.substring_dedup(frame(spark, rows)).collect())
    import xxhash
    key = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    order = sorted({(d, key(t), t) for d, t in rows if d is not None})
    kept = brute.substring_dedup({k: t for k, (_, _, t) in enumerate(order)})
    by = {(d, t): kept[k][2] for k, (d, _, t) in enumerate(order)}
    assert got == sorted((d or -1, by[d, t] if d is not None else t) for d, t in rows)


def test_decontamination_goes_by_rows(spark):
    """Contaminated rows go and clean ones stay, whatever their ids."""
    bench = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    rows = [(1, "one two three"), (1, "a clean text"), (None, "one two three four"), (None, "clean too"), (2, None), (None, None), (3, "x one two three")]
    got = decontaminate.decontaminated(frame(spark, rows), bench)
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, "clean too"), (1, "a clean text"), (2, "")]


def items(rnd, docs):
    out = []
    for i in range(30):
        ws = rnd.choice(list(docs.values())).split()
        out.append((f"i{i}", " ".join(ws[:rnd.randint(0, 40)]).upper()))
    return out + [("i0", out[0][1]), (None, "w1 w2"), ("n", None), ("none", " - "), ("short", "w1"), ("pair", "w1,w2")]


def test_contamination_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    docs = passages(rnd, 60, 40)
    bench = items(rnd, docs)
    table = spark.createDataFrame(bench, "item_id string, text string")
    want = brute.contamination(docs, bench)
    for block in (2_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"])
               for r in decontaminate.report(frame(spark, list(docs.items())), table).collect()}
        assert got == want
    kept = {r["doc_id"] for r in decontaminate.decontaminated(frame(spark, list(docs.items())), table).collect()}
    assert kept == {d for d, v in want.items() if not v[3]}


def test_contamination_awkward_and_empty(spark, awkward, empty):
    table = spark.createDataFrame([(7, "alpha beta gamma alpha beta"), (8, "one")], "item_id int, text string")
    rows = decontaminate.report(awkward, table).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_hit"] == 89_999 and by[4]["items"] == ["7"] and by[5]["contaminated"] and not by[1]["contaminated"]
    assert decontaminate.report(empty, table).count() == 0
    assert decontaminate.report(awkward, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminated(awkward, table).columns == awkward.columns
