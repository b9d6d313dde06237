"""op9 SimHash and op7 line dedup against brute force."""
import random

import brute
import numpy as np
import pytest
from conftest import AWKWARD, SF001, frame, python_nodes, texts
from pyspark.sql import functions as F

from guestflow.llm import lines, simhash
from guestflow.llm.components import connected_components


def groups(df):
    return sorted((r["doc_id"], r["component_id"]) for r in df.where("doc_id is not null").collect())


def test_fingerprints_match_brute_force():
    for t in [None, "", "  \t", "One", "one two", "A b c", "É é Z z " * 9, *texts(SF001, 60).values()]:
        assert simhash.simhash(t) == brute.simhash(t)


def test_components_of_documents(spark):
    docs = texts(SF001)
    got = simhash.simhash_components(frame(spark, list(docs.items())))
    assert groups(got) == sorted(brute.simhash_groups(docs).items())


@pytest.mark.parametrize("blocks", [4, 6])
def test_links_in_split_hot_cells(spark, monkeypatch, blocks):
    """Many fingerprints that share a block: the cell is split, no link is lost."""
    monkeypatch.setattr(simhash, "CELL", 64)
    r = np.random.default_rng(3)
    fps = sorted({int(r.integers(0, 1 << 20)) | (int(r.integers(0, 40)) << 33) for _ in range(700)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    got = {r["node"]: r["root"] for r in connected_components(simhash.simhash_links(reps, 3, blocks)).collect()}
    want = brute.components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {i: got.get(i, i) for i in want} == want


def test_tiles_skip_by_population_count_but_lose_nothing():
    r = np.random.default_rng(5)
    fp = np.unique(r.integers(0, 1 << 12, 3000).astype(np.uint64) << np.uint64(7))
    lab = simhash.tile_links(fp, 1)
    want = brute.components(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 1])
    assert len(set(zip(lab.tolist(), (want[i] for i in range(len(fp)))))) == len(set(want.values()))


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, None)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_simhash_awkward_and_empty(awkward, empty):
    rows = simhash.simhash_components(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] and by[5] == by[6] == 5
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.near_duplicates_removed(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [-3, 1, 4, 5, 5, 7, 1 << 40]


def mutated(s, k, rnd):
    s = list(s)
    for _ in range(k):
        i, kind = rnd.randrange(len(s)), rnd.randint(0, 2)
        s[i:i + (kind > 0)] = [] if kind == 2 else [rnd.choice("abé😀")]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rnd = random.Random(edits)
    pairs = []
    while len(pairs) < 800:
        a = "".join(rnd.choice("abé😀") for _ in range(rnd.randint(5, 22)))
        b = mutated(a, rnd.randint(0, 5), rnd)
        if abs(len(a) - len(b)) <= edits <= min(len(a), len(b)):
            pairs.append((a, b))
    counted = lines.with_letter_counts(lines.with_letter_counts(spark.createDataFrame(pairs, "a string, b string"), "a", "ca"), "b", "cb")
    df = counted.select(
        "a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("w"),
        lines.counts_agree(F.col("ca"), F.col("cb"), edits).alias("c"))
    for r in df.collect():
        near = brute.edit_distance(r["a"], r["b"]) <= edits
        assert r["w"] == near and (r["c"] or not near)


def test_letter_counts(spark):
    texts = ["", "eee", "the quick brown fox, über den faulen Hund.", "e" * 9 + "," * 17, "日本 entahirosdlucgbwmf.,"]
    for r in lines.with_letter_counts(spark.createDataFrame([(t,) for t in texts], "line string")).collect():
        assert r["counts"] == sum((r["line"].count(c) % 8) << 3 * k for k, c in enumerate(lines.LETTERS))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_always_share_a_key(spark, edits):
    keys = lambda c: lines.segment_keys(F.encode(c, "UTF-32"), F.length(c), edits)
    rnd = random.Random(10 + edits)
    rows = []
    while len(rows) < 600:
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(8, 30)))
        b = mutated(a, edits, rnd)
        a, b = sorted((a, b), key=len)
        if brute.edit_distance(a, b) <= edits:
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").select(
        F.arrays_overlap(F.array(*keys("a")[0]), F.array(*keys("b")[0], *keys("b")[1])).alias("o"))
    assert all(r["o"] for r in df.collect())


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(14, 40))) for _ in range(25)]
    docs = {d: "\n".join(mutated(rnd.choice(base), rnd.choice([0, 0, 1, 2, 3]), rnd) if rnd.random() < 0.9 else rnd.choice(["", "  ", "ok"])
                         for _ in range(rnd.randint(1, 7))) for d in range(80)}
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_lines"]) for r in lines.line_dedup(frame(spark, list(docs.items()))).collect()}
    assert got == brute.line_dedup(docs)


def test_line_dedup_awkward_empty_and_native(awkward, empty, spark):
    df = lines.line_dedup(awkward)
    rows = df.collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_lines"] for r in by[1] + by[2] + by[3]] == [0, 0, 1] and by[1][0]["text"] is None
    assert all(r["n_removed"] == 0 and r["text"] == "One." for r in by[5]) and by[6][0]["n_removed"] == 1 and by[6][0]["text"] == ""
    assert all(r["n_removed"] == 0 for r in by[None])
    assert not python_nodes(df)
    assert lines.line_dedup(empty).count() == 0


def brute_lines(rows):
    """Kept text per row: equal lines are one class; rows of one id follow one another by text key."""
    import xxhash
    key = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    seen, gone = {}, {}
    for d, of, t in sorted({(d, key(t), t) for d, t in rows}):
        for n, line in enumerate(t.split("\n")):
            if line.strip(" "):
                if seen.setdefault(line, (d, of)) and line in gone.setdefault("met", set()):
                    gone.setdefault((d, t), set()).add(n)
                gone["met"].add(line)
    return sorted((d, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((d, t), ()))) for d, t in rows)


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    """One doc_id with several texts: line numbers of one are never taken out of the other."""
    rows = [(1, "first line here\nonly in one"), (5, "first line here\nkept in five a\nshared"), (5, "kept in five b\nshared\nkept in five b"),
            (5, "kept in five b\nshared\nkept in five b"), (6, "shared\nlast\nlast"), (2, "alone")]
    got = lines.line_dedup(frame(spark, rows)).select("doc_id", "text", "n_removed").collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute_lines(rows)


def test_a_class_of_a_third_of_all_lines(spark):
    import hashlib
    own = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(i, f"a line that very many documents hold\n{own(i)}" if i % 3 else own(i)) for i in range(900)]
    out = lines.line_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == brute_lines(rows) and sum(r.n_removed for r in out) == 599
