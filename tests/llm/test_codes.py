"""op12: Orchard search and product codes against exhaustive search."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from guestflow.llm import codes as C


@pytest.mark.parametrize("k,width,span", [(64, 4, 100), (64, 4, 2), (256, 3, 9), (9, 2, 2), (2, 1, 1), (1, 4, 5)])
def test_orchard_finds_what_an_exhaustive_search_finds(k, width, span):
    rng = np.random.default_rng(k)
    book, q = rng.integers(-span, span + 1, (k, width)), rng.integers(-span - 3, span + 4, (2500, width))
    code, dist = C.Orchard(book).nearest(q)
    every = ((q[:, None] - book[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (dist == every.min(1)).all()


def test_orchard_skips_far_entries(monkeypatch):
    looked = []
    monkeypatch.setattr(np, "nonzero", lambda x, f=np.nonzero: looked.append(int(x.sum())) or f(x))
    book = np.arange(0, 64_000, 1000)[:, None] * np.ones((1, 4), int)
    C.Orchard(book).nearest(book + 1)
    assert sum(looked) < 64 * 10


def brute(vectors, parts=16, entries=64, rounds=2):
    """vectors: (vec_id, label, components) of usable rows."""
    width = max(1, -(-max(len(v) for _, _, v in vectors) // parts)) * parts
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, _, v in vectors]).reshape(len(vectors), parts, -1)
    x = np.clip(x, -C.LIMIT, C.LIMIT)
    order = sorted((i for i in range(len(vectors)) if vectors[i][0] is not None), key=lambda i: (vectors[i][0], list(vectors[i][2])))
    book = x[order[:entries]].copy() if order else np.zeros((1, parts, width // parts), int)

    def nearest():
        d = np.stack([((x[:, p][:, None] - book[None, :, p]) ** 2).sum(2) for p in range(parts)], 1)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in set(code[:, p]):
                mine = x[code[:, p] == e, p]
                book[e, p] = mine.sum(0) // len(mine)
    code, error = nearest()
    label = {}
    for (_, key, _), e in zip(vectors, error):
        label[key] = label.get(key, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, book.swapaxes(0, 1).ravel())).encode()).hexdigest()
    return sorted(((v[0], v[1], "".join(f"{c:02x}" for c in row), int(e), label[v[1]], sha) for v, row, e in zip(vectors, code, error)), key=str)


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("code", T.StringType()), T.StructField("l", T.StringType()), T.StructField("salt", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, key, "clash", "clash", "clash") for i, key, v in rows], SCHEMA).repartition(3)


def test_codes_errors_and_books(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i * 7 % 1009, int(rng.integers(0, 4)) if i % 9 else None, [float(np.float32(c)) for c in rng.normal(0, 0.2, 32)]) for i in range(400)]
    rows += [(2000 + i, 1, [0.25] * 32) for i in range(200)]  # one very common vector
    rows += [(5, 2, rows[3][2]), (None, 3, rows[4][2]), (None, None, [0.0] * 32)]
    bad = [(3000, 1, None), (3001, 1, [None] + [0.1] * 31), (3002, None, [float("nan")] * 32), (3003, 2, [float("inf")] + [0.0] * 31), (-9, 2, [float("-inf")] * 32)]
    want = brute(rows)
    for few in (C.FEW_LABELS, 1):  # sums by broadcast, and by a salted join
        monkeypatch.setattr(C, "FEW_LABELS", few)
        assert sorted(map(tuple, C.compress(table(spark, rows + bad)).collect()), key=str) == want


def test_few_short_and_no_vectors(spark):
    for rows in ([(1, 1, [0.5] * 16)], [(1, None, [])], [(None, 1, [0.1, 0.2])],
                 [(3, 0, [0.5, -0.004] * 10), (1, 0, [1e30] * 3), (1, 0, [-1.0]), (2, None, [])]):
        assert sorted(map(tuple, C.compress(table(spark, rows)).collect()), key=str) == brute(rows), rows
    assert C.compress(table(spark, [])).collect() == [] and C.compress(table(spark, [(1, 1, None)])).collect() == []
