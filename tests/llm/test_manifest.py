"""op11: the manifest against brute-force trees."""
import hashlib
import random
import zlib

import pytest
from conftest import AWKWARD, frame, python_nodes
from pyspark.sql import functions as F

from guestflow.llm import manifest as M
from guestflow.llm.common import fold


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h("".join(x[i:i + arity])) for i in range(0, len(x), arity)])
    paths = []
    for i in range(len(hashes)):
        path = []
        for x in levels[:-1]:
            lo = i - i % arity
            path.append(("".join(x[lo:i]), "".join(x[i + 1:lo + arity])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, arity=8):
    def leaf(d, s, lang, n, t):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)))

    def tampered(d, t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t

    langs = {}
    for d, s, lang, n, t in rows:
        langs.setdefault(lang, []).append((d is not None, d or 0, leaf(d, s, lang, n, t), leaf(d, s, lang, n, tampered(d, t)), d))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    grown = [tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])], arity) for k in order]
    root, top = tree([r for r, _ in grown], arity)
    out = []
    for k, (sub, paths), upper in zip(order, grown, top):
        for x, path in zip(sorted(langs[k], key=lambda x: x[:3]), paths):
            acc = x[3]
            for left, right in path + upper:
                acc = h(left + acc + right)
            out.append((x[4], x[2], sub, root, h("".join(a + b for a, b in path + upper)), acc, acc == root))
    return sorted(out, key=str)


def found():
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(fold("doc_id", 3) == 0, lower).otherwise(F.col("text"))


def same(docs, **kw):
    got = M.verified(M.build(docs, found(), **kw)).collect()
    want = brute([tuple(r) for r in docs.select(*M.FIELDS).collect()], kw.get("arity", 8))
    assert sorted(map(tuple, got), key=str) == want
    return got


@pytest.mark.parametrize("kw", [{}, {"arity": 3, "every": 3}, {"arity": 2, "every": 1}])
def test_trees_of_many_sizes(spark, kw):
    rnd = random.Random(1)
    rows, d = [], 0
    for lang, n in (("one", 1), ("eight", 8), ("nine", 9), ("all", 64), ("more", 65), ("much", 70), ("é", 3), ("Z", 2), ("", 2), (None, 11)):
        for _ in range(n):
            rows.append((d, rnd.choice("abC") * rnd.randint(0, 5), lang))
            d += 3
    rnd.shuffle(rows)
    got = same(frame(spark, rows), **kw)
    assert {r["verified"] for r in got} == {True, False}


def test_awkward_rows(spark, awkward, empty):
    same(awkward)
    assert M.verified(M.build(empty)).collect() == []
    assert all(r["verified"] for r in M.verified(M.build(awkward)).collect()) and len(AWKWARD) == awkward.count()


def test_one_document_and_one_language(spark):
    (r,) = M.verified(M.build(frame(spark, [(4, "Text", "en")]))).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof"] == h("")


def test_copies_of_one_row_have_leaves_of_their_own(spark):
    assert len(same(frame(spark, [(7, "Same", "en")] * 300 + [(None, "none", None)] * 100))) == 400


def test_only_every_second_level_is_kept(spark):
    docs = frame(spark, [(i, f"t{i}", "en") for i in range(700)])
    m = M.build(docs)
    assert [k.count() for k in m.languages.kept] == [700, 11, 1]
    assert not python_nodes(M.verified(m))


def test_a_changed_document_fails_alone(spark):
    docs = frame(spark, [(i, f"text {i}", "en" if i % 2 else "de") for i in range(150)])
    changed = F.when(F.col("doc_id") == 77, F.lit("text 78")).otherwise(F.col("text"))
    assert [r["doc_id"] for r in M.verified(M.build(docs, changed)).collect() if not r["verified"]] == [77]
