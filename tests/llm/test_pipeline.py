"""The pipeline and the registered corpus queries."""
import sys

import brute
from conftest import SF001

sys.path.insert(0, ".")


def test_pipeline_against_brute_force(spark):
    """Stage by stage on its own input: each reference stage takes what the Spark stage before it kept."""
    import corpus_pipeline as P
    from guestflow.llm.common import read, stored
    docs = read(spark, SF001, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    bench = [(r["item_id"], r["text"]) for r in read(spark, SF001, "benchmark").collect()]
    for name, stage in P.STAGES[:-1]:
        out = stored(stage(spark, docs, SF001), name)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert len(after) >= len(before) - 3 and all(before[d] == t for d, t in after.items())
        if name == "line_dedup":
            want = brute.line_dedup(before)
            assert after == {d: t for d, (t, gone, n) in want.items() if n == 0 or gone < n}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if name == "simhash_near_dedup":
            groups = brute.simhash_groups(before)
            assert after == {d: t for d, t in before.items() if groups[d] == d}
        if name == "benchmark_decontamination":
            bad = {d for d, v in brute.contamination(before, bench).items() if v[3]}
            assert after == {d: t for d, t in before.items() if d not in bad}
        docs, before = out, after
    packed = P.STAGES[-1][1](spark, docs, SF001).collect()
    assert {r["doc_id"] for r in packed} == set(before)
    whole = P.run(spark, SF001).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_queries_are_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert {"op4_substring_dedup", "op5_decontamination", "op7_line_dedup"} <= set(E.oracle_sql())
