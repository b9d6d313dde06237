"""Merkle manifest of a table: few levels are kept, proofs regenerate the others."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestflow.llm.common import slots, stored

#: Children per node, and how many levels lie between two that are kept.
ARITY, EVERY = 8, 2
#: The leaf's inputs, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Forest(NamedTuple):
    """Trees over ordered leaves. ``kept[0]`` are the leaves (tree, pos, n, hash and
    the columns carried), ``kept[j]`` the nodes ``every * j`` levels above them, the
    last one row per tree. ``n`` is the number of nodes of the tree on that level."""
    kept: list[DataFrame]
    arity: int
    every: int


class Manifest(NamedTuple):
    """Per language a tree over the documents, and one tree over their roots."""
    languages: Forest
    top: Forest


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else ``<UTF-8 bytes>:<value>``."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of documents with ``text`` as its text."""
    return digest(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with a column ``tree``) and pos, their place in (tree, *order) within
    their tree, and n, the tree's size. ``order`` must set all rows apart.

    Rows are range-partitioned and sorted, so a tree of any size spreads over all
    tasks. Places follow from the row numbers inside the partitions and the counts
    per (tree, partition); windows see one row per such pair."""
    sort = ["tree", *order]
    placed = stored(rows.repartitionByRange(slots(rows), *sort).sortWithinPartitions(*sort)
                    .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    return placed.join(runs, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def subtrees(nodes: DataFrame, arity: int, every: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(tree, g, n, members, level_0 .. level_every): the kept nodes below each node of
    the next kept level, and all digests between, regenerated from them.

    A subtree has at most arity ** every members."""
    size = arity ** every
    out = (nodes.groupBy("tree", F.expr(f"pos div {size}").alias("g"))
           .agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("members"))
           .withColumn("level_0", F.transform("members", lambda m: m["hash"])))
    for i in range(every):
        below = F.col(f"level_{i}")
        above = runs_digested(below, arity)
        out = out.withColumn(f"level_{i + 1}", F.when(F.col("n") > arity ** i, above).otherwise(below))  # a tree ends at one node
    return out


def runs_digested(level: Column, arity: int) -> Column:
    """The digests of a level's runs of ``arity`` consecutive nodes."""
    runs = F.sequence(F.lit(1), F.size(level), F.lit(arity))
    return F.transform(runs, lambda at: digest(F.array_join(F.slice(level, at, arity), "")))


def grow(leaves: DataFrame, name: str, arity: int = ARITY, every: int = EVERY) -> Forest:
    """Trees over numbered leaves; every ``every``-th level is stored, the ones between are not."""
    kept, size = [leaves], arity ** every
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        up = subtrees(kept[-1], arity, every).select("tree", F.col("g").alias("pos"), F.ceil(F.col("n") / size).alias("n"),
                                                     F.col(f"level_{every}")[0].alias("hash"))
        kept.append(stored(up, f"{name}-{len(kept)}"))
        largest = -(-largest // size)
    return Forest(kept, arity, every)


def steps(forest: Forest, i: Column) -> Column:
    """The sides (left, right) of the siblings of member ``i`` of a subtree, level by
    level: digests joined; both empty where a node has no siblings."""
    out = []
    for k in range(forest.every):
        at = F.floor(i / forest.arity ** k).cast("int")  # i is below arity ** every
        lo = at - at % forest.arity
        level = F.col(f"level_{k}")
        side = F.struct(F.array_join(F.slice(level, lo + 1, at - lo), "").alias("left"),
                        F.array_join(F.slice(level, at + 2, lo + (forest.arity - 1) - at), "").alias("right"))
        out.append(F.when(F.col("n") > forest.arity ** k, side))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the sides of its proof give."""
    return F.aggregate(proof, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def proofs(forest: Forest, above: DataFrame, emit, carried: tuple[str, ...] = ()) -> DataFrame:
    """``emit(member, proof)`` (a struct) of every leaf, with the columns of ``above``.

    ``above`` holds per tree the proof of its root in the tree over it (an empty array
    where there is none). From the top down, each subtree's missing levels are made
    anew from its kept members, every member takes its siblings, and the subtree's
    nodes are dropped; a proof moves once per subtree of the next level."""
    extra = [c for c in above.columns if c not in ("tree", "proof")]
    higher = above.withColumn("pos", F.lit(0).cast("bigint"))
    for j in range(max(len(forest.kept) - 2, 0), -1, -1):
        last = j == 0
        level = subtrees(forest.kept[j], forest.arity, forest.every, carried if last else ())
        level = level.join(higher.withColumnRenamed("pos", "g"), ["tree", "g"])
        path = lambda m: F.concat(steps(forest, (m["pos"] % forest.arity ** forest.every).cast("int")), F.col("proof"))
        paths = F.transform("members", lambda m: F.struct(m.alias("m"), path(m).alias("path")))  # made once, however often emit reads it
        if last:
            return level.select("tree", *extra, F.inline(F.transform(paths, lambda x: emit(x["m"], x["path"]))))
        higher = level.select("tree", *extra, F.inline(F.transform(paths, lambda x: F.struct(x["m"]["pos"].alias("pos"), x["path"].alias("proof")))))
    raise AssertionError


def build(docs: DataFrame, found: Column | None = None, arity: int = ARITY, every: int = EVERY) -> Manifest:
    """The manifest of a documents table.

    A leaf is the digest of doc_id, source, lang, n_chars and text. ``found`` is the
    text to be held against the manifest (default: the text itself); its leaf is
    carried beside the row's own. Null doc_ids come first, null and "" are different
    languages; rows that repeat a doc_id follow one another by leaf, equal rows
    have leaves of their own. Other columns are ignored."""
    rows = docs.select(*FIELDS)
    own = F.col("text")
    leaves = rows.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),  # "-" sorts before "="
        F.unhex(leaf(own)).alias("bin"), F.unhex(leaf(own if found is None else found)).alias("found"))
    leaves = stored(leaves.withColumn("rid", F.monotonically_increasing_id()), "manifest-leaves")
    placed = numbered(leaves, ["doc_id", "bin", "rid"], "manifest-0")
    shown = placed.select("tree", "pos", "n", "doc_id", F.lower(F.hex("bin")).alias("hash"), F.lower(F.hex("found")).alias("found"))
    languages = grow(shown, "manifest", arity, every)
    roots = languages.kept[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    return Manifest(languages, grow(numbered(roots, ["of"], "manifest-roots"), "manifest-top", arity, every))


def verified(manifest: Manifest) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof (its siblings' digest),
    folded_root (from the found leaf and the siblings) and verified.

    A table without rows gives none."""
    whole = manifest.top.kept[-1].select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    top = proofs(manifest.top, whole, lambda m, p: F.struct(m["of"].alias("of"), m["hash"].alias("subroot"), p.alias("proof")), ("of",))
    above = top.select(F.col("of").alias("tree"), "subroot", "root", "proof")
    out = proofs(manifest.languages, above, lambda m, p: F.struct(
        m["doc_id"].alias("doc_id"), m["hash"].alias("leaf"), proof_digest(p).alias("proof"), fold(m["found"], p).alias("folded_root")),
        ("doc_id", "found"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
