"""Document fingerprints: a Merkle tree over spans, paragraphs and sections, in SQL functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestflow.llm.common import slots, stored

#: Words of a span (the leaves below a paragraph), the first words of the shorter
#: spans that open a paragraph, and the share of paragraphs whose content ends a
#: section (one in SECTION).
SPAN, OPENING, SECTION = 16, (1, 2, 5, 9), 4
#: Ids per bucket when neighbours are found: two to the power of this.
BUCKET_BITS = 10


def fingerprint(text: Column) -> Column:
    """``root:sections`` of a text (null counts as empty).

    A paragraph is a line. Its leaves are the hashes of its spans of SPAN words
    (the first of them cut up at OPENING, so that short texts have leaves too); its
    digest is the SHA-256 of the whole paragraph. Sections are runs of
    paragraphs that end where a paragraph's own digest says so, so an insertion
    moves no later border. A section's digest is the SHA-256 of its paragraphs'
    digests, the root that of the sections' digests. After the root stand the
    branches: per section 16 hex digits of its digest and, in brackets, per
    paragraph its leaves (8 hex digits each, joined by a dot). Equal texts have
    equal roots and fingerprints; inner digests follow from the text alone."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n")
    nodes = F.transform(paragraphs, lambda p: F.struct(F.sha2(p, 256).alias("d"), _leaves(p).alias("l")))
    ends = F.transform(F.array(nodes), lambda n: F.struct(n.alias("n"), F.filter(
        F.sequence(F.lit(1), F.size(n)),
        lambda i: (i == F.size(n)) | (F.pmod(F.conv(F.substring(F.element_at(n, i)["d"], 1, 8), 16, 10).cast("bigint"), F.lit(SECTION)) == 0)).alias("e")))
    sections = F.transform(ends, lambda s: F.transform(s["e"], lambda e, k: F.slice(
        s["n"], F.when(k == 0, 1).otherwise(F.get(s["e"], k - 1) + 1), e - F.when(k == 0, 0).otherwise(F.get(s["e"], k - 1)))))[0]
    rolled = F.transform(sections, lambda s: F.struct(
        F.sha2(F.array_join(F.transform(s, lambda p: p["d"]), ""), 256).alias("d"),
        F.array_join(F.transform(s, lambda p: p["l"]), ",").alias("b")))
    return F.transform(F.array(rolled), lambda r: F.concat(
        F.sha2(F.array_join(F.transform(r, lambda s: s["d"]), ""), 256), F.lit(":"),
        F.array_join(F.transform(r, lambda s: F.concat(F.substring(s["d"], 1, 16), F.lit("["), s["b"], F.lit("]"))), ";")))[0]


def _leaves(p: Column) -> Column:
    ends = (*OPENING[1:], SPAN + 1)

    def spans(w: Column) -> Column:
        later = F.when(F.size(w) > SPAN, F.sequence(F.lit(SPAN + 1), F.size(w), F.lit(SPAN))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.filter(F.array(*map(F.lit, OPENING)), lambda i: i <= F.size(w)), later)

    def length(i: Column) -> Column:
        out = F.lit(SPAN)
        for at, end in zip(OPENING, ends):
            out = F.when(i == at, end - at).otherwise(out)
        return out

    return F.transform(F.array(F.split(p, " ")), lambda w: F.array_join(F.transform(
        spans(w), lambda i: F.substring(F.lpad(F.hex(F.xxhash64(F.array_join(F.slice(w, i, length(i)), " "))), 16, "0"), 1, 8)), "."))[0]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def leaves(fp: Column) -> Column:
    """The distinct leaf hashes of a fingerprint."""
    bare = F.regexp_replace(F.substring(fp, 66, 1 << 30), r"[0-9a-f]{16}\[|\];?", ".")
    return F.array_distinct(F.filter(F.split(F.translate(bare, ",", "."), r"\."), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: shared leaves over the mean number of leaves; 1 for equal roots."""
    both = F.transform(F.array(F.struct(leaves(a).alias("a"), leaves(b).alias("b"))),
                       lambda s: 2.0 * F.size(F.array_intersect(s["a"], s["b"])) / (F.size(s["a"]) + F.size(s["b"])))[0]
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(both)


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of b's section branches that a does not have: where b was edited."""
    def changed(s: Column) -> Column:
        numbered = F.transform(s["b"], lambda x, k: F.struct(x.alias("x"), k.alias("k")))
        return F.transform(F.filter(numbered, lambda x: ~F.array_contains(s["a"], x["x"])), lambda x: x["k"])

    branches = [F.split(F.substring(fp, 66, 1 << 30), ";").alias(name) for name, fp in (("a", a), ("b", b))]
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.transform(F.array(F.struct(*branches)), changed)[0])


def bucket_heads(ids: DataFrame) -> DataFrame:
    """(k, to): the largest id of every bucket and the next higher bucket that has
    ids (after the highest the lowest): there it is the next document of the
    smallest id.

    Buckets are range-partitioned, so their order is found per partition; only one
    row per partition meets in one place, however far the ids lie apart."""
    heads = ids.groupBy(F.shiftright("k", BUCKET_BITS).alias("b")).agg(F.max("k").alias("k"))
    heads = stored(heads.repartitionByRange(slots(ids), "b").sortWithinPartitions("b").withColumn("part", F.spark_partition_id()), "buckets")
    lows = heads.groupBy("part").agg(F.min("b").alias("low"))
    lows = lows.select("part", F.coalesce(F.lead("low").over(Window.orderBy("part")), F.min("low").over(Window.partitionBy())).alias("after_part"))
    return (heads.withColumn("after", F.lead("b").over(Window.partitionBy("part").orderBy("b")))
            .join(F.broadcast(lows), "part").select("k", F.coalesce("after", "after_part").alias("to")))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, fingerprint, edited, edited_fingerprint, next_fingerprint) of every row.

    The next document has the next smaller doc_id, after the smallest the
    largest. ``edited`` is the text with its last floor(n_chars / 3) code points
    replaced by the first as many (or all) of the next text. Null text counts as
    empty. Rows that repeat a doc_id share the next distinct one; if that has
    several texts, the greatest is taken. Null doc_ids count as the smallest id. A
    single document is its own next; an empty table gives no rows.

    Texts move once, to their bucket of ids; the head of a bucket is also copied
    to the next higher one. The table of heads (one id per bucket) is joined as
    its stored size suggests to Spark."""
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 62))).alias("k"),
                       F.coalesce("text", F.lit("")).alias("text"))
    heads = stored(bucket_heads(base.select("k")), "heads")
    b = F.shiftright("k", BUCKET_BITS)  # whole numbers throughout: a quotient of large ids would be rounded
    places = F.array(F.struct(b.alias("b"), (F.col("k") - F.shiftleft(b, BUCKET_BITS)).alias("place")),
                     F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("b"), F.lit(-1).cast("bigint").alias("place"))))
    dealt = (base.join(heads, "k", "left").withColumn("fingerprint", fingerprint(F.col("text")))
             .select("doc_id", "text", "fingerprint", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"))
             .select("doc_id", "text", "fingerprint", "p.b", "p.place"))
    below = Window.partitionBy("b").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.length("text") / 3).cast("int")
    return (dealt.withColumn("n", F.max(F.struct("place", "text", "fingerprint")).over(below)).where("place >= 0")
            .withColumn("n_chars", F.length("text").cast("bigint")).withColumn("cut", cut)
            .withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), substring(n.text, 1, cut))"))
            .select("doc_id", "text", "n_chars", "edited", "fingerprint", F.col("n.fingerprint").alias("next_fingerprint"))
            .withColumn("edited_fingerprint", fingerprint(F.col("edited"))))
