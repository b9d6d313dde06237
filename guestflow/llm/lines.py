"""Line dedup by a segment-partition edit-distance join, in SQL functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import met, release, stored, text_key
from guestflow.llm.components import connected_components

#: Edits that still link two lines, and the length from which lines link by edits.
MAX_EDITS, MIN_CHARS = 2, 20
#: Characters whose counts are compared before the distance is worked out.
LETTERS = "entahirosdlucgbwmf.,"
#: Bits of the map of candidate lines that is broadcast (fixed size).
MAP_BITS = 1 << 22


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, of, line_no, line) of every line that is not blank, ``of`` being the key
    of its text; null doc_ids have none."""
    return (docs.where("doc_id is not null").select("doc_id", text_key().alias("of"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .where(F.trim("line") != ""))


def line_key(line: Column) -> Column:
    """128 bits of the SHA-256 of a line: its identity wherever texts are not at hand."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of an even partition; the last ones are longer."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    first_long = F.lit(parts) - longer
    start = F.lit(1) + F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - first_long)
    return start, base + F.when(F.lit(i) >= first_long, 1).otherwise(0)


def segment_keys(wide: Column, n: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """(index keys, further probe keys) of a line in UTF-32 (its places are found without
    a walk) of ``n`` characters: hashes of its own segments, and of the other substrings
    that can equal a segment of a line no longer than this one, each with that line's
    length and the segment's number.

    For a partner shorter by d, segment i lies near its own start: the edits to
    its left are at most i, and those to its right at most edits - i, which also
    bounds how far it is shifted. A line's own segments (d and shift 0) probe too."""
    own, others = [], []
    for d in range(edits + 1):
        short = (n - d).cast("int")
        for i in range(edits + 1):
            start, size = _segment(short, i, edits + 1)
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                key = F.xxhash64(short, F.lit(i), F.substring(wide, (start + shift - 1) * 4 + 1, size * 4))
                (own if d == shift == 0 else others).append(key)
    return own, others


def with_letter_counts(df: DataFrame, line: str = "line", name: str = "counts") -> DataFrame:
    """Adds three bits per letter: its count in ``line`` modulo eight.

    A letter's count is what the text loses in bytes when it is taken out; each is
    taken out of what the ones before left, so the texts shrink from step to step."""
    keep = [*df.columns, name]
    out = df.withColumns({name: F.lit(0).cast("bigint"), "_rest": F.col(line)})
    for k, c in enumerate(LETTERS):
        out = out.withColumn("_less", F.replace("_rest", F.lit(c), F.lit("")))
        count = (F.octet_length("_rest") - F.octet_length("_less")).cast("bigint").bitwiseAND(7)
        out = out.select(*[F.col(x) for x in keep if x != name], F.col(name).bitwiseOR(F.shiftleft(count, 3 * k)).alias(name), F.col("_less").alias("_rest"))
    return out.select(*keep)


def counts_agree(a: Column, b: Column, edits: int) -> Column:
    """False only for lines more than ``edits`` (3 at most) apart: each edit adds one
    letter at most and takes one away at most."""
    more, less = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for k in range(len(LETTERS)):
        d = (F.shiftright(a, 3 * k).bitwiseAND(7) - F.shiftright(b, 3 * k).bitwiseAND(7)).bitwiseAND(7)
        more += F.when(d <= 4, d).otherwise(0)
        less += F.when(d > 4, 8 - d).otherwise(0)
    return (more <= edits) & (less <= edits)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two lines (in code points) is at most ``edits``.

    Banded bit-parallel recurrence (Myers 1999, Hyyro 2003): one machine word
    holds the vertical differences of the 2 * edits + 1 cells around the
    diagonal and slides down one row per column; the distance is followed along
    the band's lower diagonal and then along the last row. Lengths must differ by
    ``edits`` at most and be at least ``edits``."""
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    def fold(s: Column) -> Column:
        m, n = s["m"], s["n"]

        def step(st: Column, j: Column) -> Column:
            here = F.substring(s["b"], j * 4 + 1, F.lit(4))
            match = F.lit(0)
            for r in range(width):
                match = match + F.when(F.substring(s["a"], (j + r) * 4 + 1, F.lit(4)) == here, 1 << r).otherwise(0)

            def diagonal(x: Column) -> Column:
                return (((x.bitwiseAND(st["vp"]) + st["vp"]).bitwiseXOR(st["vp"])).bitwiseOR(x).bitwiseOR(st["vn"])).bitwiseAND(full)

            def after(d0: Column) -> Column:
                hp = st["vn"].bitwiseOR(F.lit(full) - d0.bitwiseOR(st["vp"]))
                hn = d0.bitwiseAND(st["vp"])
                down = F.shiftright(d0, 1)
                row = F.call_function("shiftright", F.lit(top), F.greatest(F.lit(1), j - (m - edits) + 1))
                along = F.when(hp.bitwiseAND(row) != 0, 1).when(hn.bitwiseAND(row) != 0, -1).otherwise(0)
                dist = st["d"] + F.when(j < m - edits, F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)).otherwise(along)
                return F.struct(hn.bitwiseOR(F.lit(full) - down.bitwiseOR(hp)).alias("vp"), down.bitwiseAND(hp).alias("vn"), dist.alias("d"))

            return F.transform(F.transform(F.array(match), diagonal), after)[0]

        start = F.struct(F.lit(full - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["d"] <= edits

    wide = F.struct(F.concat(F.lit(b"\xff" * (4 * edits)), F.encode(a, "UTF-32")).alias("a"), F.encode(b, "UTF-32").alias("b"),
                    F.length(a).alias("m"), F.length(b).alias("n"))
    return F.transform(F.array(wide), fold)[0]


def line_links(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b): keys of all pairs of different lines within ``edits``, both of min_chars or more.

    Equal lines meet once, as one line. Two lines within ``edits`` share at least
    one of edits + 1 segments, so every link has a common key; the pairs of a key
    are cut down inside the join by their letter counts, and what is left is
    verified on the texts. For that only candidate lines are read again, picked
    by a broadcast bit map of fixed size."""
    if not 0 < edits <= 3:
        raise ValueError("edits must be 1, 2 or 3")
    spark = docs.sparkSession
    n = F.length("line")
    long_lines = lines_of(docs).where(n >= min_chars).select("line")
    # a line is its hash, length and letter counts here: its keys are worked out where it is read, and its text stays there
    own, others = segment_keys(F.col("wide"), F.col("n"), edits)
    keys = [f"k{i}" for i in range(len(own) + len(others))]
    known = (with_letter_counts(long_lines.withColumns({"wide": F.encode("line", "UTF-32"), "n": n}))
             .select(F.xxhash64("line").alias("id"), "n", "counts", *[k.alias(name) for k, name in zip([*own, *others], keys)]).distinct())
    index = known.select(F.explode(F.array(*keys[:len(own)])).alias("key"), F.col("id").alias("i"), F.col("counts").alias("ic"))
    probe = known.select(F.explode(F.array(*keys)).alias("key"), F.col("id").alias("p"), F.col("counts").alias("pc"))
    near = probe.join(index, (probe["key"] == index["key"]) & (F.col("p") != F.col("i")) & counts_agree(F.col("pc"), F.col("ic"), edits))
    pairs = stored(near.select(F.least("p", "i").alias("x"), F.greatest("p", "i").alias("y")).distinct(), "line-pairs")
    del near, probe, index, known
    release(spark)

    def place(c: Column) -> Column:
        return F.pmod(c, F.lit(MAP_BITS))

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place(c), F.lit(64)).cast("int"))

    word = lambda c: F.floor(place(c) / 64).cast("int")
    marks = (pairs.select(F.explode(F.array("x", "y")).alias("c")).groupBy(word(F.col("c")).alias("w"))
             .agg(F.bit_or(bit(F.col("c"))).alias("bits")))
    mine = long_lines.withColumn("id", F.xxhash64("line"))
    texts = (mine.join(F.broadcast(marks), word(F.col("id")) == F.col("w"))
             .where(F.col("bits").bitwiseAND(bit(F.col("id"))) != 0).select("id", "line").distinct())
    both = (pairs.join(texts.select(F.col("id").alias("x"), F.col("line").alias("a")), "x")
            .join(texts.select(F.col("id").alias("y"), F.col("line").alias("b")), "y")
            .where((F.abs(F.length("a") - F.length("b")) <= edits) & within(F.col("a"), F.col("b"), edits)))
    return both.select(line_key(F.col("a")).alias("a"), line_key(F.col("b")).alias("b"))


def repeated_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, of, gone, first_docs, n_links): numbers of the lines that go, where their
    classes start, and how many links to different lines the text's lines have.

    A class is a connected group of equal or linked lines; its first line in
    (doc_id, text key, line number) order stays. Classes of very many lines meet their
    first line by broadcast (``met``), so no class is one task."""
    links = stored(line_links(docs, edits, min_chars), "line-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = stored(connected_components(links).join(degree, "node"), "line-classes")
    release(docs.sparkSession)
    at = lines_of(docs).select("doc_id", "of", "line_no", line_key(F.col("line")).alias("h")).join(known, F.col("h") == F.col("node"), "left")
    at = stored(at.select(F.coalesce("root", "h").alias("c"), "doc_id", "of", "line_no", F.coalesce("links", F.lit(0)).alias("links")), "line-places")
    first = stored(at.groupBy("c").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.max("links").alias("l"))
                   .where("n > 1 or l > 0").drop("l"), "line-firsts")
    mine = (met(at, first, "c", F.xxhash64("doc_id", "of", "line_no")).where("met").groupBy("c", "doc_id")
            .agg(F.collect_list(F.struct("of", "line_no", "links")).alias("lines"), F.min("first_doc").alias("first_doc")))
    stays = F.when(F.col("doc_id") == F.col("first_doc"), F.array_min("lines"))
    mine = mine.select("doc_id", "first_doc", stays.alias("stays"), F.inline("lines"))
    gone = ~F.coalesce((F.col("of") == F.col("stays.of")) & (F.col("line_no") == F.col("stays.line_no")), F.lit(False))
    return (mine.groupBy("doc_id", "of")
            .agg(F.collect_list(F.when(gone, F.col("line_no"))).alias("gone"),
                 F.array_sort(F.collect_set(F.when(gone, F.col("first_doc")))).alias("first_docs"),
                 F.sum("links").alias("n_links")))


def line_dedup(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with the text's repeated lines taken out, and n_lines,
    n_removed, n_links, first_docs.

    Blank lines are no lines: they stay and never link. Null and empty texts
    stay as they are with n_lines 0; so do rows with a null doc_id, whose lines
    are not compared. Rows that repeat a doc_id and its text lose the same lines
    and never one another's; rows that repeat a doc_id with another text are
    documents of their own, the one with the smaller text key first. An empty table
    gives no rows. Columns of the result's own names are replaced."""
    new = ["n_lines", "n_removed", "n_links", "first_docs"]
    gone = repeated_lines(docs, edits, min_chars).select(F.col("doc_id").alias("_d"), F.col("of").alias("_of"), "gone", F.col("first_docs").alias("_f"),
                                                         F.col("n_links").alias("_l"))
    out = docs.drop(*new, "gone", "_d", "_of", "_f", "_l")
    out = out.join(gone, (F.col("doc_id") == F.col("_d")) & (text_key() == F.col("_of")), "left")
    whole = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    kept = F.when(F.size("gone") > 0, F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
                  ).otherwise(F.col("text"))
    return (out.withColumns({
        "n_lines": F.coalesce(F.when(F.col("doc_id").isNotNull(), F.size(whole)), F.lit(0)).cast("bigint"),
        "n_removed": F.coalesce(F.size(F.array_distinct("gone")), F.lit(0)).cast("bigint"),
        "n_links": F.coalesce("_l", F.lit(0)).cast("bigint"),
        "first_docs": F.coalesce("_f", F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")),
        "text": kept}).drop("gone", "_d", "_of", "_f", "_l"))
