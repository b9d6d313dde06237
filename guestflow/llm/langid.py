"""Language identification by interpolated Kneser-Ney character models."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestflow.llm.common import stored, text_key, text_slices, without

ORDER = 4
SPACE, START = 32, 2
#: Characters scored at once: each takes some dozens of bytes while it is.
SLICE_CHARS = 1_000_000
#: Model cells (character sequences times languages) that may be broadcast at
#: once. Larger models are made by Spark and broadcast in parts, with equal scores.
MAX_CELLS = 8_000_000
#: Counts of the model of all learning documents and of those of each half.
MODELS = ("n", "n0", "n1")
#: A prediction is rejected beyond SLACK times the QUANTILE of the excess
#: cross-entropy that learning documents show under a model of the other half of
#: them. Other languages and gibberish exceed it many times over.
QUANTILE, SLACK = 0.999, 2.0


def _letters() -> np.ndarray:
    """Code point (basic plane) to symbol: a letter is itself, all else is a space."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(0x10000)], np.uint64)


class Symbols:
    """Texts to symbol arrays: lower-cased letters, runs of anything else one space,
    ORDER - 1 start marks before each text and a space after it."""

    def __init__(self):
        self.table = _letters()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in one array, and the text each belongs to."""
        lowered = [(t or "").lower() for t in texts]
        raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) for t in lowered], np.int64)
        sym = np.where(raw < 0x10000, self.table[np.minimum(raw, 0xFFFF)], SPACE)
        for i in np.flatnonzero(raw >= 0x10000).tolist():
            c = int(raw[i])
            sym[i] = 0xD800 + (c & 0x7FF) if chr(c).isalpha() else SPACE
        pad = ORDER - 1
        new = sizes + pad + 1
        first = np.cumsum(new) - new
        out = np.full(int(new.sum()), SPACE, np.uint64)
        row = np.repeat(np.arange(len(texts)), new)
        place = np.arange(len(out)) - first[row]
        out[place < pad] = START
        out[(place >= pad) & (place < pad + sizes[row])] = sym
        again = np.zeros(len(out), bool)
        again[1:] = (out[1:] == SPACE) & (out[:-1] != START) & (out[:-1] == SPACE)
        # a leading blank adds nothing to the start marks
        again[1:] |= (out[1:] == SPACE) & (out[:-1] == START)
        return out[~again], row[~again]


def _grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Packed k symbols (16 bits each) ending at every position from ORDER - 1 on."""
    n, out = len(sym) - (ORDER - 1), np.zeros(max(0, len(sym) - (ORDER - 1)), np.uint64)
    for i in range(ORDER - k, ORDER):
        out = (out << np.uint64(16)) | sym[i:i + n]
    return out


def _hash(g: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit mix, so equal hashes are equal sequences."""
    with np.errstate(over="ignore"):
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def learning(lang: str = "lang", doc_id: str = "doc_id") -> Column:
    """Rows whose text and language may be learned from."""
    return (F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0)) != 1) & F.col(lang).isNotNull()


def half() -> Column:
    """The half (0 or 1) of the learning rows that a document belongs to."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1) over every learning document: counts of ORDER symbols
    in each half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols()
        for b in text_slices(batches, chars=SLICE_CHARS):
            langs, halves = b.column("lang").to_pylist(), b.column("half").to_numpy()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs]) * 2 + halves
            sym, row = symbols(b.column("text").to_pylist())
            if len(sym) < ORDER:
                continue
            grams, row = _grams(sym, ORDER), row[ORDER - 1:]
            ok = sym[ORDER - 1:] != START
            for k in range(2 * len(names)):
                g, n = np.unique(grams[ok & (code[row] == k)], return_counts=True)
                if len(g):
                    n = [pa.array(n * (k % 2 == h)) for h in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([names[k // 2]] * len(g)), pa.array(g.view(np.int64)), *n],
                                                     ["lang", "gram", "n0", "n1"])

    counted = docs.where(learning()).select("lang", "text", half()).mapInArrow(run, "lang string, gram bigint, n0 bigint, n1 bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class HashArray:
    """Sorted hashes with a table of where each leading-bits bucket begins."""

    def __init__(self, keys: np.ndarray):
        self.hashes = np.sort(_hash(keys))
        self.bits = max(8, min(22, int(len(keys)).bit_length() + 2))
        edge = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.begin = np.append(np.searchsorted(self.hashes, edge), len(self.hashes)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.hashes):
            return np.full(len(keys), -1, np.int32)
        h = _hash(keys)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        last = len(self.hashes) - 1
        out = np.where((at < end) & (self.hashes[np.minimum(at, last)] == h), at, -1)
        rest = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            got = self.hashes[at[rest]] == h[rest]
            out[rest[got]] = at[rest[got]]
            rest = rest[~got & (at[rest] + 1 < end[rest])]
        return out


class KneserNey:
    """Log probabilities of all languages for every seen sequence of 1 to ORDER
    symbols, and the weights for going down an order, in sorted hash arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.size = len(np.unique(gram & np.uint64(0xFFFF))) + 1
        self.floor = -np.log(self.size)
        counts = [self._orders(gram[lang == k], n[lang == k]) for k in range(len(langs))]
        self.seen, self.logp, self.down, self.weight = {}, {}, {}, {}
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c[k][0] for c in counts)]))
            arr = HashArray(keys)
            keys = keys[np.argsort(_hash(keys))]
            ctx = np.unique(keys >> np.uint64(16))
            down = HashArray(ctx)
            ctx = ctx[np.argsort(_hash(ctx))]
            logp, weight = np.zeros((len(keys), len(langs)), np.float32), np.zeros((len(ctx), len(langs)), np.float32)
            lower = self._lower(keys, k)
            for j, c in enumerate(counts):
                g, m, total, kinds, cg, d = c[k]
                at = np.searchsorted(cg, ctx)
                ok = (at < len(cg)) & (cg[np.minimum(at, max(len(cg) - 1, 0))] == ctx) if len(cg) else np.zeros(len(ctx), bool)
                gamma = np.ones(len(ctx))
                gamma[ok] = d * kinds[at[ok]] / total[at[ok]]
                weight[:, j] = np.log(gamma)
                ci = down.find(keys >> np.uint64(16))
                p = gamma[ci] * np.exp(lower[:, j])
                at = np.searchsorted(g, keys)
                ok = (at < len(g)) & (g[np.minimum(at, max(len(g) - 1, 0))] == keys) if len(g) else np.zeros(len(keys), bool)
                tot = total[np.searchsorted(cg, keys[ok] >> np.uint64(16))]
                p[ok] += np.maximum(m[at[ok]] - d, 0) / tot
                logp[:, j] = np.log(np.maximum(p, 1e-12))
            self.seen[k], self.logp[k], self.down[k], self.weight[k] = arr, logp, down, weight

    @staticmethod
    def _orders(gram: np.ndarray, n: np.ndarray) -> dict:
        """Per order: sequences, their counts (how many symbols precede them, below
        the highest order), and per context the total, the kinds and the discount."""
        out, order = {}, np.argsort(gram)
        g, m = gram[order], n[order].astype(np.float64)
        for k in range(ORDER, 0, -1):
            n1, n2 = (m == 1).sum(), (m == 2).sum()
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            ctx, inv = np.unique(g >> np.uint64(16), return_inverse=True)
            out[k] = (g, m, np.bincount(inv, m, len(ctx)), np.bincount(inv, minlength=len(ctx)).astype(float), ctx, d)
            mask = np.uint64((1 << (16 * (k - 1))) - 1)
            g, m = np.unique(g & mask, return_counts=True)
            m = m.astype(np.float64)
        return out

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log probability of each sequence one order down."""
        if k == 1:
            return np.full((len(keys), len(self.langs)), self.floor)
        return self.score(keys & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)

    def score(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log probability (rows by languages) of the last symbol of packed sequences."""
        at = self.seen[k].find(keys)
        out = self.logp[k][at] if len(self.logp[k]) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            rest = keys[miss]
            down = self._lower(rest, k).astype(np.float32)
            ctx = self.down[k].find(rest >> np.uint64(16))
            seen = ctx >= 0
            down[seen] += self.weight[k][ctx[seen]]
            out[miss] = down
        return out


def fit(counts: DataFrame, langs: list[str]) -> list[KneserNey]:
    """The model from all learning documents, and those from each half of them."""
    pdf = counts.toPandas()
    code = pdf["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)
    gram = pdf["gram"].to_numpy(np.int64).view(np.uint64)
    models = []
    for c in MODELS:
        n = pdf[c].to_numpy(np.int64)
        models.append(KneserNey(langs, code[n > 0], gram[n > 0], n[n > 0]))
    return models


def _entropy(kn: KneserNey, sym: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of every row under every language, and its number of symbols."""
    sums, n = np.zeros((rows, len(kn.langs))), np.zeros(rows, np.int64)
    if len(sym) >= ORDER and kn.langs:
        real = sym[ORDER - 1:] != START
        grams, row = _grams(sym, ORDER)[real], row[ORDER - 1:][real]
        for lo in range(0, len(grams), 1 << 18):
            g, r = grams[lo:lo + (1 << 18)], row[lo:lo + (1 << 18)]
            cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            sums[r[cut]] += np.add.reduceat(kn.score(g, ORDER), cut, axis=0, dtype=np.float64)
            n[r[cut]] += np.diff(np.append(cut, len(r)))
    return -sums / np.maximum(n, 1)[:, None], n


def cross_entropies(docs: DataFrame, models: list[KneserNey]) -> DataFrame:
    """(doc_id, of, lang, best, entropy, fresh, sure, symbols): the nearest language of every
    whole text (``of`` is its key), its cross-entropy per symbol, for learning rows that of their own
    language under the other half's model, and the posterior among the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (kn, *halves), symbols = shared.value, Symbols()
        place = {x: k for k, x in enumerate(kn.langs)}
        for b in text_slices(batches, chars=SLICE_CHARS):
            rows = b.num_rows
            sym, row = symbols(b.column("text").to_pylist())
            letters = np.bincount(row[(sym != START) & (sym != SPACE)], minlength=rows)
            ce, n = _entropy(kn, sym, row, rows)
            usable = (letters > 0) & bool(kn.langs)
            best, low, sure, fresh = np.zeros(rows, int), np.zeros(rows), np.zeros(rows), np.full(rows, np.nan)
            if kn.langs:
                best = ce.argmin(axis=1)
                low = ce[np.arange(rows), best]
                sure = np.where(usable, 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, 40)[:, None]).sum(axis=1), 0)
                own = np.array([place.get(x, -1) for x in b.column("lang").to_pylist()])
                learned = b.column("learned").to_numpy(zero_copy_only=False).astype(bool) & (own >= 0) & usable
                for h in (0, 1):
                    mine = learned & (b.column("half").to_numpy() != h)
                    keep = mine[row]
                    fresh[mine] = _entropy(halves[h], sym[keep], row[keep], rows)[0][mine, own[mine]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("of"), b.column("lang"), pa.array([kn.langs[k] if ok else None for k, ok in zip(best, usable)], pa.string()),
                 pa.array(low), pa.array(fresh, from_pandas=True), pa.array(sure), pa.array(n)],
                ["doc_id", "of", "lang", "best", "entropy", "fresh", "sure", "symbols"])

    return docs.select("doc_id", text_key().alias("of"), F.col("lang").cast("string").alias("lang"), learning().alias("learned"), half(), "text").mapInArrow(
        run, f"doc_id {kind}, of bigint, lang string, best string, entropy double, fresh double, sure double, symbols bigint")


def _terms(counts: DataFrame, langs: list[str]) -> tuple[DataFrame, list[float]]:
    """(j, kind, key, n, n0, n1): the models as terms that add up, made by Spark,
    and what a symbol costs at the floor of each model.

    The score of a symbol is that of its longest seen sequence, plus the weights
    of the longer contexts. So with each seen context of order k giving its
    weight (kind 2k - 1) and each seen sequence what its own score lies above its
    context's weight and its suffix's score (kind 2k - 2), the terms found for a
    symbol, and the floor, add up to its score, in whatever parts they are looked
    up. n, n0 and n1 are the terms in the model of that name, 0 if not seen there."""
    spark = counts.sparkSession
    place = spark.createDataFrame(list(enumerate(langs)), "j int, lang string")
    table = counts.join(F.broadcast(place), "lang").select("j", F.col("gram").alias("key"), *MODELS)
    orders = {ORDER: table}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("key").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("key")
        seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in MODELS]
        orders[k] = stored(orders[k + 1].groupBy("j", tail).agg(*seen), f"order{k}")
    sizes = orders[1].agg(*(F.count_distinct(F.when(F.col(c) > 0, F.col("key"))).alias(c) for c in MODELS)).first()
    out, lower = [], None
    for k in range(1, ORDER + 1):
        table = orders[k].withColumn("ctx", F.shiftrightunsigned("key", 16))
        rare = table.groupBy("j").agg(*(F.sum((F.col(c) == i).cast("long")).alias(f"{c}_{i}") for c in MODELS for i in (1, 2)))
        d = {c: F.when(F.col(f"{c}_1") + F.col(f"{c}_2") > 0, F.least(F.lit(0.95), F.greatest(
            F.lit(0.1), F.col(f"{c}_1") / (F.col(f"{c}_1") + 2 * F.col(f"{c}_2"))))).otherwise(0.5) for c in MODELS}
        rare = F.broadcast(rare.select("j", *(d[c].alias(f"d_{c}") for c in MODELS)))
        ctx = table.groupBy("j", "ctx").agg(*(F.sum(c).alias(f"all_{c}") for c in MODELS),
                                            *(F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in MODELS))
        ctx = ctx.join(rare, "j")
        for c in MODELS:
            ctx = ctx.withColumn(f"w_{c}", F.when(F.col(f"all_{c}") > 0, F.log(F.col(f"d_{c}") * F.col(f"kinds_{c}") / F.col(f"all_{c}"))))
        ctx = stored(ctx, f"contexts{k}")
        table = table.join(ctx, ["j", "ctx"])
        if k == 1:
            table = table.select("*", *(F.lit(-float(np.log(sizes[c] + 1))).alias(f"low_{c}") for c in MODELS))
        else:
            tail = F.col("key").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            table = table.withColumn("tail", tail).join(lower, ["j", "tail"])
        for c in MODELS:
            p = F.greatest(F.col(c) - F.col(f"d_{c}"), F.lit(0)) / F.col(f"all_{c}") + F.exp(F.col(f"w_{c}") + F.col(f"low_{c}"))
            table = table.withColumn(f"p_{c}", F.when(F.col(c) > 0, F.log(F.greatest(p, F.lit(1e-12)))))
        table = stored(table.select("j", "key", *(F.col(f"p_{c}") for c in MODELS),
                                    *((F.col(f"p_{c}") - F.col(f"w_{c}") - F.col(f"low_{c}")).alias(c) for c in MODELS)), f"scores{k}")
        lower = table.select("j", F.col("key").alias("tail"), *(F.col(f"p_{c}").alias(f"low_{c}") for c in MODELS))
        out.append(table.select("j", F.lit(2 * k - 2).alias("kind"), "key", *MODELS))
        out.append(ctx.select("j", F.lit(2 * k - 1).alias("kind"), F.col("ctx").alias("key"), *(F.col(f"w_{c}").alias(c) for c in MODELS)))
    terms = reduce(DataFrame.unionByName, out)
    return terms.select("j", "kind", "key", *(F.coalesce(F.col(c), F.lit(0.0)).cast("float").alias(c) for c in MODELS)), [
        float(np.log(sizes[c] + 1)) for c in MODELS]


class Terms:
    """Some of the terms of some languages, by language and kind in hash arrays."""

    def __init__(self, j: np.ndarray, kind: np.ndarray, key: np.ndarray, values: np.ndarray, langs: list[int]):
        self.langs, self.tables = langs, {}
        group = j.astype(np.int64) * (2 * ORDER) + kind
        order = np.lexsort((_hash(key), group))
        start, n = np.unique(group[order], return_index=True)[1], len(group)
        for lo, hi in zip(start, np.append(start[1:], n)):
            at = order[lo:hi]
            self.tables[divmod(int(group[at[0]]), 2 * ORDER)] = HashArray(key[at]), values[at]

    def sums(self, grams: np.ndarray, lang: int) -> np.ndarray:
        """What the terms of a language give each packed sequence in each model."""
        out = np.zeros((len(grams), len(MODELS)))
        for kind in range(2 * ORDER):
            table = self.tables.get((lang, kind))
            if table:
                key = grams & np.uint64((1 << (16 * (kind // 2 + 1))) - 1)
                at = table[0].find(key >> np.uint64(16) if kind % 2 else key)
                seen = at >= 0
                out[seen] += table[1][at[seen]]
        return out


def _term_sums(docs: DataFrame, shared, langs: list[str]) -> DataFrame:
    """(row, j, s, f, symbols, letters): the sum of a part's terms over every text for each
    of the part's languages, and for learning rows that of the other half's model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, symbols = shared.value, Symbols()
        place = {x: k for k, x in enumerate(langs)}
        for b in text_slices(batches, chars=SLICE_CHARS):
            rows = b.num_rows
            sym, row = symbols(b.column("text").to_pylist())
            letters = np.bincount(row[(sym != START) & (sym != SPACE)], minlength=rows)
            real = sym[ORDER - 1:] != START
            grams, row = _grams(sym, ORDER)[real], row[ORDER - 1:][real]
            n = np.bincount(row, minlength=rows)
            kinds, inv = np.unique(grams, return_inverse=True)
            own = np.array([place.get(x, -1) for x in b.column("lang").to_pylist()])
            learned = b.column("learned").to_numpy(zero_copy_only=False).astype(bool) & (letters > 0)
            other = 2 - b.column("half").to_numpy()
            for j in terms.langs:
                value = terms.sums(kinds, j)
                s = np.stack([np.bincount(row, value[inv, m], rows) for m in range(len(MODELS))], axis=1)
                f = np.where(learned & (own == j), s[np.arange(rows), other], np.nan)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), pa.array(np.full(rows, j, np.int32)), pa.array(s[:, 0]), pa.array(f, from_pandas=True),
                     pa.array(n), pa.array(letters)], ["row", "j", "s", "f", "symbols", "letters"])

    return docs.mapInArrow(run, "row bigint, j int, s double, f double, symbols bigint, letters bigint")


def cross_entropies_in_parts(docs: DataFrame, counts: DataFrame, langs: list[str]) -> DataFrame:
    """What ``cross_entropies`` gives, with models of any size: their terms are
    broadcast one part (whole languages, or a hash range of one) at a time, and
    each text's sums added up."""
    spark = docs.sparkSession
    docs = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key().alias("of"), F.col("lang").cast("string").alias("lang"),
                              learning().alias("learned"), half(), "text"), "rows")
    terms, floors = _terms(counts, langs)
    terms, room = stored(terms, "terms"), max(1, MAX_CELLS // 4)
    plan, parts, left = [], [], 0
    for j, rows in sorted((r["j"], r["count"]) for r in terms.groupBy("j").count().collect()):
        if rows <= left:
            parts[-1].append(j)
            plan.append((j, len(parts) - 1, 1))
            left -= rows
        else:
            ranges = -(-rows // room)
            plan.append((j, len(parts), ranges))
            parts += [[j] for _ in range(ranges)]
            left = room - rows if ranges == 1 else 0
    plan = spark.createDataFrame(plan, "j int, first int, ranges int")
    part = F.col("first") + F.pmod(F.xxhash64("key"), F.col("ranges"))
    terms = stored(terms.join(F.broadcast(plan), "j").withColumn("part", part.cast("int")).drop("first", "ranges")
                   .repartitionByRange("part").sortWithinPartitions("part"), "parts")
    sums = []
    for k, members in enumerate(parts):
        pdf = terms.where(F.col("part") == k).drop("part").toPandas()
        shared = spark.sparkContext.broadcast(Terms(
            pdf["j"].to_numpy(), pdf["kind"].to_numpy(), pdf["key"].to_numpy(np.int64).view(np.uint64), pdf[list(MODELS)].to_numpy(np.float32), members))
        del pdf
        sums.append(stored(_term_sums(docs.select("row", "lang", "learned", "half", "text"), shared, langs), "sums"))
        shared.destroy()
    each = reduce(DataFrame.unionByName, sums).groupBy("row", "j").agg(
        F.sum("s").alias("s"), F.sum("f").alias("f"), F.max("symbols").alias("symbols"), F.max("letters").alias("letters"))
    per, names = F.greatest("symbols", F.lit(1)), F.array(*map(F.lit, langs))
    each = each.select("row", "symbols", "letters", "j", ((F.col("symbols") * floors[0] - F.col("s")) / per).alias("ce"), "f")
    best = each.groupBy("row").agg(F.max("symbols").alias("symbols"), F.max("letters").alias("letters"), F.max("f").alias("f"),
                                   F.collect_list("ce").alias("ces"), F.min(F.struct("ce", "j")).alias("least"))
    floor = F.when(F.col("half") == 0, floors[2]).otherwise(floors[1])
    ok, reach = F.col("letters") > 0, F.least("symbols", F.lit(40))
    weight = F.aggregate("ces", F.lit(0.0), lambda acc, x: acc + F.exp((F.col("least.ce") - x) * reach))
    return docs.drop("text").join(best, "row").select(
        "doc_id", "of", "lang", F.when(ok, F.get(names, F.col("least.j"))).alias("best"), F.col("least.ce").alias("entropy"),
        ((F.col("symbols") * floor - F.col("f")) / F.greatest("symbols", F.lit(1))).alias("fresh"),
        F.when(ok, 1 / weight).otherwise(0.0).alias("sure"), "symbols")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, of, held_out, lang_pred, score, rejected) of every row; ``of`` is the key of its text.

    The language is the one with the lowest cross-entropy per symbol; ``und``
    with score 0 if the text is null or has no letter (or nothing can be
    learned). score is the posterior over the learned languages for at most 40
    symbols. rejected marks ``und`` and texts unlike every language: their excess
    over the mean cross-entropy, which shrinks as one over the root of the
    length, lies beyond SLACK times the QUANTILE of fresh text of the predicted
    language. Fresh text is every learning row, scored by a model of the half of
    the learning rows that it is not in. Rows with a null lang are predicted, not
    learned from; null doc_ids count as learning rows. Repeated rows give a row
    each, an empty table none; other columns are not read."""
    counts = stored(gram_counts(docs), "grams").withColumn("n", F.col("n0") + F.col("n1"))
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if counts.count() * len(langs) <= MAX_CELLS:
        scored = stored(cross_entropies(docs, fit(counts, langs)), "entropy")
    else:
        scored = stored(cross_entropies_in_parts(docs, counts, langs), "entropy")
    reach = F.sqrt(F.least("symbols", F.lit(400)))
    own = scored.where(F.col("fresh").isNotNull() & (F.col("best") == F.col("lang")))
    mean = own.groupBy("best").agg((F.sum(F.col("fresh") * F.col("symbols")) / F.sum("symbols")).alias("mean"))
    # exact quantile: counts per thousandth of the excess, summed up per language
    cell = F.ceil((F.col("fresh") - F.col("mean")) * reach * 1000)
    cells = own.join(F.broadcast(mean), "best").groupBy("best", cell.alias("cell")).agg(F.count("*").alias("n"))
    whole, upto = Window.partitionBy("best"), Window.partitionBy("best").orderBy("cell")
    limit = (cells.withColumn("all", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(upto))
             .where(F.col("upto") >= QUANTILE * F.col("all")).groupBy("best").agg((F.min("cell") / 1000).alias("limit")))
    scored = scored.join(F.broadcast(mean.join(limit, "best")), "best", "left")
    far = (F.col("entropy") - F.col("mean")) * reach > SLACK * F.greatest("limit", F.lit(0.5))
    return scored.select(
        "doc_id", "of", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.coalesce("best", F.lit("und")).alias("lang_pred"), F.col("sure").alias("score"),
        (F.col("best").isNull() | F.coalesce(far, F.lit(False))).alias("rejected"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row (``judged``)."""
    return judged(docs).drop("of")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected; null and repeated ids
    are told apart by their texts."""
    return without(docs, judged(docs).where("rejected"))
