"""A character model with modified Kneser-Ney smoothing: counted by Spark, kept as sorted hash arrays."""

from __future__ import annotations

import posixpath
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stforecast.llm.fill_middle import buffers, pieces
from stforecast.llm.shared import give_back, shared_folder, written
from stforecast.llm.token_files import file_system
from stforecast.session import broadcast_within

PIECE_BYTES = 1 << 20  # text taken in one step, some 100 bytes of arrays for each of its bytes
ORDER = 4  # symbols of an n-gram: four of 16 bits fill one long, so no two n-grams share a key
TABLE_ROWS = 1 << 21  # n-grams a task holds before it gives them out
SHARD_ROWS = 1 << 18  # n-grams of one array, about 6 MB
CACHE_BYTES = 96 << 20  # arrays a Python worker keeps
SUFFIX = (1 << 48) - 1
# discounts where a count of counts is missing
FALLBACK = (0.5, 1.0, 1.5)
LEAST_DISCOUNT = 0.01
COUNTED = "lg long, gram long, n long, most long"


def _folded() -> np.ndarray:
    """Symbol of every 16-bit code point: lower case, all digits as 0, ASCII white space as a space."""
    table = np.arange(1 << 16, dtype=np.uint16)
    for code in (*range(0xD800), *range(0xE000, 1 << 16)):
        low = chr(code).lower()
        if len(low) == 1 and ord(low) < 1 << 16:
            table[code] = ord(low)
    table[48:58], table[9:14] = 48, 32
    table[0] = table[0xFFFF] = 0xFFFE  # zero stands for "no symbol"
    return table


FOLD = _folded()
WORDLY = np.array([chr(c).isalnum() or 0xD800 <= c < 0xE000 for c in range(1 << 16)])


def symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of UTF-8 texts and their starts: one for each letter or digit, one for each run of
    the same other character, so that a long rule or a wide gap does not make a text look fluent."""
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    high = codes >= 1 << 16
    if high.any():  # beyond 16 bits: one of 2048 symbols that stand for no code point
        codes = np.where(high, 0xD800 + codes % 2048, codes)
    out = FOLD[codes]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | WORDLY[out[1:]]
    keep[ends[:-1][ends[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def grams(sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all full n-grams and the text each lies in."""
    if len(sym) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = sym.astype(np.uint64)
    key = wide[: len(wide) - ORDER + 1].copy()
    for k in range(1, ORDER):
        key <<= np.uint64(16)
        key |= wide[k : len(wide) - ORDER + 1 + k]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[: len(key)] == text[ORDER - 1 :]
    return key[inside].view(np.int64), text[: len(key)][inside]


def spark_hash(keys: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` gives for a long; one to one."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = (np.uint64(42 + 8) + p5) ^ (turned(keys.view(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def by_language(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, rows, bytes, starts) of pieces of a batch, each piece in one language."""
    langs = batch.column(lang).to_numpy()
    order = np.argsort(langs, kind="stable")
    edges = np.flatnonzero(np.diff(langs[order], prepend=langs[order[0]] - 1 if len(order) else 0))
    for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
        rows = order[lo:hi]
        texts = batch.column(text).take(pa.array(rows)).fill_null("")
        _, at = buffers(texts)
        for a, b in pieces(np.diff(at), PIECE_BYTES):
            yield int(langs[rows[0]]), rows[a:b], *buffers(texts.slice(a, b - a))
    give_back()


def per_text(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text and how often the text has them; a text lies in one run."""
    keys = keys.copy()
    edges = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.append(first, len(keys)))


def combined(keys: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the sum of its ``n`` and the largest of its ``most``."""
    order = np.argsort(keys)
    keys, n, most = keys[order], n[order], most[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first), np.maximum.reduceat(most, first)


def count_grams(texts: DataFrame) -> DataFrame:
    """Counts ``(lg, gram, c)`` of all n-grams of whole texts ``(lg, text)``, combined in each task first.

    No text vouches for itself: ``c`` is how often all texts of the language have the n-gram less
    what the text with the most of it has, and n-grams of one text only are left out. A task
    hands its table on when it has TABLE_ROWS entries, so that its memory is bounded whatever
    it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lg, columns in held.items():
                arrays = [pa.array(np.full(len(columns[0]), lg)), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["lg", "gram", "n", "most"])
            held.clear()

        for batch in batches:
            for lg, _, raw, at in by_language(batch, 0, 1):
                keys, text = grams(*symbols(raw, at))
                if not len(keys):
                    continue
                keys, n = per_text(keys, text)
                fresh = combined(keys, n, n)
                if lg in held:
                    fresh = combined(*(np.concatenate(x) for x in zip(held[lg], fresh, strict=True)))
                held[lg] = fresh
                if sum(len(k) for k, *_ in held.values()) > TABLE_ROWS:
                    yield from emit()
        yield from emit()

    counted = texts.mapInArrow(run, COUNTED).groupBy("lg", "gram").agg((F.sum("n") - F.max("most")).alias("c"))
    return counted.where("c > 0")


def _context(gram: str = "gram") -> Column:
    return F.shiftrightunsigned(gram, 16)


def discounts(counts: DataFrame) -> DataFrame:
    """``(lg, ord, d1, d2, d3)`` from how many n-grams were counted one to four times."""
    few = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    known = F.expr("n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0")

    def discount(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        whole = F.when(known, value).otherwise(F.lit(FALLBACK[k - 1]))
        return F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(k)), whole)).alias(f"d{k}")

    return counts.groupBy("lg", "ord").agg(*few).select("lg", "ord", *[discount(k) for k in (1, 2, 3)])


@dataclass(frozen=True)
class Model:
    """Where the arrays of a model lie; ``shards`` of each language."""

    folder: str
    shards: int


def smoothed(counted: DataFrame) -> DataFrame:
    """Probabilities ``(lg, gram, p, gamma)`` of all orders from counts ``(lg, gram, c)`` of the highest.

    Lower orders count in how many n-grams an ending occurs (continuation counts). ``p`` is
    interpolated down to the uniform distribution over the language's symbols and one unknown.
    ``gamma`` is the weight that the n-gram as a context leaves to the next lower order, null if it
    is no context. The key 0 has the probability of a symbol never seen.
    """
    orders = {ORDER: counted.select("lg", "gram", "c")}
    for k in range(ORDER - 1, 0, -1):
        longer = orders[k + 1].select("lg", F.col("gram").bitwiseAND(F.lit(SUFFIX >> (16 * (ORDER - 1 - k)))).alias("gram"))
        orders[k] = written(longer.groupBy("lg", "gram").agg(F.count("*").alias("c")))
    listed = None
    for k, table in orders.items():
        part = table.withColumn("ord", F.lit(k))
        listed = part if listed is None else listed.unionByName(part)
    cuts = written(discounts(listed))
    cuts = broadcast_within(cuts, cuts.count(), 48)  # four rows a language
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    # each n-gram takes its discount; what a context takes in all goes to the next lower order
    shared = listed.join(cuts, ["lg", "ord"]).select("lg", "ord", "gram", "c", cut.alias("d"))
    contexts = written(shared.groupBy("lg", "ord", _context().alias("context")).agg(
        F.sum("c").alias("total"), F.sum("d").alias("taken"), F.count("*").alias("kinds")))
    done, lower = [], None
    for k in range(1, ORDER + 1):
        mine = shared.where(F.col("ord") == k).withColumn("context", _context())
        totals = contexts.where(F.col("ord") == k).drop("ord")
        if k == 1:
            # one row a language: the empty context
            sizes = broadcast_within(totals.drop("context"), totals.count(), 48)
            joined = mine.join(sizes, "lg").withColumn("below", 1 / (F.col("kinds") + 1))
            done.append(totals.select("lg", F.lit(0).cast("long").alias("gram"),
                                      (F.col("taken") / F.col("total") / (F.col("kinds") + 1)).alias("p")))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit(SUFFIX >> (16 * (ORDER - k))))
            below = lower.select("lg", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = mine.withColumn("suffix", suffix).join(totals, ["lg", "context"]).join(below, ["lg", "suffix"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("taken") / F.col("total") * F.col("below")
        lower = joined.select("lg", "gram", p.alias("p"))
        if k < ORDER:
            lower = written(lower)
        done.append(lower)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    left = contexts.where("ord > 1").select("lg", F.col("context").alias("gram"), (F.col("taken") / F.col("total")).alias("gamma"))
    return every.join(left, ["lg", "gram"], "left")


def fit(docs: DataFrame) -> Model:
    """Count, smooth and write the model of ``(lg, text)``: for each language and each value of
    the last bits of the hash a file of arrays sorted by hash (hash, log p, log gamma)."""
    spark = docs.sparkSession
    counted = written(count_grams(docs))
    largest = counted.groupBy("lg").count().agg(F.max("count")).first()[0] or 1
    shards = 1 << max(0, (int(largest) * 4 // 3 // SHARD_ROWS).bit_length())
    hashed = F.xxhash64("gram")
    rows = smoothed(counted).select(
        "lg", hashed.bitwiseAND(F.lit(shards - 1)).cast("int").alias("shard"), hashed.alias("hash"),
        F.log("p").alias("logp"), F.log("gamma").alias("logb"))
    folder = shared_folder(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "lg", "shard").sortWithinPartitions("lg", "shard", "hash").write.partitionBy(
        "lg", "shard").parquet(folder)
    return Model(folder, shards)


class Arrays:
    """Look-ups in a model's files; the arrays used last are kept, up to CACHE_BYTES."""

    def __init__(self, model: Model):
        self.model, self.kept = model, OrderedDict()
        self.fs, self.base = file_system(model.folder)
        self.bytes = 0

    def shard(self, lg: int, shard: int) -> tuple[np.ndarray, ...]:
        name = (lg, shard)
        if name in self.kept:
            self.kept.move_to_end(name)
            return self.kept[name]
        place = posixpath.join(self.base, f"lg={lg}", f"shard={shard}")
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(place, allow_not_found=True))
        files = [f.path for f in found if f.path.endswith(".parquet")]
        parts = []
        for path in files:
            with self.fs.open_input_file(path) as source:
                parts.append(pq.ParquetFile(source).read(["hash", "logp", "logb"]))
        if parts:
            whole = pa.concat_tables(parts)
            arrays = tuple(whole.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("hash", "logp", "logb"))
            if len(parts) > 1:
                order = np.argsort(arrays[0])
                arrays = tuple(a[order] for a in arrays)
        else:
            arrays = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.bytes += sum(a.nbytes for a in arrays)
        while self.kept and self.bytes > CACHE_BYTES:
            self.bytes -= sum(a.nbytes for a in self.kept.popitem(last=False)[1])
        self.kept[name] = arrays
        return arrays

    def find(self, lg: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p and log gamma of keys, nan where there is none."""
        logp, logb = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
        hashes = spark_hash(keys)
        if self.model.shards == 1:
            groups = [(0, slice(None))]
        else:
            shard = hashes & (self.model.shards - 1)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
            groups = [(s, order[edges[s] : edges[s + 1]]) for s in np.flatnonzero(np.diff(edges)).tolist()]
        for s, rows in groups:
            known, p, b = self.shard(lg, s)
            if not len(known):
                continue
            wanted = hashes[rows]
            at = np.searchsorted(known, wanted)
            at[at == len(known)] = 0
            hit = known[at] == wanted
            logp[rows], logb[rows] = np.where(hit, p[at], np.nan), np.where(hit, b[at], np.nan)
        return logp, logb

    def log_probabilities(self, lg: int, keys: np.ndarray) -> np.ndarray:
        """log p of the last symbol of each n-gram; one never seen backs off to shorter ones."""
        out, weight = np.full(len(keys), np.nan), np.zeros(len(keys))
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            logp, _ = self.find(lg, keys)
            known = ~np.isnan(logp)
            out[left[known]] = (weight + logp)[known]
            left, keys, weight = left[~known], keys[~known], weight[~known]
            if not len(left):
                return out
            if k > 1:
                _, logb = self.find(lg, (keys.view(np.uint64) >> np.uint64(16)).view(np.int64))
                weight = weight + np.nan_to_num(logb)  # a context never seen leaves everything
                keys = keys & (SUFFIX >> (16 * (ORDER - k)))
        unknown, _ = self.find(lg, np.zeros(1, np.int64))
        out[left] = weight + unknown[0]
        return out
