"""Near duplicates by bottom-k sketches: inverted lists, union-sketch filter, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.components import components, extended
from stforecast.llm.shared import columns_of, give_back, query, table, written

NO_ID = -(2**63)  # stands for a null doc_id inside joins
SKETCH = 64
MISSED = 1e-9  # chance that a pair right at the limit is not found by its sketches
OFFERS = 12  # of a text's rarest lists, from which it is offered a member
BEST = 3  # links each text tries first
PIECE_BYTES = 2 << 20  # text hashed in one step
TRIES = 6  # links each text tries with the hubs of its lists
SKETCH_SCHEMA = "id long, text_id string, n int, print binary, sketch array<long>"
SET_SCHEMA = "id long, print binary, shingles binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (64 bit) of each text.

    Words are runs of anything but ASCII white space after lower-casing A-Z. A text of fewer than
    ``width`` words is one shingle of all its words; without words the set is empty.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    coded = words.filter(pa.array(real)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in names), np.uint64, len(names))
    hashes = known[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    factors = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1)) for i in range(width)]

    def joined(words: np.ndarray, n: int) -> np.ndarray:
        count = len(words) - n + 1
        return _mix(reduce(np.add, [words[i : i + count] * factors[i] for i in range(n)]) + np.uint64(n))

    runs = joined(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)
    for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield joined(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def parts(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
    """Rows (id, ..., text) in pieces of bounded bytes, whole texts each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, "right")))
        yield [column.slice(at, to - at) for column in batch.columns]
        give_back()
        at = to


def print_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Set size, 128-bit print of the set and its k smallest hashes, per row (id, text_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, names, texts in parts(batch):
                n, prints, low = [], [], []
                for s in shingle_sets(texts, width):
                    n.append(len(s))
                    prints.append(print_of(s))
                    low.append(s[:k].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(low)))
                yield pa.RecordBatch.from_arrays(
                    [ids, names, pa.array(n, pa.int32()), pa.array(prints, pa.binary()), sketch],
                    [c.split()[0] for c in SKETCH_SCHEMA.split(", ")],
                )

    return docs.mapInArrow(run, SKETCH_SCHEMA)


def full_sets(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The full set of each node ``(rep, id, print)``, from the rows with its id and its print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in parts(batch):
                sets = list(shingle_sets(texts, width))
                arrays = [ids, pa.array([print_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "print", "shingles"])

    wanted = texts.select("id", "text").join(members.select("id").distinct(), "id", "left_semi")
    known = wanted.mapInArrow(run, SET_SCHEMA).join(members, ["id", "print"])
    return known.select(F.col("rep").alias("id"), "shingles").dropDuplicates(["id"])


def least_overlap(k: int, percent: int) -> int:
    """Common values that the sketches of two linked larger sets have, but for a chance MISSED."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > MISSED:
            return c
    return k


def needed(n: Column, k: int, percent: int) -> Column:
    """Common values that the sketch of a set of ``n`` shingles has with that of any linked set.

    A set of up to k shingles is its own sketch: exact bounds, from the partner's size at most
    n / similarity. For larger sets the common values among the k smallest of the union are a
    sample without replacement, with a binomial lower bound.
    """
    exact = F.least(F.ceil(n * percent / 100), F.ceil(k - n * (100 - percent) / percent))
    return F.when(n <= k, exact).otherwise(F.lit(least_overlap(k, percent))).cast("int")


def rare_lists(values: DataFrame, common: Column) -> DataFrame:
    """Inverted lists (v, rep, n, place, turn) of values (rep, n, s, v), ``s`` of them of each node.

    The values of a node are put in one order for all: by how many nodes have them, then by
    themselves. Two nodes with ``common`` values or more in common have the first of these
    within the first ``s - common + 1`` places of either, so the lists hold those only; a value
    of one node alone takes a place and no row. ``turn`` counts a node's own rows.
    """
    shared = written(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    own = Window.partitionBy("rep")
    placed = values.join(shared, "v").withColumns({
        "turn": F.row_number().over(own.orderBy("c", "v")), "alone": F.col("s") - F.count("*").over(own),
    }).withColumn("place", F.col("turn") + F.col("alone"))
    lists = placed.where(F.col("place") <= F.col("s") - common + 1)
    return written(lists.select("v", "rep", "n", "place", "turn"))


def largest_partner(percent: int) -> Column:
    """How many shingles a set may have that is linked with a row of ``rare_lists`` of full sets
    and meets it first at that place: none of the values before is common."""
    common = F.col("n") - F.col("place") + 1
    most = F.floor(common * (100 + percent) / percent) - F.col("n")
    return F.least(F.floor(F.col("n") * 100 / percent), most).cast("long")


def size_class(n: Column) -> Column:
    """Sizes in steps of a tenth, so that a list is joined in pieces."""
    return F.floor(F.log(n.cast("double")) / math.log(1.1)).cast("int")


def sized(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def sketch_filter(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves a link possible, with the estimate ``similar``."""
    side = nodes.select("rep", "sketch")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(
        side.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    both = both.withColumn("low", F.expr("array_intersect(sa, sb)")).withColumn(
        # the hashes are stored signed, their order is unsigned
        "union", F.expr(f"""slice(array_sort(array_union(sa, sb), (x, y) ->
            CASE WHEN (x < 0) = (y < 0) THEN CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END
                 WHEN x < 0 THEN 1 ELSE -1 END), 1, {k})""")
    )
    both = both.withColumns({"common": F.size(F.array_intersect("union", "low")), "of": F.size("union")})
    possible = F.when(F.col("of") < k, 100 * F.col("common") >= percent * F.col("of")).otherwise(
        F.col("common") >= least_overlap(k, percent)
    )
    return both.where(possible).select(*pairs.columns, (F.col("common") / F.col("of")).alias("similar"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked by the exact Jaccard similarity of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.select("a", "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"
    ).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.mapInArrow(run, "a long, b long").distinct()


def shingle_rows(sets: DataFrame) -> DataFrame:
    """Full sets as rows (rep, n, s, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, shingles in zip(batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
                values = np.frombuffer(shingles.as_buffer(), np.int64)
                size = np.full(len(values), len(values), np.int32)
                columns = [np.full(len(values), rep, np.int64), size, size, values]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rep", "n", "s", "v"])

    return sets.select("id", "shingles").mapInArrow(run, "rep long, n int, s int, v long")


def mixed(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows, with their ``component``, of lists whose members are not yet all in one."""
    now = written(lists.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")))
    open_ = now.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return now.join(written(open_.select("v")), "v", "left_semi")


def main_components(rows: DataFrame) -> DataFrame:
    """The component that has most members of each list (v, main)."""
    counts = rows.groupBy("v", "component").agg(F.count("*").alias("c"))
    return counts.groupBy("v").agg(F.max(F.struct("c", "component")).alias("x")).select("v", F.col("x.component").alias("main"))


def offered_again(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes outside the main component of a list of full sets and the list's hub:
    the member of the main component that comes first by its place, so with the fewest values that
    are its own or rare. Copies edited in different places are closer to it than to each other.
    One pair at most for each row of the lists, and TRIES of each node, those from most lists
    first. Sizes and places leave a link possible."""
    known = rows.join(written(main_components(rows)), "v")
    chosen = F.min(F.struct("place", F.xxhash64("v", "rep").alias("h"), F.col("rep").alias("p"),
                            F.col("n").alias("pn"), F.col("most").alias("pmost"))).alias("x")
    picked = written(known.where("component = main").groupBy("v").agg(chosen).select("v", "x.p", "x.pn", "x.pmost"))
    pairs = known.where("component <> main").join(picked, "v").where(
        sized("n", "pn", percent) & (F.col("n") <= F.col("pmost")) & (F.col("pn") <= F.col("most")))
    counts = pairs.groupBy(F.col("rep").alias("a"), F.col("p").alias("b")).agg(F.count("*").alias("c"))
    ranked = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return counts.withColumn("r", F.row_number().over(ranked)).where(f"r <= {TRIES}").select("a", "b")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """The component of every document under links of Jaccard similarity ``percent`` or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document's set is its
    distinct shingles of ``width`` words (A-Z lower-cased, ASCII white space between words), all
    its words as one shingle if there are fewer; without words it is empty and linked with
    nothing, equal empty texts neither. Returns doc_id, n_shingles, component_id (the smallest
    doc_id reachable) and kept. Equal texts are always linked. A null doc_id counts as the
    smallest. Rows that repeat a doc_id, or have none, keep the links of their own texts: each
    text is a node, ids are attached last, and of a component the rows with its smallest doc_id
    and, of those, one text are kept. An empty table gives no rows.

    1. One pass makes bottom-k sketches. Equal sets become one node, so copies cost nothing more.
    2. Inverted lists of the sketch values that occur more than once. Two linked nodes have at
       least ``needed`` values in common, so only the rarest ``k - needed + 1`` of a node are
       listed: values of passages that many documents share fall out unless a node is made of them.
    3. Each node is offered the member that a hash picks from each of its OFFERS rarest lists;
       the BEST by union-sketch estimate are confirmed on the full sets. This joins large groups
       without their pairs; what it leaves out the next step finds.
    4. What lists still hold in several components is listed again by its full sets. In each
       list, the nodes outside its most frequent component first meet its hub, see
       ``offered_again``. Then those that are still outside meet the nodes of all other components
       that their sizes and their places in the list leave possible. A pair left out is inside
       one component or fails an exact bound; texts that share a passage and little else, and
       copies edited beyond the limit, fail them by the words of their own.
    """
    real = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    component = F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id")
    return _classes(docs, width, percent, k).select(real, F.col("n").cast("long").alias("n_shingles"), component, "kept")


def _identified(docs: DataFrame) -> list[Column]:
    """A row's id without null, and what tells texts with one id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]


def _classes(docs: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """``(id, text_id, n, component_id, kept)`` of every row."""
    own_id, text_id = _identified(docs)
    texts = docs.select(own_id.alias("id"), text_id.alias("text_id"), "text")
    marks = written(sketches(texts, width, k))
    # equal sets are one node, whatever their ids
    classes = written(written(marks.where("n > 0").groupBy("print").agg(F.min("id").alias("id"))).withColumn(
        "rep", F.monotonically_increasing_id()))
    nodes = written(marks.join(classes, ["id", "print"]).select("rep", "n", "sketch").dropDuplicates(["rep"]))

    values = nodes.select("rep", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    lists = rare_lists(values, needed(F.col("n"), k, percent))
    picked = written(lists.groupBy("v").agg(
        F.min(F.struct(F.xxhash64("v", "rep").alias("h"), F.col("rep").alias("p"), F.col("n").alias("pn"))).alias("x"),
        F.count("*").alias("c"),
    ).where("c > 1").select("v", "x.p", "x.pn"))
    offered = lists.where(F.col("turn") <= OFFERS).join(picked, "v").where(F.col("rep") != F.col("p"))
    offered = offered.select(F.col("rep").alias("a"), F.col("p").alias("b"), "n", "pn")
    members = written(lists.join(picked.select("v"), "v", "left_semi").select("rep").distinct().join(classes, "rep"))
    sets = written(full_sets(texts, members, width))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def best(pairs: DataFrame) -> DataFrame:
        """The BEST offers of each node by estimate."""
        ranked = Window.partitionBy("a").orderBy(F.desc("similar"), "b")
        fit = pairs.where(sized("n", "pn", percent)).select("a", "b").distinct()
        taken = sketch_filter(fit, nodes, k, percent).withColumn("r", F.row_number().over(ranked)).where(f"r <= {BEST}")
        return written(ordered(taken))

    tried = best(offered)
    joined = written(components(confirmed(tried, sets, percent)))
    apart = mixed(lists, joined).select(F.col("rep").alias("id")).distinct()
    full = written(shingle_rows(sets.join(written(apart), "id", "left_semi")))
    lists = rare_lists(full, F.ceil(F.col("n") * percent / 100)).withColumn("most", largest_partner(percent))
    again = ordered(offered_again(mixed(lists, joined), percent))
    again = written(again.join(tried, ["a", "b"], "left_anti"))
    tried, joined = tried.unionByName(again), written(extended(joined, written(confirmed(again, sets, percent))))

    several = written(mixed(lists, joined))
    few = several.join(written(main_components(several)), "v").where("component <> main")
    few = few.select(
        "v", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("most").alias("bmost"), F.col("component").alias("bc"),
        F.explode(F.sequence(size_class(F.ceil(F.col("n") * percent / 100)), size_class(F.col("most")))).alias("class"),
    )
    rest = several.withColumn("class", size_class(F.col("n"))).join(written(few), ["v", "class"]).where(
        (F.col("component") != F.col("bc")) & sized("n", "bn", percent)
        & (F.col("n") <= F.col("bmost")) & (F.col("bn") <= F.col("most")))
    rest = ordered(rest.select(F.col("rep").alias("a"), "b"))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"))
    final = written(extended(joined, written(confirmed(rest, sets, percent))))

    grouped = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "print", F.struct("id", "print").alias("own"), F.coalesce("component", "rep").alias("component"))
    first = grouped.groupBy("component").agg(F.min("own").alias("first"))
    named = written(grouped.join(first, "component").select("print", "first"))
    out = marks.select("id", "text_id", "n", "print").join(named, "print", "left")
    alone = F.col("first").isNull()  # no words
    return out.select(
        "id", "text_id", "n", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (alone | ((F.col("id") == F.col("first.id")) & (F.col("print") == F.col("first.print")))).alias("kept"),
    )


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all its columns.

    Rows go by doc_id and text, so of texts that share a doc_id, or have none, each is judged
    alone; rows equal in both go or stay together. An empty table stays empty; columns of any
    other name are kept as they are.
    """
    gone = _classes(docs, width, percent, SKETCH).where("NOT kept").select(
        F.col("id").alias("__id"), F.col("text_id").alias("__text")).distinct()
    own_id, text_id = _identified(docs)
    rows = docs.withColumns({"__id": own_id, "__text": text_id})
    return columns_of(docs, rows.join(gone, ["__id", "__text"], "left_anti"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS common
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 80 * (an + bn - common)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""


@query("op10_minhash_near_dedup", SQL)
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), width=4)
