"""Repeated passages: content-defined chunks of lines, removed where they occur again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.mixing import WORDS
from stforecast.llm.shared import query, table, written

DIVISOR = 3  # one line in so many ends a chunk
LONG_WORDS = 50  # a line of so many words is a passage, and a chunk, of its own
RADIX = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's functions use it."""
    return F.transform(F.array(value), body)[0]


def has_words(line: Column, least: int) -> Column:
    """Whether a line has ``least`` words (WORDS) or more: looked at as far as the last of these, none kept."""
    if least < 1:
        return F.lit(True)
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    found = line.rlike(rf"\A{space}*+(?:{word}++{space}++){{{least - 1}}}{word}")
    return (F.octet_length(line) >= 2 * least - 1) & found


def chunks_of(text: Column, divisor: int, long_words: int) -> Column:
    """The chunks of a text in order: each with its text and whether it is a passage.

    A chunk ends after a line if the rolling hash of that line and the two before it is 0 modulo
    ``divisor``; it depends on nothing else, so that lines put in or taken out move no boundary
    further on. Long lines stand alone. A passage is a long line or two lines that are not blank.
    """

    def line_hash(line: Column) -> Column:
        return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")

    def with_marks(lines: Column, h: Column, long: Column) -> Column:
        def ends_at(i: Column) -> Column:
            rolling = sum((RADIX**k * F.coalesce(F.get(h, i - (k + 1)), F.lit(0)) for k in range(3)), F.lit(0))
            return (i == F.size(lines)) | F.get(long, i - 1) | F.get(long, i) | (rolling % divisor == 0)

        def chunk(ends: Column, end: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(ends, k - 1), F.lit(0))
            part = F.slice(lines, begin + 1, end - begin)
            passage = F.get(long, end - 1) | (F.size(F.filter(part, lambda x: F.trim(x) != "")) >= 2)
            return F.struct(F.array_join(part, "\n").alias("chunk"), passage.alias("passage"))

        return let(F.filter(F.sequence(F.lit(1), F.size(lines)), ends_at),
                   lambda ends: F.transform(ends, lambda end, k: chunk(ends, end, k)))

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda lines: let(
        F.transform(lines, line_hash), lambda h: let(
            F.transform(lines, lambda x: has_words(x, long_words)),
            lambda long: with_marks(lines, h, long))))


def drop_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """Every document without the passages that an earlier one (by doc_id, then place) has.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Passages are compared as
    bytes; single short lines are never removed. Returns doc_id, text (what is left, its chunks
    joined by line ends; null for a null text), n_chunks and n_removed. A null doc_id comes before
    all others; rows that repeat a doc_id and a text are one place and keep what it keeps. An
    empty table gives no rows.

    Chunks whose 128-bit hash occurs once are never shuffled as text twice: hashes are counted
    after a partial aggregate, and copies of a repeated chunk are combined before their shuffle.
    The joins on a hash have one row per hash on one side, so that a hot hash can be split.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")
    rows = rows.withColumns({"chunks": chunks_of(F.col("text"), divisor, long_words), "doc": F.unhex(F.md5(known))})
    places = rows.select("doc_id", "doc", F.posexplode("chunks").alias("place", "c")).where("c.passage").select(
        "doc_id", "doc", "place", F.unhex(F.md5("c.chunk")).alias("hash"), "c.chunk")
    found = written(places.drop("chunk"))
    repeated = written(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    same = places.join(repeated, "hash", "left_semi").groupBy("hash", "chunk").agg(
        F.min(F.struct("doc_id", "doc", "place")).alias("first"))
    first = written(same.groupBy("hash").agg(F.count("*").alias("texts"), F.min("first").alias("first")))
    again = found.join(first.where("texts = 1"), "hash").where(
        ~F.struct("doc_id", "doc", "place").eqNullSafe(F.col("first")))
    collided = first.where("texts > 1").select("hash")
    if not collided.isEmpty():  # one hash, several texts: told apart by their bytes
        apart = places.join(collided, "hash", "left_semi")
        own = apart.groupBy("hash", "chunk").agg(F.min(F.struct("doc_id", "doc", "place")).alias("first"))
        apart = apart.join(own, ["hash", "chunk"]).where(
            ~F.struct("doc_id", "doc", "place").eqNullSafe(F.col("first")))
        again = again.select("doc", "place").unionByName(apart.select("doc", "place"))
    gone = again.groupBy("doc").agg(F.collect_set("place").alias("gone"))  # places of one document
    left = F.expr("transform(filter(chunks, (c, k) -> NOT coalesce(array_contains(gone, k), false)), c -> c.chunk)")
    return rows.join(gone, "doc", "left").select(
        "doc_id", F.when(F.col("text").isNotNull(), F.array_join(left, "\n")).alias("text"),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {LONG_WORDS} AS long FROM lines
), marked AS (
  SELECT *, long OR lead(long, 1, true) OVER w
         OR (h + {RADIX} * lag(h, 1, 0) OVER w + {RADIX**2} * lag(h, 2, 0) OVER w) % {DIVISOR} = 0 AS last
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM marked
), chunks AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk,
         bool_or(long) OR count(*) FILTER (trim(line) <> '') >= 2 AS passage
  FROM numbered GROUP BY doc_id, place
), kept AS (
  SELECT *, passage AND row_number() OVER (PARTITION BY chunk, passage ORDER BY doc_id, place) > 1 AS again FROM chunks
)
SELECT doc_id, CASE WHEN any_value(d.text) IS NOT NULL
         THEN coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT again), '') END AS text,
       count(*) AS n_chunks, count(*) FILTER (again) AS n_removed
FROM kept JOIN documents d USING (doc_id) GROUP BY doc_id
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(table(spark, sf_dir, "documents"))


def drop_repeated_passages(docs: DataFrame, min_words: int = LONG_WORDS) -> DataFrame:
    """Every document without the lines of the passages that an earlier place has, wherever they begin.

    A passage is a run of lines of ``min_words`` words or more. All lines of a run go if the same
    lines stand in an earlier place (by doc_id, then line) that the run does not overlap; the
    earliest place keeps them. Lines without a word are not compared; they go with the lines
    around them. Columns, nulls and repeated rows are as in ``drop_repeated_chunks``, with n_lines
    and n_removed in lines.

    From each line the shortest passage that begins there and the one that ends there are compared
    by SHA-256 of their lines' SHA-256; these cover every longer run. Lines meet their document
    as hashes, not as text. Passages are counted with a partial aggregate, and the joins on a hash
    have one row per hash on one side.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")
    rows = rows.withColumns({
        "lines": F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), "doc": F.unhex(F.md5(known)),
    })
    lines = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "doc", "row", F.posexplode("lines").alias("i", "line"))
    lines = lines.withColumn("words", F.regexp_count("line", F.lit(WORDS)).cast("long")).where("words > 0").select(
        "doc_id", "doc", "row", "i", "words", F.unhex(F.sha2("line", 256)).alias("line"))
    own = Window.partitionBy("doc_id", "doc", "row")
    lines = lines.withColumn("end", F.sum("words").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("begin", F.col("end") - F.col("words"))

    def passage(over: Window) -> Column:
        """The lines of a frame, from ``i`` to ``j``."""
        return F.struct(F.min("i").over(over).alias("i"), F.max("i").over(over).alias("j"),
                        F.collect_list("line").over(over).alias("line"),
                        F.sum("words").over(over).alias("words"))

    # in words, from a line's begin or end: as far as the first line that makes the passage full
    ahead = passage(own.orderBy("begin").rangeBetween(0, min_words - 1))
    back = passage(own.orderBy("end").rangeBetween(1 - min_words, 0))
    both = lines.select("doc_id", "doc", ahead.alias("ahead"), back.alias("back"))
    both = both.select("doc_id", "doc", F.explode(F.array("ahead", "back")).alias("p")).where(F.col("p.words") >= min_words)
    found = written(both.select("doc_id", "doc", "p.i", "p.j", F.unhex(F.sha2(F.array_join(
        F.transform("p.line", F.hex), ""), 256)).alias("hash")))
    repeated = written(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    place = F.struct("doc_id", "doc", "i", "j")
    same = written(found.join(repeated, "hash", "left_semi"))
    first = same.groupBy("hash").agg(F.min(place).alias("first"))
    again = same.join(first, "hash").where(
        (F.col("doc") != F.col("first.doc")) | (F.col("i") > F.col("first.j"))).select("doc", "i", "j").distinct()
    sorted_ = Window.partitionBy("doc").orderBy("i", "j")
    top = F.max("j").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("fresh", F.coalesce(F.col("i") > top + 1, F.lit(True)).cast("int"))
    again = again.withColumn("run", F.sum("fresh").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    runs = again.groupBy("doc", "run").agg(F.min("i").alias("i"), F.max("j").alias("j"))
    runs = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("runs"))
    kept = F.expr("""flatten(transform(sequence(0, size(runs)), k -> slice(lines,
        coalesce(get(runs, k - 1).j, -1) + 2,
        coalesce(get(runs, k).i, size(lines)) - coalesce(get(runs, k - 1).j, -1) - 1)))""")
    left = F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept)
    return rows.join(runs, "doc", "left").withColumn("left", left).select(
        "doc_id", F.when(F.col("text").isNotNull(), F.array_join("left", "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
    )


PASSAGE_SQL = f"""
WITH lines AS (
  SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM (
    SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), sums AS (
  SELECT *, (sum(words) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS upto FROM lines WHERE words > 0
), pairs AS (
  SELECT a.doc_id, a.i, b.i AS j FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND a.i <= b.i
  WHERE b.upto - a.upto + a.words >= {LONG_WORDS}
    AND (b.upto - b.words - a.upto + a.words < {LONG_WORDS} OR b.upto - a.upto < {LONG_WORDS})
), passages AS (
  SELECT p.doc_id, p.i, p.j, string_agg(s.line, chr(10) ORDER BY s.i) AS passage
  FROM pairs p JOIN sums s ON s.doc_id = p.doc_id AND s.i BETWEEN p.i AND p.j GROUP BY ALL
), again AS (
  SELECT * FROM (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(j) OVER w AS first_j FROM passages
                 WINDOW w AS (PARTITION BY passage ORDER BY doc_id, i, j))
  WHERE doc_id <> first_doc OR i > first_j
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN again a ON l.doc_id = a.doc_id AND l.i BETWEEN a.i AND a.j
)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL
         THEN coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') END AS text,
       count(*) AS n_lines, count(g.i) AS n_removed
FROM documents d JOIN lines l USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY d.doc_id
"""


@query("op1_passage_dedup", PASSAGE_SQL)
def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"))
