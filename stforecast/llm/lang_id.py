"""Language identification by compression against one dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.shared import columns_of, query, table
from stforecast.session import broadcast_within

UNDECIDED = "und"
DICTIONARY_BYTES = 112 << 10  # of training text per language
TOTAL_BYTES = 256 << 20  # of all dictionaries, which every worker holds; more is an error
RANGE_BYTES = 256  # of a row that names a language and its part of the hash range
SAMPLE_ROWS = 600  # training documents fetched per language, on average
LEVEL, BLOCK = 6, 2048
MARGIN, SURE_BYTES = 0.01, 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of letters with one space between them; nothing if there is no letter."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return plain.encode("utf-8", "replace") if any(map(str.isalpha, plain)) else b""


def held_out(doc_id: Column) -> Column:
    """Documents that take no part in training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, size: int = DICTIONARY_BYTES, languages: int | None = None) -> list[tuple[str, bytes]]:
    """Raw dictionaries of all languages, the most frequent first.

    Every language is learned, unless ``languages`` asks for the most frequent ones only; more
    than TOTAL_BYTES of dictionaries are an error, with a smaller ``size`` as the way on. An empty
    table gives no dictionary. ``docs`` needs doc_id, text and lang; rows with a null lang, text or id are not used. The
    training sample is bounded: about SAMPLE_ROWS documents per language, drawn by a hash of the
    id, whole texts in hash order until ``size`` bytes are full (documents over a sixteenth of
    that only if the others do not fill it). What reaches the driver is that sample.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"),
        (F.octet_length("text") > size // 16).alias("long"),
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("long")).alias("short"))
    ranked = counts.orderBy(F.desc("n"), "lang")
    found = ranked.limit(TOTAL_BYTES // size + 1 if languages is None else languages).collect()
    if len(found) * size > TOTAL_BYTES:
        raise ValueError(f"more than {TOTAL_BYTES // size} languages of {size} bytes each; give a smaller size")
    drawn = []
    for row in found:  # the part of the hash range that holds so many rows of the language
        pool, short = (row.short, True) if row.short >= SAMPLE_ROWS else (row.n, False)
        drawn.append((row.lang, min(2**63 - 1, (2**64 - 1) * SAMPLE_ROWS // pool - 2**63), short))
    ranges = docs.sparkSession.createDataFrame(drawn, "lang string, below long, only_short boolean")
    mine = known.join(broadcast_within(ranges, len(drawn), RANGE_BYTES), "lang").where(
        (F.col("h") <= F.col("below")) & ~(F.col("only_short") & F.col("long")))
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    took = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = mine.withColumns({"took": F.coalesce(took, F.lit(0)), "rank": F.row_number().over(order)})
    texts: dict[str, list[bytes]] = {row.lang: [] for row in found}
    # letters alone may be half of the bytes; a text longer than the dictionary is cut to it
    sample = rows.where(f"took < {2 * size}").orderBy("lang", "rank")
    for row in sample.select("lang", F.substring("text", 1, size).alias("text")).collect():
        texts[row.lang].append(letters(row.text))
    return [(lang, b" ".join(t)[:size]) for lang, t in texts.items() if any(t)]


class Classifier:
    """Chooses the dictionary under which a text becomes smallest."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL, block: int = BLOCK):
        import zstandard

        self.block, self.names, self.encoders = block, [], []
        for lang, data in dictionaries:
            words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            self.names.append(lang)
            self.encoders.append(zstandard.ZstdCompressor(
                level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
            ))

    def sizes(self, plain: bytes) -> list[int]:
        """Compressed bytes per language, all blocks of the text together."""
        blocks = [plain[i : i + self.block] for i in range(0, len(plain), self.block)]
        return [sum(len(encoder.compress(b)) for b in blocks) for encoder in self.encoders]

    def decide(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the document is rejected."""
        plain = letters(text or "")
        if not plain or not self.names:
            return UNDECIDED, 0.0, 0.0, True
        sizes = self.sizes(plain)
        best = min(sizes)
        score = 1 / sum(2.0 ** max(best - s, -60) for s in sizes)
        others = sorted(sizes)[1:]
        margin = 1 - best / others[0] if others else 1.0
        return self.names[sizes.index(best)], score, margin, margin < MARGIN and len(plain) >= SURE_BYTES


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """The language of every whole text, one row per row of ``docs`` (doc_id, text).

    A text is taken as lower-case letters and compressed in blocks with the raw-content
    dictionary of each language; the smallest total wins, a tie goes to the language with more
    training documents. Returns doc_id, held_out, lang_pred (``und`` without a letter or with
    nothing learned), score (share of the winner if each byte saved doubles the odds), margin
    (by how much the next best is larger) and rejected: undecided, or a margin below MARGIN on
    at least SURE_BYTES of letters; shorter texts give too few bytes for a narrow margin to
    mean anything. Nulls and empty texts are undecided. lang and source are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = zip(*(classifier.decide(text.as_py()) for text in batch.column(2)), strict=True)
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            arrays = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)] or [pa.array([], k) for k in kinds]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, in one pass."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            stays = [not classifier.decide(text.as_py())[3] for text in batch.column("text")]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return columns_of(docs, docs.mapInArrow(run, schema))


def train(docs: DataFrame) -> list[tuple[str, bytes]]:
    return learn(docs.where(~held_out(F.col("doc_id"))))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
