import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from stforecast.llm import QUERIES
from stforecast.llm.lang_id import BLOCK, LEVEL, TOTAL_BYTES, Classifier, identify, keep_identified, learn, letters, train
from stforecast.llm.shared import table

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the other dogs of the town "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann weg von den anderen hunden der stadt "


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    got = QUERIES["op4_language_id"](spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    long = [r for r in got if r.n_chars >= 50]
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert sum(r.lang == r.lang_pred for r in long) / len(long) > 0.99
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in long) / len(long) < 0.01


def test_odd_rows_and_clashing_columns(clashing):
    books = [("en", letters(EN * 20)), ("de", letters(DE * 20))]
    rows = identify(clashing, books).collect()
    assert len(rows) == clashing.count()
    by_id = {r.doc_id: r for r in rows}
    for doc in (3, 4, 9, 11):
        assert (by_id[doc].lang_pred, by_id[doc].score, by_id[doc].rejected) == ("und", 0.0, True)
    assert by_id[None].lang_pred in ("en", "de") and by_id[None].held_out is False
    kept = keep_identified(clashing, books)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.rejected)


def test_whole_texts_decide_not_prefixes():
    work = Classifier([("en", letters(EN * 20)), ("de", letters(DE * 20))])
    assert work.decide(EN * 3 + DE * 40)[0] == "de" and work.decide(DE * 3 + EN * 40)[0] == "en"


def test_narrow_margins_are_rejected():
    same = letters(EN * 20)
    lang, score, margin, rejected = Classifier([("en", same), ("xx", same)]).decide(EN * 10)
    assert (lang, score, margin, rejected) == ("en", 0.5, 0.0, True)
    assert not Classifier([("en", same), ("xx", same)]).decide("the dog")[3]  # too short to tell
    assert Classifier([]).decide(EN) == ("und", 0.0, 0.0, True)
    assert Classifier([("en", same)]).decide(EN)[:2] == ("en", 1.0)


def test_training_reads_other_documents_only(docs_of):
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "held out secret words" if i in out else EN, "zz" if i in out else "en", "s", None) for i in range(60)]
    books = train(docs_of([*rows, (None, DE, "de", "s", None), (99, DE, None, "s", None), (98, None, "fr", "s", None)]))
    assert [lang for lang, _ in books] == ["en"] and b"secret" not in books[0][1]


def test_dictionaries_are_bounded(docs_of):
    rows = [(i, f"{EN} number{i} " * (1 + i % 3), "en", "s", None) for i in range(300)] + [(900, EN * 5000, "de", "s", None)]
    books = dict(learn(docs_of(rows), size=4000))
    assert set(books) == {"en", "de"} and all(0 < len(b) <= 4000 for b in books.values())
    assert list(dict(learn(docs_of(rows), size=4000, languages=1))) == ["en"]


def test_every_language_is_learned(docs_of):
    """The language with the fewest documents of 260 is known too; too many bytes are an error."""
    letters_of = [chr(0x4E00 + 7 * i) for i in range(260)]
    rows = [(1000 * i + k, f"{c * 3} {c} {c * 2} {c * 5} " * 20, f"l{i:03}", "s", None)
            for i, c in enumerate(letters_of) for k in range(1 + (i < 259))]
    books = learn(docs_of(rows), size=2000)
    assert len(books) == 260 and books[-1][0] == "l259"
    assert Classifier(books).decide(letters_of[259] * 40)[0] == "l259"
    with pytest.raises(ValueError, match="give a smaller size"):
        learn(docs_of(rows), size=TOTAL_BYTES // 200)


def test_equals_plain_compression(spark):
    """Every document of the small table against block-wise compression without the classifier."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    books = train(docs)
    words = {lang: zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, b in books}

    def size(lang, plain):
        total = 0
        for at in range(0, len(plain), BLOCK):
            one = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words[lang], write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(one.compress(plain[at:at + BLOCK]))
        return total

    texts = {r.doc_id: letters(r.text or "") for r in docs.collect()}
    got = {r.doc_id: r for r in identify(docs, books).collect()}
    assert len(got) == len(texts)
    short = {d: t for d, t in texts.items() if len(t) < 20_000}  # the loops build a compressor a block
    assert len(short) > 150
    for doc, plain in short.items():
        sizes = [(size(lang, plain), k, lang) for k, (lang, _) in enumerate(books)] if plain else []
        assert got[doc].lang_pred == (min(sizes)[2] if sizes else "und")


def test_empty_table(odd):
    none = odd.where("false")
    assert train(none) == [] and identify(none, []).count() == 0


@pytest.mark.parametrize(("text", "plain"), [("", b""), ("12 !!", b""), ("A-b_c 1", b"a b c"), ("É²", "é".encode())])
def test_letters(text, plain):
    assert letters(text).strip() in (plain, plain + "²".encode())


def test_held_out_column(odd):
    from stforecast.llm.lang_id import held_out

    got = odd.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
