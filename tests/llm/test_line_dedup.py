import random

import pytest

from stforecast.llm.line_dedup import drop_repeated_chunks, drop_repeated_passages

PASSAGE = "\n".join(f"shared line {i} of the passage" for i in range(30))


def test_a_passage_goes_where_it_occurs_again(docs_of):
    docs = docs_of([
        (1, f"one\nbegins here\n{PASSAGE}\nends here"), (2, f"two\n{PASSAGE}\nand more"), (3, "clean\ntext\nof three lines"),
    ])
    got = {r.doc_id: r for r in drop_repeated_chunks(docs).collect()}
    assert got[1].n_removed == 0 and got[1].text == f"one\nbegins here\n{PASSAGE}\nends here"
    assert got[3].n_removed == 0
    left = got[2].text.split("\n")
    # boundaries find each other again a few lines into the passage
    assert got[2].n_removed > 0 and left[0] == "two" and left[-1] == "and more" and len(left) < 20


def test_long_lines_are_passages_and_short_single_lines_are_not(docs_of):
    long = " ".join(f"word{i}" for i in range(60))
    docs = docs_of([(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, "short"), (4, "short")])
    got = {r.doc_id: r.text for r in drop_repeated_chunks(docs).collect()}
    assert got == {1: f"a\n{long}\nb", 2: "c\nd", 3: "short", 4: "short"}


def test_odd_rows(clashing):
    rows = drop_repeated_chunks(clashing).collect()
    assert len(rows) == clashing.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].text is None and by_id[4].text == "" and by_id[7].n_removed == 0 and by_id[8].n_removed > 0
    assert by_id[None].text == "A text of nobody"


def test_empty_table(odd):
    assert drop_repeated_chunks(odd.where("false")).count() == 0


@pytest.mark.parametrize("name", ["text", "n_chunks", "n_removed", "doc_id"])
def test_columns(odd, name):
    assert name in drop_repeated_chunks(odd).columns


@pytest.mark.parametrize(("n", "words"), [(3, 20), (6, 10), (12, 10)])
def test_a_passage_goes_whole_from_any_context(docs_of, n, words):
    draw = random.Random(n)

    def some(k, size):
        return [" ".join(f"w{draw.randrange(10**6)}" for _ in range(size)) for _ in range(k)]

    rows, want = [], {}
    for case in range(20):
        passage = some(n, words)
        for k in (0, 1):
            before, after = some(draw.randrange(4), 7), some(1 + draw.randrange(3), 7)
            rows.append((2 * case + k, "\n".join([*before, *passage, *after])))
            want[2 * case + k] = ("\n".join([*before, *([] if k else passage), *after]), k * n)
    got = drop_repeated_passages(docs_of(rows)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want


def removed_by_hand(texts, least):
    """All pairs of runs, line by line."""
    docs = [t.split("\n") for t in texts]
    at = [[i for i, x in enumerate(d) if x.split()] for d in docs]
    seen, gone = {}, set()
    for d, places in enumerate(at):
        for a in range(len(places)):
            for b in range(a, len(places)):
                run = tuple(docs[d][i] for i in places[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    first = seen.setdefault(run, (d, places[a], places[b]))
                    if first[0] != d or places[a] > first[2]:
                        gone |= {(d, i) for i in range(places[a], places[b] + 1)}
    return ["\n".join(x for i, x in enumerate(d) if (k, i) not in gone) for k, d in enumerate(docs)]


def test_passages_equal_a_search_by_hand(docs_of):
    draw = random.Random(1)
    for _ in range(3):
        texts = ["\n".join(draw.choice(["a", "b c", "d e f g", "", "h i j"]) for _ in range(draw.randrange(1, 14)))
                 for _ in range(25)]
        got = drop_repeated_passages(docs_of(list(enumerate(texts))), min_words=6).collect()
        assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == removed_by_hand(texts, 6)


def test_passages_of_odd_rows(clashing):
    rows = drop_repeated_passages(clashing).collect()
    assert len(rows) == clashing.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].text is None and by_id[4].text == "" and by_id[7].n_removed == 0
    assert (by_id[8].text, by_id[8].n_removed) == ("last", 12) and by_id[None].text == "A text of nobody"
    assert drop_repeated_passages(clashing.where("false")).count() == 0


def test_long_lines_are_told_without_their_words(spark):
    from pyspark.sql import functions as F

    from stforecast.llm.line_dedup import has_words
    from stforecast.llm.mixing import WORDS

    draw = random.Random(3)
    space = [" ", "\t", "  ", "\x0b", "\r", " \x0c "]
    lines = ["", " ", "a", "a b", " a  b ", "a b c", "é 中文 \U0001f600"]
    for n in (48, 49, 50, 51, 60):
        for _ in range(6):
            lines.append(draw.choice(["", " "]) + "".join(draw.choice("abé中") + draw.choice(space) for _ in range(n)))
            lines.append(" ".join(["x"] * n))
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    for least in (0, 1, 2, 3, 50):
        both = rows.select(has_words(F.col("line"), least).alias("got"), (F.regexp_count("line", F.lit(WORDS)) >= least).alias("want"))
        assert all(r.got == r.want for r in both.collect()), least
