import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stforecast.llm import packing, token_files, tokens
from stforecast.llm.packing import closest_fill, cut_ends, minimum_bin_slack, pack, plan_window
from stforecast.llm.shared import shared_folder

NAME = "word_bpe_49k.json"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path(NAME))


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


alphabet = st.sampled_from(list("aAbé'sİſΣ \t\n  <|>endoftx12.,!¼Ⅷ́中")) | st.characters(exclude_categories=["Cs"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet, max_size=40) | st.sampled_from(["<|endoftext|>", "x<|endoftext|> y", None]), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, starts = tokens.encoder(NAME).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [plain(t) for t in texts]


def test_a_full_word_table_is_cleared(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 50)
    work = tokens.WordEncoder(NAME)
    for k in range(5):
        text = " ".join(f"word{k}{i} other" for i in range(30))
        assert work.encode(pa.array([text]))[0].tolist() == plain(text)


def test_a_piece_may_have_more_words_than_the_table_keeps(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 50)
    monkeypatch.setattr(tokens, "WORDS_LEARNT", 64, raising=False)
    work = tokens.WordEncoder(NAME)
    for text in ("word0 other", " ".join(f"word{i} x{i}, {i}" for i in range(200)), "word3 other", "more words of it " * 9):
        ids, starts = work.encode(pa.array([text, None, "word1"]))
        parts = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert parts == [plain(text), [], plain("word1")]


def test_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 10)
    texts = ["a bc", None, "", "some more words than ten bytes", "é", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    got = {}
    for names, ids, starts in tokens.encoded(batch.slice(1), NAME, 1):
        for name, a, b in zip(names.to_pylist(), starts[:-1], starts[1:], strict=True):
            got[name] = ids[a:b].tolist()
    assert got == {i: [*plain(t), 1] for i, t in enumerate(texts) if i}


def test_files_give_the_ids_back(spark, clashing):
    folder = shared_folder(spark)
    manifest = token_files.write_token_files(clashing, folder, length=64)
    rows = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    texts = sorted(((r.doc_id, r.text) for r in clashing.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in texts]
    at = 0
    for row, (_, text) in zip(rows, texts, strict=True):
        want = [*plain(text), 1]
        assert (row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    file = manifest.first()
    fs, _ = token_files.file_system(folder)
    reader = token_files.TokenFile(fs, file.tokens_file)
    whole = reader.reader.read_all()
    assert whole.column("ids").type.list_size == 64
    assert sum(map(sum, whole.column("mask").to_pylist())) == file.tokens
    sums = token_files.read_token_files(manifest, folder, with_ids=False).orderBy("start").collect()
    assert [r.ids_crc32 for r in sums] == [zlib.crc32(bytes(r.ids)) for r in rows]


def test_no_documents_give_no_files(spark, odd):
    folder = shared_folder(spark)
    manifest = token_files.write_token_files(odd.where("false"), folder)
    assert manifest.count() == 0 and token_files.read_token_files(manifest, folder).count() == 0


def check_pieces(pieces, docs, capacity):
    """Each id in one piece, sequences without gaps and within the capacity; tokens that pad."""
    ids = {}
    for d, text in docs:
        ids.setdefault(d, [*plain(text), 1])
    cover, sequences = {}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id])
        cover.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    repeats = {d: sum(x == d for x, _ in docs) for d in ids}
    for d, spans in cover.items():
        for k in range(len(ids[d])):
            assert sum(a <= k < a + n for a, n in spans) == repeats[d]
    lengths = []
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
        lengths.append(end)
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def test_packing_of_odd_rows(clashing):
    docs = clashing.where("doc_id IS NULL OR doc_id NOT IN (5, 6)")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_pieces(pack(docs, capacity=16).collect(), rows, 16) == 0
    long = clashing.where("doc_id IN (5, 6)")
    spans = [(p.doc_id, p.start, p.length, p.doc_tokens) for p in pack(long).collect()]
    for doc in (5, 6):
        mine = [x for x in spans if x[0] == doc]
        assert sum(x[2] for x in mine) == mine[0][3] and len({x[1] for x in mine}) == len(mine)


def test_packing_of_an_empty_table(odd):
    assert pack(odd.where("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(0, 60))
def test_fill_is_the_closest(lengths, target):
    counts = {k: lengths.count(k) for k in lengths}
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= target}
    used = closest_fill(sorted(counts, reverse=True), counts, target)
    assert sum(k * n for k, n in used.items()) == max(sums)
    assert all(n <= counts[k] for k, n in used.items())


@given(st.lists(st.integers(1, 400), max_size=60))
@settings(max_examples=60, deadline=None)
def test_window_plans_are_whole_and_unpadded(sizes):
    capacity = 64
    pieces = [p for s in plan_window(sizes, capacity) for p in s]
    for doc, n in enumerate(sizes):
        spans = sorted((a, k) for d, a, k in pieces if d == doc)
        assert sum(k for _, k in spans) == n
        assert all(a + k == b for (a, k), (b, _) in zip(spans, spans[1:], strict=False))
    for sequence in plan_window(sizes, capacity):
        total = sum(k for _, _, k in sequence)
        assert total == capacity or total & (total - 1) == 0


def test_bins_use_every_item_once():
    counts = {7: 5, 5: 4, 3: 6, 1: 2}
    bins = list(minimum_bin_slack(counts, 10))
    used = {k: sum(fill.get(k, 0) * times for fill, times in bins) for k in counts}
    assert used == counts and sum(t for f, t in bins if sum(k * n for k, n in f.items()) == 10) >= 6


def test_ends_are_cut_at_powers_of_two():
    cut = list(cut_ends([(0, 0, 13), (1, 4, 10)], 16))
    assert [sum(p[2] for p in s) for s in cut] == [16, 4, 2, 1]


def test_module_default():
    assert packing.VOCABULARY == token_files.VOCABULARY == NAME


@pytest.mark.parametrize("name", [NAME])
def test_a_path_is_taken_as_it_is(name):
    path = public_tokenizers.path(name)
    assert tokens.vocabulary_path(path) == path == tokens.vocabulary_path(name)


def test_known_plain_words_are_looked_up_only(monkeypatch):
    work = tokens.WordEncoder("word_bpe_49k.json")
    looked = []
    monkeypatch.setattr(tokens.WordEncoder, "entry", lambda self, word, old=tokens.WordEncoder.entry: looked.append(word) or old(self, word))
    first = work.encode(pa.array(["some plain words", "Plain words, some."]))
    looked.clear()
    again = work.encode(pa.array(["some plain words", "Plain words, some."]))
    assert sorted(looked) == ["Plain", "some.", "words,"]
    assert all((x == y).all() for x, y in zip(first, again, strict=True))
    texts = ["some plain words", "Plain words, some."]
    ids, starts = again
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == work.whole(texts)
