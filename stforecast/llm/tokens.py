"""Token ids of whole texts with a tokenizer file, for use inside Arrow tasks."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stforecast.llm.shared import give_back

PIECE_BYTES = 2 << 20  # text encoded in one step
WORDS_KEPT = 800_000  # words of earlier pieces kept in the table of one Python worker, about 150 MB
WORDS_LEARNT = 1 << 16  # words the tokenizer is given at a time
TAILS = (".", ",")  # cut off words of letters and put back as tokens of their own
ASCII_LOWER = {code: code + 32 for code in range(65, 91)}

_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """The encoder of this Python worker; later tasks of the worker use it again."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def vocabulary_path(vocabulary: str) -> str:
    """The file itself, or the name of one of the public tokenizers."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class WordEncoder:
    """Encodes each different word once and puts texts together from the ids of their words.

    Right for tokenizers that lower-case, drop white space and never look across it, as BPE with
    word ends does. A word is whatever stands between ASCII white space; the tokenizer sees it
    whole. Words of letters only share an entry whatever the case of A-Z and with or without a
    full stop or comma behind them; they are encoded many at a time and parted at the word-end
    tokens. A word that the tokenizer parts although it is all letters keeps an entry of its own.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.tails = {tail: ids[0] for tail, ids in zip(TAILS, self.whole(list(TAILS)), strict=True) if len(ids) == 1}
        self.parted: set[str] = set()  # words of letters that are more than one piece
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.start = array("I"), array("q", [0])
        self.parted.clear()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), WORDS_LEARNT):
            self.learn_some(words[i : i + WORDS_LEARNT])

    def learn_some(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, ids in zip(groups, self.whole([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):
                other += group
                continue
            self.slot.update(zip(group, range(len(self.start) - 1, len(self.start) - 1 + len(group)), strict=True))
            self.start.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
        for w, ids in zip(other, self.whole(other), strict=True):
            self.slot[w] = len(self.start) - 1
            self.ids.extend(ids)
            self.start.append(len(self.ids))
            if w.isalpha() and self.ends[ids].sum() != 1:
                self.parted.add(w)

    def entry(self, word: str) -> tuple[str, int]:
        """The word's entry in the table and the token behind it (0: none)."""
        tail = 0
        if not word.isalpha():
            tail = self.tails.get(word[-1:], 0)
            if not tail or not word[:-1].isalpha():
                return word, 0
            word = word[:-1]
        if not word.islower():
            word = word.lower() if word.isascii() else word.translate(ASCII_LOWER)
        return word, tail

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts in them (one more than texts)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        n = len(words)
        tails = np.zeros(n, np.uint32)
        # a word that is an entry itself, as most are, needs no look at its letters
        slots = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, n)
        others = np.flatnonzero(slots < 0).tolist()
        entries = [self.entry(words[k]) for k in others]
        fresh = [w for w in {w for w, _ in entries} if w not in self.slot]
        if fresh and len(self.slot) + len(fresh) > WORDS_KEPT:
            self.forget()
            others, entries = range(n), list(map(self.entry, words))
            fresh = list({w for w, _ in entries})  # all words of the piece, however many
        self.learn(fresh)
        if self.parted:  # their full stops may belong to a piece
            own = [i for i, (w, tail) in enumerate(entries) if tail and w in self.parted]
            self.learn([words[others[i]] for i in own if words[others[i]] not in self.slot])
            for i in own:
                entries[i] = words[others[i]], 0
        if entries:
            slots[others] = [self.slot[w] for w, _ in entries]
            tails[others] = [tail for _, tail in entries]
        pool, start = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.start, np.int64)
        first, length = start[slots], start[slots + 1] - start[slots] + (tails > 0)
        index = coded.indices.to_numpy()
        length = length[index]
        to = np.zeros(len(index) + 1, np.int64)
        np.cumsum(length, out=to[1:])
        ids = np.zeros(to[-1], self.dtype)
        if len(pool):
            place = np.repeat(first[index] - to[:-1], length)
            place += np.arange(to[-1])
            ids[:] = pool.take(place, mode="clip")  # the place of a tail is another word's, and written over
        tails = tails[index]
        ids[to[1:][tails > 0] - 1] = tails[tails > 0]
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return ids, to[bounds - bounds[0]]


def encoded(batch: pa.RecordBatch, vocabulary: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_id, ids, starts) of parts of a batch of doc_id and text, each text closed by ``end_id``."""
    work = encoder(vocabulary)
    texts = batch.column(1)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, "right")))
        ids, starts = work.encode(texts.slice(at, to - at))
        n = to - at
        out = np.empty(len(ids) + n, ids.dtype)
        ends = starts[1:] + np.arange(n)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[ends], out[keep] = end_id, ids
        yield batch.column(0).slice(at, n), out, starts + np.arange(n + 1)
        at = to
    give_back()
