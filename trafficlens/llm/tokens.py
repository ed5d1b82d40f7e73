"""Token ids of whole texts, with every distinct word encoded once per worker.

The word vocabulary's tokenizer drops white space and never joins across it, so the ids of a text are those of its
words in turn. Words made of Latin letters are encoded many at a time and cut apart at the tokens that end a word.

Texts of plain letters and ASCII are lower-cased, cut and numbered as Arrow columns, a block of texts at a time, so Python only handles each
different word of a block; the ids are put together by arrays of positions. Other texts are cut word by word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Python cuts at these four controls, the tokenizer does not: such texts are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")
ANY_SPACE = re.compile(r"\s")
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Letters of which no two case forms are longer or shorter, ASCII without controls, and no sign that could open a special token.
SIMPLE = re.compile("[\t-\r -;=-~À-ÖØ-öø-ÿ]*")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A mark at the end of a word is a token of its own.
LAST_MARK = r"([a-zà-öø-ÿ])([.,])(\s|$)"
#: Bytes of words and ids that a worker remembers as columns, and as single words; beyond that it starts anew.
KNOWN_BYTES = 48 << 20
NEAR_BYTES = 16 << 20
#: What a single word takes beside its letters and ids.
WORD_BYTES = 160
#: Characters whose words are held at once; longer texts are cut between words.
BLOCK_CHARS = 2_000_000

_encoders: dict[str, WordEncoder] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the vocabulary at ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: Whether the model alone, without normalizer and pre-tokenizer, gives the ids of words of small ASCII letters.
        self.direct = all(self.whole(w) == ids for w, ids in self._by_model([LETTERS, *LETTERS, "a" + LETTERS]).items())
        self._forget()
        #: Words met elsewhere.
        self.near: dict[str, bytes] = {}
        self.near_bytes = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _by_model(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small ASCII letters, which normalizer and pre-tokenizer leave as they are."""
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in words]
        raw = np.array([i for ids in found for i in ids], dtype="<u4").tobytes()
        ends = np.cumsum([4 * len(ids) for ids in found], dtype=np.int64).tolist()
        return {w: raw[end - 4 * len(ids) : end] for w, ids, end in zip(words, found, ends)}

    def _learn_plain(self, words: list[str]) -> dict[str, bytes]:
        """``words`` are lower case and match PLAIN: each gives exactly one token that ends a word."""
        if self.direct:
            known = self._by_model([w for w in words if w.isascii()])
            return known | self._learn_joined([w for w in words if not w.isascii()])
        return self._learn_joined(words)

    def _learn_joined(self, words: list[str]) -> dict[str, bytes]:
        groups = [words[i : i + 100] for i in range(0, len(words), 100)]
        encoded = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        known = {}
        for group, found in zip(groups, encoded):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                known.update((w, self.whole(w)) for w in group)
                continue
            raw, at = ids.tobytes(), 0
            for word, cut in zip(group, cuts.tolist()):
                known[word] = raw[4 * at : 4 * cut]
                at = cut
        return known

    def learn(self, missing: Iterable[str]) -> dict[str, bytes]:
        """Ids of different words."""
        later, odd, base = [], [], set()
        for word in missing:
            if word.isascii() and word.islower() and word.isalpha():
                base.add(word)
                continue
            stem = word[:-1] if word[-1:] in (".", ",") else word
            if stem and PLAIN.fullmatch(stem):
                lower = stem.lower()
                base.add(lower)
                later.append((word, lower, word[len(stem) :]))
            else:
                odd.append(word)
        odd += {mark for _, _, mark in later if mark}
        found = self.tokenizer.encode_batch(odd, add_special_tokens=False) if odd else []
        known = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(odd, found)}
        known |= self._learn_plain(list(base))
        for word, stem, mark in later:
            known[word] = known[stem] + known[mark] if mark else known[stem]
        return known

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        begun = b""
        for held, lasts in _blocks(texts):
            for ids, last in zip(self._encode_block(held), lasts, strict=True):
                begun = begun + ids if begun else ids
                if last:
                    yield begun
                    begun = b""

    def prepare(self, words: Iterable[str]) -> None:
        """Learn the words at once that ``short`` is going to meet."""
        words = set(words)
        missing = {w for w in words if w not in self.near}
        if missing:
            if self.near_bytes > NEAR_BYTES:
                missing, self.near, self.near_bytes = words, {}, 0
            learnt = self.learn(missing)
            self.near |= learnt
            self.near_bytes += sum(WORD_BYTES + len(w) + len(ids) for w, ids in learnt.items())

    def short(self, text: str) -> bytes:
        """Ids of a text, word by word."""
        if ODD_SPACE.search(text):
            return self.whole(text)
        words = text.split()
        self.prepare(words)
        return b"".join([self.near[w] for w in words])

    def _encode_block(self, held: list[str]) -> Iterator[bytes]:
        simple = [bool(SIMPLE.fullmatch(text)) for text in held]
        columns = self._encode_simple([t for t, s in zip(held, simple, strict=True) if s])
        for text, plain in zip(held, simple, strict=True):
            yield next(columns) if plain else self.short(text)

    def _encode_simple(self, texts: list[str]) -> Iterator[bytes]:
        lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, LAST_MARK, r"\1 \2\3"))
        coded = words.flatten().dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        # Each word's place in the block takes the ids of its number.
        length = self.lengths[place]
        ends = np.cumsum(length, dtype=np.int64)
        kind = np.int32 if not len(ends) or ends[-1] < 1 << 30 else np.int64
        first = np.repeat((self.starts[place] - (ends - length)).astype(kind), length)
        first += np.arange(len(first), dtype=kind)
        out = self.flat[first]
        edges = np.r_[0, ends][words.offsets.to_numpy()].tolist()
        for a, b in zip(edges, edges[1:]):
            yield out[a:b].tobytes()

    def _forget(self) -> None:
        #: Words met in plain texts, and where the ids of each lie in ``flat``.
        self.words = pa.array([""], pa.large_string())
        self.starts, self.lengths, self.flat = np.zeros(1, np.int32), np.zeros(1, np.int32), np.empty(0, "<u4")
        #: Hashes of the words in order, and the number of each one's word.
        self.hashes, self.numbers = _hashes(self.words), np.zeros(1, np.int32)

    def _find(self, unique: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1. Hashes only lead to a word, which is then compared."""
        number = self.numbers[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
        same = pc.equal(unique, self.words.take(pa.array(number)))
        return np.where(same.to_numpy(zero_copy_only=False), number, -1)

    def _places(self, unique: pa.Array) -> np.ndarray:
        """Where each word of a block is known; new ones are learnt, and if that gets too much, all before are forgotten."""
        hashes = _hashes(unique)
        place = self._find(unique, hashes)
        if (place < 0).any():
            held = (self.words, self.flat, self.starts, self.lengths, self.hashes, self.numbers)
            if sum(x.nbytes for x in held) > KNOWN_BYTES:
                self._forget()
                place = self._find(unique, hashes)
            new = np.flatnonzero(place < 0)
            missing = unique.take(pa.array(new))
            words = missing.to_pylist()
            learnt = self.learn(words)
            ids = [learnt[w] for w in words]
            place[new] = len(self.words) + np.arange(len(new))
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int32)
            self.starts = np.r_[self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)]
            self.lengths = np.r_[self.lengths, lengths]
            self.flat = np.r_[self.flat, np.frombuffer(b"".join(ids), dtype="<u4")]
            self.words = pa.concat_arrays([self.words, missing])
            # The table of hashes is kept in order instead of being made anew for each block.
            new = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, at, hashes[new])
            self.numbers = np.insert(self.numbers, at, place[new])
        return place


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[bool]]]:
    """Pieces of texts, some millions of characters at a time, with whether each ends its text."""
    held, lasts, size = [], [], 0
    for text in texts:
        for piece, last in _between_words(text or ""):
            held.append(piece)
            lasts.append(last)
            size += len(piece)
            if size >= BLOCK_CHARS:
                yield held, lasts
                held, lasts, size = [], [], 0
    yield held, lasts


def _between_words(text: str) -> Iterator[tuple[str, bool]]:
    """The text, or pieces of bounded length where it is long, cut at blanks; with whether it is the last one."""
    at, end = 0, len(text)
    if end > BLOCK_CHARS and not ODD_SPACE.search(text):
        while end - at > BLOCK_CHARS and (found := ANY_SPACE.search(text, at + BLOCK_CHARS)):
            yield text[at : found.start()], False
            at = found.start()
    yield text[at:], True
