"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library.

For a tokenizer that drops white space between its tokens, the ids of a text are those of its pieces between blanks,
one after another.  Texts are taken in batches whose distinct pieces are encoded once.  Pieces of plain letters, digits
and signs are split where the tokenizer would split them; words of Latin letters then go through ``tiktoken`` with the
same merges, which is several times faster, and all others through the library itself, which are remembered.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: Pieces that the tokenizer only lowers and splits: no apostrophes (contractions), no marks that could compose.
_PLAIN = r"[!-&(-~À-ÖØ-öø-þ]+"
_CORE = re.compile(r"[a-zß-öø-þ]+|[0-9]|[^a-zß-öø-þ0-9]+")
_LETTERS = r"[a-zß-öø-þ]+"
_WORD = re.compile(_LETTERS)
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0xFF) if c != 0xF7)
#: How a word's last letter is written for the faster library: as a capital; the sign for times stands in for that of ß.
_LAST = {c: "×" if c == "ß" else c.upper() for c in _LOWER}


def _strings(texts: pa.Array) -> list[str]:
    """As Python strings, converted all at once."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class _Table:
    """Ids by piece, as slices of one growing array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 12, np.uint32), 0
        self.start, self.length = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Pieces that are new here, their ids one after another."""
        n, at = len(ids), len(self.known)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), np.uint32)])
        if at + len(pieces) > len(self.start):
            more = np.zeros(max(len(pieces), len(self.start)), np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.ids[self.used : self.used + n] = ids
        self.length[at : at + len(pieces)] = length
        self.start[at : at + len(pieces)] = self.used + np.cumsum(length) - length
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.used += n

    def rows(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after another, and their lengths."""
        length = self.length[rows]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[rows] - (ends - length), length) + np.arange(total)], length


class Encoder:
    """Encodes texts; at most about ``most`` pieces that only the library can encode are remembered."""

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.wide = max(vocabulary.values()) >= 1 << 16
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = self._letters()
        self.kept = _Table()

    def _letters(self) -> tuple[tiktoken.Encoding, np.ndarray] | None:
        """The same merges over words of Latin letters, for the faster library, and the ids of its ranks.

        None if the vocabulary is no byte-level one that marks word ends by a suffix.
        """
        model = json.loads(self.tokenizer.to_str())["model"]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
            return None
        byte_of = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if chr(b) not in byte_of)}
        inner = {*_LOWER[:26].encode(), *chain.from_iterable(c.encode() for c in _LOWER[26:])}
        last = {c.encode()[-1]: _LAST[c].encode()[-1] for c in _LOWER}
        ranks, ids = {}, []

        def add(token: str) -> None:
            word = bytes(byte_of[c] for c in token.removesuffix("</w>"))
            if token in model["vocab"] and word and inner.issuperset(word):
                if token.endswith("</w>"):
                    if word[-1] not in last:
                        return
                    word = word[:-1] + bytes([last[word[-1]]])
                ranks[word] = len(ids)
                ids.append(model["vocab"][token])

        for c, b in byte_of.items():
            if b in inner:
                add(c)
                add(c + "</w>")
        if len(ids) < len(inner) + len(last):
            return None
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            add(a + b)
        return tiktoken.Encoding("letters", pat_str="[a-zß-öø-þ]*[A-ZÀ-Þ]", mergeable_ranks=ranks, special_tokens={}), np.array(ids, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words of Latin letters."""
        if self.letters:
            ids = self.letters[1][self.letters[0].encode_ordinary("".join([w[:-1] + _LAST[w[-1]] for w in words]))]
        else:
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(got)), np.uint32), np.array([len(x) for x in got], np.int64)

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of pieces that only the library can encode."""
        if len(self.kept.known) > self.most or self.kept.used > 4_000_000:
            self.kept = _Table()
        fresh = [p for p in pieces if p not in self.kept.known]
        if fresh:
            self.kept.add(fresh, *self._each(fresh))
        return self.kept.gather(self.kept.rows(pieces))

    def _table(self, pieces: pa.Array) -> tuple[_Table, np.ndarray]:
        """The ids of distinct pieces, and the row of each."""
        is_word = pc.match_substring_regex(pieces, f"^(?:{_LETTERS})$").to_numpy(zero_copy_only=False)
        is_plain = pc.match_substring_regex(pieces, f"^(?:{_PLAIN})$").to_numpy(zero_copy_only=False) & ~is_word & ~pc.match_substring(pieces, "<|").to_numpy(zero_copy_only=False)
        words, plain, other = (_strings(pieces.filter(pa.array(m))) for m in (is_word, is_plain, ~is_word & ~is_plain))
        cores = [_CORE.findall(p) for p in _strings(pc.utf8_lower(pieces.filter(pa.array(is_plain))))]
        rows, n_words = np.zeros(len(pieces), np.int64), len(words)
        rows[is_word] = np.arange(n_words)
        own_other, table, have = other, _Table(), set(words)
        other = list(other)
        for c in dict.fromkeys(chain.from_iterable(cores)):
            if c not in have:
                (words if _WORD.fullmatch(c) else other).append(c)
        if words:
            table.add(words, *self._words(words))
        if other:
            other = list(dict.fromkeys(other))
            table.add(other, *self._others(other))
        pairs = [(p, c) for p, c in zip(plain, cores, strict=True) if p not in table.known]  # a sign is its own core
        if pairs:
            ids, length = table.gather(table.rows(list(chain.from_iterable(c for _, c in pairs))))
            first = np.cumsum([0, *[len(c) for _, c in pairs]])[:-1]
            table.add([p for p, _ in pairs], ids, np.add.reduceat(length, first))
        rows[is_plain], rows[~is_word & ~is_plain] = table.rows(plain), table.rows(own_other)
        return table, rows

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        cut = pc.split_pattern(pa.array([x.replace("\n", " ").replace("\t", " ").replace("\r", " ") for x in texts], pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        table, rows = self._table(words.dictionary)
        ids, length = table.gather(rows[words.indices.to_numpy()])
        after = np.concatenate([[0], np.cumsum(length)])[cut.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in pairwise(after)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def batches_of(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together."""
    batch, n = [], 0
    for text in texts:
        batch.append(text)
        n += len(text)
        if n >= chars:
            yield batch
            batch, n = [], 0
    if batch:
        yield batch


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder; tasks that follow each other in one worker share what it remembers."""
    return Encoder(path)


def default_vocabulary() -> str:
    """Path of the default vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
