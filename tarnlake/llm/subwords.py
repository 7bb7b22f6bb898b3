"""Subword ids of white-space separated words, remembered per worker."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import regex

#: Words kept per worker process; the memory starts anew beyond.
KEPT_WORDS = 500_000
#: Parts of words kept, and words a lexicon holds before its user clears it.
KEPT_PIECES = 200_000
LEXICON_WORDS = 600_000
#: A mark that the tokenizer file knows as one id and cuts out before all else.
BORDER = "<|endoftext|>"
#: Characters that Python's split takes for space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")

#: Steps of a tokenizer file under which a printable Latin word is lower-cased and cut by one pattern, the bytes of
#: each cut going to the model as characters.
PLAIN_NORMALIZERS = {"NFC", "Lowercase", "Replace"}
PLAIN_CUTS = [("Split", "Removed"), ("ByteLevel", None)]
#: Characters from here on are left to the tokenizer; those before have no composed forms.
BEYOND_LATIN = "\u0250"
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}

_loaded: dict[str, Encoder] = {}
_lexicons: dict[str, Lexicon] = {}


class Encoder:
    """Ids of texts under a tokenizer file that treats white space as a border only.

    The ids of such a text are the ids of its words in order, so each distinct word is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.border = self.tokenizer.token_to_id(BORDER)
        self.known: dict = {}
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = re.compile("|".join(marks) or "(?!)")
        self.model, self.pieces = self.tokenizer.model, {}
        self.cut = self.plain_cut(path)
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    @staticmethod
    def plain_cut(path: str):
        """The pattern that cuts printable Latin words, or None if the file has other steps."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        normal, cuts = file["normalizer"] or {}, file["pre_tokenizer"] or {}
        normal, cuts = normal.get("normalizers", [normal]), cuts.get("pretokenizers", [cuts])
        lowers = any(n.get("type") == "Lowercase" for n in normal)
        spaces_only = all(n["pattern"] == {"Regex": "\\s+"} for n in normal if n.get("type") == "Replace")
        steps = [(c.get("type"), c.get("behavior")) for c in cuts]
        if not (lowers and spaces_only and {n.get("type") for n in normal} <= PLAIN_NORMALIZERS and steps == PLAIN_CUTS):
            return None
        whole = not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and not file["post_processor"]
        pattern = cuts[0]["pattern"].get("Regex")
        return regex.compile(pattern) if whole and cuts[0]["invert"] and pattern else None

    def plain(self, word: str | bytes) -> bytes | None:
        """Ids of a printable Latin word without marks; None for any other."""
        word = word.decode("utf-8", "replace") if isinstance(word, bytes) else word
        if not (word.isascii() or max(word) < BEYOND_LATIN) or not word.isprintable() or self.mark.search(word):
            return None
        word = word.lower()
        found = [word] if word.isalpha() else self.cut.findall(word)
        for x in found:
            if x not in self.pieces:
                chars = x if x.isascii() else "".join([BYTE_CHARS[b] for b in x.encode()])
                self.pieces[x] = b"".join([self.raw[t.id] for t in self.model.tokenize(chars)])
        return b"".join([self.pieces[x] for x in found])

    def encode_words(self, words: list) -> list[bytes]:
        """Ids of distinct words, each as unsigned 32-bit numbers."""
        out = [self.plain(w) if self.cut else None for w in words]
        left = [i for i, ids in enumerate(out) if ids is None]
        alone = []
        # Many words in one call, set apart by a mark that is an id of its own.
        for i in range(0, len(left), 1000):
            part = [k for k in left[i : i + 1000] if (BORDER.encode() if isinstance(words[k], bytes) else BORDER) not in words[k]]
            alone += set(left[i : i + 1000]).difference(part)
            if not part:
                continue
            ids = self.ids((BORDER.encode() if isinstance(words[part[0]], bytes) else BORDER).join(words[k] for k in part))
            cuts = np.flatnonzero(ids == self.border)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer file has no mark of its own between words")
            edges = np.concatenate([[-1], cuts, [len(ids)]]).tolist()
            raw = ids.tobytes()
            for n, k in enumerate(part):
                out[k] = raw[4 * edges[n] + 4 : 4 * edges[n + 1]]
        for k in alone:
            out[k] = self.ids(words[k]).tobytes()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        return out

    def learn(self, words: set) -> None:
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list(words)
        self.known.update(zip(new, self.encode_words(new), strict=True))

    def ids(self, text: str | bytes) -> np.ndarray:
        text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def split_ids(self, split: list[list]) -> list[np.ndarray]:
        """Ids of texts already split into words."""
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]

    def text_ids(self, texts: list[str]) -> list[np.ndarray]:
        out = self.split_ids([t.split() for t in texts])
        for i, text in enumerate(texts):
            if ODD_SPACE.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out


class Lexicon:
    """Words of a worker by number, with the subword ids and the hash of each."""

    def __init__(self, path: str, word_hash):
        self.encode, self.word_hash = encoder(path), word_hash
        self.clear()

    def clear(self) -> None:
        #: A word that is looked up the first time gets the next number.
        self.number: dict = defaultdict(count().__next__)
        self.hashes, self.ids, self.ends = np.zeros(0, np.uint64), np.zeros(0, "<u2"), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.number) > LEXICON_WORDS

    def numbers(self, split: list[list]) -> np.ndarray:
        """Numbers of the words of all texts, in order."""
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.number) > known:
            new = list(islice(reversed(self.number), len(self.number) - known))[::-1]
            ids = self.encode.encode_words(new)
            self.hashes = np.append(self.hashes, np.fromiter(map(self.word_hash, new), np.uint64, len(new)))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in ids]))
            self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4").astype("<u2"))
        return numbers

    def subwords(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where each word's begin (and the last's end)."""
        begins = self.ends[numbers]
        lengths = self.ends[numbers + 1] - begins
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.arange(edges[-1]) + np.repeat(begins - edges[:-1], lengths)], edges


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def lexicon(path: str, word_hash) -> Lexicon:
    if path not in _lexicons:
        _lexicons[path] = Lexicon(path, word_hash)
    return _lexicons[path]
