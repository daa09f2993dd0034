"""Exact tokenisation with public vocabularies, made fast by caching per white-space delimited word.

Both vocabularies are loaded with their own library. The caches only skip repeated work: the pre-tokeniser of the word
vocabulary never lets a token cross white space, and no piece of the sentence-piece vocabulary continues past the end of a
word (checked when it is loaded), so a text's ids are the ids of its parts in order. Caches are emptied at a fixed number of bytes.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np

from synapta.llm.common import ENTRY_BYTES, worker_cache

#: Tokenising a word costs far more than keeping it, so this cache may be larger than others.
CACHE_BYTES = 96 << 20

#: Letters that lower-case to one character and need no Unicode normalisation: ASCII, Latin-1 and Latin Extended-A.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-žƀ"
#: Texts of these characters only (letters, ASCII, Latin-1 marks, general punctuation, euro) take the cached path.
PLAIN = rf"[\x20-\x7e\t\n\x0b\x0c\r¡-¬®-¿×÷‐-‧€{LETTERS}]*"
#: The pre-tokeniser pattern of the word vocabulary (fixed value of the vocabulary file), for lower-case plain texts.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾{LETTERS}]+"
#: New pre-tokens that the library gets as one text.
JOINED = 1000


def vocabulary(name: str, root: str | None = None) -> str:
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbered(dict):
    """Numbers its keys in order of their first look-up; ``new`` lists those not seen to yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class WordEncoder:
    """ids of texts under a ``tokenizers`` vocabulary that cuts texts into pre-tokens before it merges.

    A plain text is cut with the vocabulary's own pattern and each distinct pre-token is encoded once by the library, many of
    them as one text with spaces between (no pre-token reaches over a space). The vocabulary marks the last token of a
    pre-token, which tells them apart again. Any other text (other alphabets, special strings) is encoded whole by the library.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.plain, self.pretoken, self.cache_bytes = re.compile(PLAIN), re.compile(PRETOKEN), cache_bytes
        vocab, suffix = self.lib.get_vocab(with_added_tokens=False), getattr(self.lib.model, "end_of_word_suffix", None)
        #: By id, whether a token ends its pre-token.
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        self.reset()

    def reset(self) -> None:
        self.known = Numbered()
        self.flat, self.start, self.size, self.chars = array("I"), array("q"), array("q"), 0

    def _library(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, parts: list[str], whole: set[str]) -> None:
        """Adds the ids of ``parts``: pre-tokens of plain texts, and the texts in ``whole``."""
        for alone, run in itertools.groupby(parts, whole.__contains__):
            while some := list(itertools.islice(run, JOINED)):
                ids = np.array(self._library([" ".join(some)])[0] if not alone else [], np.int64)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(some):  # whole texts, or a vocabulary without the mark
                    each = self._library(some)
                    ends = np.cumsum(list(map(len, each)))
                    ids = np.fromiter(itertools.chain.from_iterable(each), np.int64, int(ends[-1]))
                size = np.diff(ends, prepend=0)
                self.start.frombytes((ends - size + len(self.flat)).tobytes())
                self.size.frombytes(size.tobytes())
                self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.chars += sum(map(len, parts))
        parts.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and the number of ids of each text."""
        if self.chars + ENTRY_BYTES * len(self.known) > self.cache_bytes:
            self.reset()
        known, find = self.known, self.pretoken.findall
        parts, whole = [], set()
        for text in texts:
            if not text:
                parts.append([])
            elif self.plain.fullmatch(text) and "<|" not in text:
                parts.append(find(text.lower()))
            else:
                parts.append([text])
                whole.add(text)
        n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(n_parts.sum()))
        self._learn(known.new, whole)
        size, start = (np.frombuffer(x, np.int64)[at] if len(at) else at for x in (self.size, self.start))
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        ids = flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(n_parts)])])


class PieceCounter:
    """Numbers of tokens under a ``sentencepiece`` vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        pieces = [p for p in pieces if len(p) > 1]
        #: True if no token can hold a space mark after another character: then a word's end is always a token's end.
        self.words_apart = not any("▁" in p.lstrip("▁") for p in pieces)
        #: Pairs of neighbouring characters inside the pieces. Where a text has another pair, no token and no merge spans it.
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:])] + [0], np.uint64))
        #: A character that no piece joins to another: in front of a chunk it keeps the library's own first space away.
        self.apart = next((c for c in "\n\t\r\x1f" if not any(c in p for p in pieces)), None)
        self.lead = len(self.lib.encode(self.apart)) if self.apart else 0
        self.known: dict[str, int] = {}
        self.chars = 0

    def whole(self, text: str) -> int:
        return len(self.lib.encode(text))

    def stable(self, text: str) -> np.ndarray:
        """Positions inside the text that no token can span, ascending."""
        codes = np.frombuffer(text.replace(" ", "▁").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pair = codes[:-1] << np.uint64(21) | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.flatnonzero(self.pairs[at] != pair) + 1

    def starts(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Where each token of text[lo:hi] starts, as positions of the whole text. The first tokens may be wrong if lo is inside one."""
        lead = self.lead if lo else 0
        piece = self.apart + text[lo:hi] if lo else text[:hi]
        offsets = self.lib.encode(piece, return_type="offset_mapping")["offsets"]
        return np.array([x for x, _ in offsets[lead:]], np.int64) + (lo - 1 if lo else 0)

    def segments(self, text: str) -> list[str]:
        """The text cut before each run of spaces that follows another character; one space of a run is left out, as the
        library puts one in front of whatever it encodes."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, lead = [], 0
        for p in parts:
            if p:
                out.append(" " * lead + p)
                lead = 0
            else:
                lead += 1
        return out + [" " * lead] if lead else out

    def sizes(self, segments: list[str]) -> list[int]:
        """Tokens of each segment. A last segment of spaces only stands for itself, see ``count``."""
        known = self.known
        if self.chars + ENTRY_BYTES * len(known) > CACHE_BYTES:
            known.clear()
            self.chars = 0
        got = list(map(known.get, segments))
        if None in got:
            todo = list({s for s, n in zip(segments, got) if n is None})
            known.update(zip(todo, map(len, self.lib.encode(todo, num_threads=1))))
            self.chars += sum(map(len, todo))
            got = list(map(known.get, segments))
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.words_apart or not text.strip(" ") or "▁" in text:  # the library's own mark for a space joins with spaces
            return self.whole(text)
        tail = len(text) - len(text.rstrip(" "))
        body = text[: len(text) - tail] if tail else text
        n = sum(self.sizes(self.segments(body)))
        return n + (1 if tail == 1 else self.whole(" " * (tail - 1)) if tail else 0)


def word_encoder(path: str, cache_bytes: int = CACHE_BYTES) -> WordEncoder:
    """One encoder a Python worker, kept between batches and tasks."""
    return worker_cache(("words", path, cache_bytes), lambda: WordEncoder(path, cache_bytes))


def piece_counter(path: str) -> PieceCounter:
    return worker_cache(("pieces", path), lambda: PieceCounter(path))
