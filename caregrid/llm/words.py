"""Token ids of whole texts from a vocabulary file, with the ids of common chunks kept.

A byte pair tokenizer never merges across the start of a white-space run, so a
text can be cut there and each chunk encoded alone. Most chunks recur, so a
worker keeps the ids of the different chunks it meets first (the common ones
come early), up to ``most`` bytes of them, and encodes only the others anew. A
chunk of more than ``longest`` characters is never kept.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import repeat

import numpy as np

#: White space by Unicode.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts before each run of white space.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SOLID = re.compile(f"[^{SPACE}]+")
#: Letters by any version of Unicode, and marks that no rule of a tokenizer ties to the letters before them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = ".,;:!?%*&#$"
#: As CHUNK, but marks that end a word of letters are chunks of their own: far fewer chunks differ.
PARTED = re.compile(f"[{SPACE}]*+[{LETTERS}]++(?=[{MARKS}]*+(?:[{SPACE}]|\\Z))|[{MARKS}]++(?=[{SPACE}]|\\Z)|{CHUNK.pattern}")
SPACES = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))


class KeptIds:
    """ids(texts) -> a uint32 array for each text. Subclasses say how to cut and how to encode chunks."""

    most = 128 << 20
    longest = 256

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0  # bytes that the kept chunks take, about
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks in some order, all their ids in one array, and how many of them each chunk has."""
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [self.cut(t) for t in texts]
        place, unknown = self.place, repeat(-1)
        found = [np.fromiter(map(place.get, row, unknown), np.int64, len(row)) for row in chunks]
        missing = [np.flatnonzero(at < 0).tolist() for at in found]
        new = list(dict.fromkeys(row[k] for row, miss in zip(chunks, missing) for k in miss))
        short = [c for c in new if len(c) <= self.longest]
        cost = sum(map(len, short)) + 150 * len(short)
        if self.held + cost > self.most:
            short, cost = [], 0
        if short:
            self._add(short)
        self.held += cost
        kept, used = len(place), self.used
        once = [c for c in new if c not in place]
        if once:
            self._add(once)
        out = []
        for row, at, miss in zip(chunks, found, missing):
            if miss:
                at[miss] = [place[row[k]] for k in miss]
            n = self.n.take(at)
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(row) else 0
            out.append(self.flat.take(np.repeat(self.first.take(at) - ends + n, n) + np.arange(total)))
        if once:  # forgotten, with the room they took
            for c in once:
                del place[c]
            self.used = used
            if len(self.flat) > 4 * max(used, 1 << 16):
                self.flat = self.flat[: max(used, 1 << 16)].copy()
            assert len(place) == kept
        return out

    def _add(self, new: list[str]) -> None:
        new, flat, n = self.encode(new)
        k = len(self.place)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(new) > len(self.n):
            self.first, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.n))
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[k : k + len(new)] = self.used + np.cumsum(n) - n
        self.n[k : k + len(new)] = n
        self.place.update(zip(new, range(k, k + len(new))))
        self.used += len(flat)


class TokenizerIds(KeptIds):
    """The tokenizers library on chunks.

    A vocabulary that drops white space gets chunks without it, of which fewer differ.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.drops = not self.tok.encode(" \n ", add_special_tokens=False).ids
        self.chunk = SOLID if self.drops else PARTED if self._parts_marks() else CHUNK
        vocab = self.tok.get_vocab(with_added_tokens=True)
        end = getattr(self.tok.model, "end_of_word_suffix", None) or ""
        #: Bytes that each id stands for: byte-level tokens have a letter a byte.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(end))

    def cut(self, text: str) -> list[str]:
        return self.chunk.findall(text)

    def _parts_marks(self) -> bool:
        """Whether the tokenizer itself cuts between letters and marks, and has no token of its own that would span the cut."""
        words = [f" {w}" for w in ("a", "He", "\u00c0\u00ff", "\u024f")]
        cuts = self.tok.pre_tokenizer and all([at for _, at in self.tok.pre_tokenizer.pre_tokenize_str(w + MARKS)] == [(0, len(w)), (len(w), len(w + MARKS))] for w in words)
        return bool(cuts) and not self.tok.normalizer and not any(set(MARKS) & set(t.content) for t in self.tok.get_added_tokens_decoder().values())

    def encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chunks are encoded many at a time, as one text; where each ends shows in the widths of the ids."""
        if self.drops:
            joined, alone = [c for c in chunks if "<" not in c], [c for c in chunks if "<" in c]
        else:  # ids are the same amid other chunks where spaces come first and only there
            joined = [c for c in chunks if c[0] in SPACES and c[-1] not in SPACES and "<" not in c]
            alone = [c for c in chunks if c[0] not in SPACES or c[-1] in SPACES or "<" in c]
        runs = [joined[k : k + 256] for k in range(0, len(joined), 256)]
        flat, counts, order = [], [], []
        for run, ids in zip(runs, self._batch([(" " if self.drops else "").join(run) for run in runs])):
            ends = np.cumsum(self._bytes(run))
            reached = np.cumsum(self.width[ids])
            cuts = np.searchsorted(reached, ends, side="right")
            if len(ids) and cuts[0] and cuts[-1] == len(ids) and (reached[cuts - 1] == ends).all():
                flat.append(ids)
                counts.append(np.diff(cuts, prepend=0))
                order += run
            else:
                alone += run
        got = self._batch(alone)
        counts.append(np.fromiter(map(len, got), np.int64, len(got)))
        return order + alone, np.concatenate([*flat, *got, np.zeros(0, np.uint32)]), np.concatenate(counts)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, run: list[str]) -> list[int]:
        """Bytes of each chunk as the vocabulary sees it."""
        if self.drops and not "".join(run).isascii():
            run = [c if c.isascii() else unicodedata.normalize("NFC", c).replace("\u03a3", "\u03c3").lower() for c in run]
        try:
            return list(map(len, map(str.encode, run)))
        except UnicodeEncodeError:  # lone surrogates
            return [len(c.encode("utf-8", "replace")) for c in run]


_kept: dict = {}


def worker_ids(kind: type, path: str) -> KeptIds:
    """The worker's own encoder for a vocabulary file; workers outlive tasks, and so do the chunks they keep."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]
