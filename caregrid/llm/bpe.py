"""Byte pair encoding and decoding in batched numpy merge rounds.

``encode_documents`` gives the ids that the vocabulary's own tokenizer gives
(lower case, pieces split by a pattern, byte symbols, merges in rank order;
which code points are letters and digits is asked of the library once a worker),
and ``decode_documents`` turns ids back into text. The symbols of all new words
of a batch lie in one flat array. Each round finds the rank of every adjacent
pair by binary search over the sorted pair keys, takes each word's lowest rank
and merges all its occurrences, left to right; words without a pair leave.

Null texts are empty: no ids, empty decoded text. Special tokens written out in
a text become their ids. Texts of any length are taken whole, rows that repeat
stay as they are, extra columns are left out, and an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, id_and_text
from .words import SPACE, KeptIds, worker_ids

#: Fixed value: the pattern of a piece, with the classes of letters, digits and white space.
PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+"
PLANES = 0x40000  # no letters, digits or letter cases beyond

NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def library_class(name: str) -> set[str]:
    """The code points that the tokenizers library counts to a Unicode class."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(PLANES) if not 0xD800 <= c < 0xE000)
    return {c for run, _ in pre_tokenizers.Split(Regex(rf"[^\p{{{name}}}]+"), "removed").pre_tokenize_str(every) for c in run}


def _pattern(letters: str, digits: str) -> regex.Pattern:
    return regex.compile(PIECE.format(letters=letters, digits=digits, space=SPACE))


class WordBpe(KeptIds):
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.piece = _pattern(r"\p{L}", r"\p{N}")
        letters, digits = library_class("L"), library_class("N")
        #: Code points that the library's tables and ours class differently, or ours do not know; texts with them have a pattern of their own.
        points = [chr(c) for c in range(PLANES) if not 0xD800 <= c < 0xE000]
        ours = [set(regex.findall(rf"\p{{{k}}}", "".join(points))) for k in "LN"]
        self.their_piece = None
        self.classes = letters, digits
        self.odd = (ours[0] ^ letters) | (ours[1] ^ digits) | {c for c in points if unicodedata.category(c) == "Cn"}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab, end = spec["model"], spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = np.empty(max([*vocab.values(), *self.special.values()]) + 1, object)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = len(self.tokens)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made

    def cut(self, text: str) -> list[str]:
        if self.special_re and "<|" in text:
            out = []
            for part in self.special_re.split(text):
                out += [part] if part in self.special else self._pieces(part)
            return out
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            if not self.odd.isdisjoint(text):
                if self.their_piece is None:
                    self.their_piece = _pattern(*("".join(sorted(c)) for c in self.classes))
                return self.their_piece.findall(self.normalizer.normalize_str(text))
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the tokenizer lower-cases letter by letter
        return self.piece.findall(text.lower())

    def encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        raw = [c.encode("utf-8", "replace") for c in chunks]
        flat, n = self.merge(raw)
        own = [k for k, c in enumerate(chunks) if c in self.special]
        if own:
            ids = np.split(flat, np.cumsum(n)[:-1])
            for k in own:
                ids[k] = np.array([self.special[chunks[k]]])
            flat, n = np.concatenate(ids), np.array([len(x) for x in ids])
        return chunks, flat.astype(np.uint32), n

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, none of them empty, and how many each has."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(n) - 1
        sym = self.inner[data]
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(raw)), n)
        rank = self._ranks(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), size)
            live = best != NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, best = sym[live], word[live], rank[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            head = np.concatenate([[True], at[1:] != at[:-1] + 1])  # in aaa the first two merge
            run = at[np.flatnonzero(head)][np.cumsum(head) - 1]
            at = at[(at - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self._ranks(sym, word, changed)
        if not done_sym:
            return np.zeros(0, np.int64), n
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each of these places; NONE where there is none."""
        out = np.full(len(at), NONE)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        key = sym[at[inside]] * self.base + sym[at[inside] + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        out[inside[hit]] = self.rank[found[hit]]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder of its own, the vocabulary's tokens are joined by blanks."""
        return " ".join([t for t in self.tokens[ids] if t is not None])


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int)."""

    def run(batches):
        bpe = worker_ids(WordBpe, vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_bytes(texts):
                ids = bpe.ids(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.record_batch([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "_id long, ids array<int>").withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ``ids`` and ``decoded``; null ids decode to an empty text."""

    def run(batches):
        bpe = worker_ids(WordBpe, vocabulary)
        for batch in batches:
            ids = batch.column(1)
            for k in range(0, len(ids), 256):
                part = ids[k : k + 256]
                flat, at = part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy()
                out = [bpe.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column(0)[k : k + 256], part, pa.array(out, pa.string())], ["_id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "_id long, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
