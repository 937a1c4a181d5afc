"""Token-id files: frames of blocks, coded by an adaptive context-mixing range coder.

``write_ids`` encodes texts, sorts them by id across range partitions and
writes frames; ``read_ids`` decodes frames back into documents. A frame holds
whole documents: a header with their ids and lengths, then blocks of at most
BLOCK ids. Each block starts from a fresh model and carries a CRC-32 of its
ids, so blocks can be checked and decoded alone.

Coding an id: a block numbers its ids by first use, and these places are what
is predicted and coded. Order 2 predicts the place that last followed the two
before it, order 1 the one that last followed the one before it; order 0 is
how often the block used each file of places (file b: 2 ** b - 1 and the
2 ** b - 1 places after it). One symbol says which prediction holds, or that
the id is new, or the file of its place; the place in its file, or the new id,
follows as plain bits. The symbol's shares mix three counts: all symbols of the
block, those under the same trust in order 1, those under the same trust in
order 2; trust is whether a context is new, failed or held last time. Shares
are of 2 ** 12, so coding needs no division, and are mixed anew after 8, 16, 32
and then each 64 ids. All blocks of a frame advance together, one id at a time,
so each step is numpy work over all blocks. The model has integers only; the
decoder's quotients start as floats and are set right by integers, so any
machine decodes what another has written.

Files are Parquet tables with one frame a row (columns part, frame, n_docs,
n_tokens, data), which any store that Spark can write to takes, and which
survive lost executors. Null texts are empty (the end id alone); null ids come
first; rows with equal ids are ordered by a hash of their texts. An empty table
gives no frames.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, id_and_text
from .words import TokenizerIds, worker_ids

BLOCK = 1024
FRAME = 1 << 21  # ids after which a frame ends
MAGIC = b"CGIF"
HEAD = struct.Struct("<4sIIII")
TOTAL = 1 << 12  # of the shares of all symbols
SYMBOLS, WIDTH = 13, 16  # order 2 holds, order 1 holds, new id, ten files of places; columns of a table
STRIDE = BLOCK + 40  # from one lane's table to the next: no power of two, which would crowd few cache lines
TRUST = 3  # a context is new, its prediction failed, or held
MASK = np.uint16(2047)  # one more than the place in a prediction (0: none yet); trust stands above it
#: The symbol of each place: file b has places 2 ** b - 1 to 2 ** (b + 1) - 2; and the first place of each symbol.
FILE = 2 + np.frexp(np.arange(1.0, BLOCK + 1))[1].astype(np.int64)
FLOOR = np.concatenate([np.zeros(3, np.int64), (1 << np.arange(10)) - 1, np.zeros(3, np.int64)])


class _Model:
    """The models of many blocks, one a lane; tables are flat, with the lanes' parts one after another."""

    def __init__(self, lanes: int, bits: int) -> None:
        """bits: of the greatest id."""
        self.own = np.arange(lanes) * STRIDE
        self.rows = np.arange(lanes) * TRUST * TRUST
        self.guess = [np.zeros(lanes * STRIDE, np.uint16) for _ in range(2)]
        self.counts = [np.ones((lanes, n, WIDTH), np.int32) for n in (1, TRUST, TRUST)]
        self.last = np.zeros((2, lanes), np.int64)  # the place before, and the one before that
        self.raw = np.concatenate([[0, 0, min(bits, 16)], np.arange(10), np.zeros(3, np.int64)])
        self.mix()

    def mix(self) -> None:
        """Tables of all states from the counts: where each symbol starts, of TOTAL."""
        zero, one, two = (np.cumsum(c[:, :, :SYMBOLS], axis=2, dtype=np.int32) for c in self.counts)
        upto = zero[:, :, None] + 2 * one[:, None] + 4 * two[:, :, None]
        upto *= ((TOTAL - SYMBOLS) << 16) // upto[..., -1:]
        upto >>= 16
        starts = np.full((len(self.own), TRUST, TRUST, WIDTH), TOTAL, np.uint16)
        starts[..., 0] = 0
        starts[..., 1:SYMBOLS] = upto[..., :-1] + np.arange(1, SYMBOLS, dtype=np.int32)
        self.starts = starts.reshape(-1, WIDTH)
        self.flat = self.starts.reshape(-1)

    def count(self, row: np.ndarray, sym: np.ndarray) -> None:
        """Adds symbols seen in states; rows as ``predict`` gives them."""
        seen = 2 * np.bincount((row * WIDTH + sym).ravel(), minlength=self.flat.size).astype(np.int32).reshape(-1, TRUST, TRUST, WIDTH)
        one, two = seen.sum(axis=1, dtype=np.int32), seen.sum(axis=2, dtype=np.int32)
        for c, more in zip(self.counts, (one.sum(axis=1, keepdims=True, dtype=np.int32), one, two)):
            c += more

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What orders 1 and 2 predict (one more than the place, and trust above it), and the row of ``starts``."""
        a, b = self.last
        self.at = (self.own + a, self.own + ((a * 37 + b) & (BLOCK - 1)))
        one, two = (g.take(at) for g, at in zip(self.guess, self.at))
        return one, two, self.rows + ((two >> 11) * np.uint16(TRUST) + (one >> 11))

    def learn(self, place: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Each context now predicts the place; a prediction that held is trusted more."""
        short = place.astype(np.uint16) + np.uint16(1)
        new = short + np.uint16(2048)
        for g, at, said in zip(self.guess, self.at, (one, two)):
            g[at] = new + (((said & MASK) == short).astype(np.uint16) << np.uint16(11))
        self.last = (place, self.last[0] * 411 + 5)


class _Encoder:
    """Range coder of many lanes. low keeps a carry bit above its 62 bits; words have 32."""

    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 62)
        self.words: list[np.ndarray] = []
        self.lanes: list[np.ndarray] = []

    def put(self, start: np.ndarray, freq: np.ndarray, n: np.ndarray, value: np.ndarray) -> None:
        """A symbol, then a value of n bits as it is, in every lane."""
        r = self.range >> 12
        self.low += r * start
        self.range = (r * freq) >> n
        self.low += self.range * value
        short = np.flatnonzero(self.range < 1 << 30)
        if len(short):
            low = self.low[short]
            self.lanes.append(short)
            self.words.append(low >> 30)
            self.low[short] = (low & ((1 << 30) - 1)) << 32
            self.range[short] <<= 32

    def finish(self) -> list[bytes]:
        k = np.arange(len(self.low))
        lanes = np.concatenate([*self.lanes, k, k]).astype(np.uint32)
        words = np.concatenate([*self.words, self.low >> 30, (self.low & ((1 << 30) - 1)) << 2])
        order = np.argsort(lanes, kind="stable")
        words = words[order]
        while (over := np.flatnonzero(words >> 32)).size:  # carries into earlier words
            words[over] &= 0xFFFFFFFF
            words[over - 1] += 1
        ends = np.cumsum(np.bincount(lanes, minlength=len(k))).tolist()
        data = words.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


class _Decoder:
    def __init__(self, payloads: list[bytes]) -> None:
        n = max(map(len, payloads)) // 4 + 3
        words = np.zeros((len(payloads), n), np.int64)
        for i, p in enumerate(payloads):
            words[i, : len(p) // 4] = np.frombuffer(p, "<u4", len(p) // 4)
        self.code = (words[:, 0] << 30) | (words[:, 1] >> 2)
        self.words = (((words[:, 1:-1] & 3) << 30) | (words[:, 2:] >> 2)).astype(np.uint32)
        self.most = self.words.shape[1] - 1
        self.range, self.n = np.full(len(payloads), 1 << 62), np.zeros(len(payloads), np.int64)

    @staticmethod
    def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a // b, for ratios far below 2 ** 52: by floats, then set right."""
        got = (a / b).astype(np.int64)
        rest = a - got * b
        got += rest >= b
        got -= rest < 0
        return got

    def slot(self) -> np.ndarray:
        self.r = self.range >> 12
        return np.minimum(self._ratio(self.code, self.r), TOTAL - 1)

    def take(self, start: np.ndarray, freq: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Leaves the symbol of the slot behind and gives the value of n bits after it."""
        self.code -= self.r * start
        self.range = (self.r * freq) >> n
        value = self._ratio(self.code, self.range)
        self.code -= self.range * value
        short = np.flatnonzero(self.range < 1 << 30)
        if len(short):
            at = self.n[short]
            self.code[short] = (self.code[short] << 32) | self.words[short, np.minimum(at, self.most)]
            self.n[short] = at + 1
            self.range[short] <<= 32
        return value


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id its place in its row's list of ids by first use, and whether it is new there; one column a row."""
    lanes, n = ids.shape
    kind = np.int32 if bits <= 21 else np.int64
    place, new = np.empty((n, lanes), np.int16), np.empty((n, lanes), bool)
    at = np.arange(n, dtype=kind)
    for a in range(0, lanes, 128):
        part = ids[a : a + 128].astype(kind)
        keys = np.sort((part << 10) | at, axis=1)
        first = np.ones(part.shape, bool)
        first[:, 1:] = (keys[:, 1:] >> 10) != (keys[:, :-1] >> 10)
        pos = ((keys & (BLOCK - 1)) + n * np.arange(len(part), dtype=kind)[:, None]).ravel()
        first = first.ravel()
        fresh = np.zeros(pos.size, bool)
        fresh[pos[first]] = True
        rank = (np.cumsum(fresh.reshape(part.shape), axis=1, dtype=np.int16) - np.int16(1)).ravel()
        found = np.empty(pos.size, np.int16)
        found[pos] = rank[pos[first]][np.cumsum(first, dtype=np.int32) - 1]
        place[:, a : a + 128] = found.reshape(part.shape).T
        new[:, a : a + 128] = fresh.reshape(part.shape).T
    return place, new


def _windows(n: int):
    """Steps between two mixes of the tables: short at first, when each id teaches much."""
    a, size = 0, 8
    while a < n:
        yield a, min(a + size, n)
        a, size = a + size, min(2 * size, 64)


def _encode(ids: np.ndarray, bits: int) -> list[bytes]:
    """One payload for each row of ids."""
    lanes, n = ids.shape
    model, coder = _Model(lanes, bits), _Encoder(lanes)
    place, new = _places(ids, bits)
    whole, none = np.full(lanes, TOTAL), np.zeros(lanes, np.int64)
    one, two = np.empty((64, lanes), np.uint16), np.empty((64, lanes), np.uint16)
    row = np.empty((64, lanes), np.int64)
    for a, b in _windows(n):
        w, now, fresh, own = b - a, place[a:b].astype(np.int64), new[a:b], ids[:, a:b].T
        for i in range(w):
            one[i], two[i], row[i] = model.predict()
            model.learn(now[i], one[i], two[i])
        sym = FILE.take(now)
        value = now - FLOOR.take(sym)
        short = place[a:b].astype(np.uint16) + np.uint16(1)
        for said, s in ((one, 1), (two, 0)):
            held = (said[:w] & MASK) == short
            np.copyto(sym, s, where=held)
            np.copyto(value, 0, where=held)
        np.copyto(sym, 2, where=fresh)
        np.copyto(value, own & 0xFFFF, where=fresh)
        at = row[:w] * WIDTH + sym
        start = model.flat.take(at).astype(np.int64)
        freq = model.flat.take(at + 1) - start
        raw = model.raw.take(sym)
        for i in range(w):
            coder.put(start[i], freq[i], raw[i], value[i])
            if bits > 16:
                coder.put(none, whole, fresh[i] * (bits - 16), np.where(fresh[i], own[i] >> 16, 0))
        model.count(row[:w], sym)
        model.mix()
    return coder.finish()


def _decode(payloads: list[bytes], n: int, bits: int) -> np.ndarray:
    """The first n ids of each payload."""
    lanes = len(payloads)
    model, coder = _Model(lanes, bits), _Decoder(payloads)
    places, known = np.zeros((n, lanes), np.int16), np.zeros(lanes * STRIDE, np.uint32)
    used, none, whole = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, TOTAL)
    rows, syms = np.empty((64, lanes), np.int64), np.empty((64, lanes), np.int64)
    ones = np.uint64(0x0101010101010101)
    own = np.arange(lanes) * STRIDE
    for a, b in _windows(n):
        for i in range(b - a):
            one, two, row = model.predict()
            slot = coder.slot().astype(np.uint16)
            below = (model.starts.take(row, axis=0) <= slot[:, None]).view(np.uint64)  # a byte a symbol
            sym = (((below[:, 0] + below[:, 1]) * ones) >> np.uint64(56)).astype(np.int64) - 1
            at = row * WIDTH + sym
            start = model.flat.take(at).astype(np.int64)
            value = coder.take(start, model.flat.take(at + 1) - start, model.raw.take(sym))
            place = FLOOR.take(sym) + value
            np.copyto(place, (one & MASK) - np.uint16(1), where=sym == 1)
            np.copyto(place, (two & MASK) - np.uint16(1), where=sym == 0)
            fresh = sym == 2
            if bits > 16:
                coder.slot()
                value += coder.take(none, whole, fresh * (bits - 16)) << 16
            np.copyto(place, used, where=fresh)
            np.minimum(place, BLOCK - 1, out=place)  # damaged data may point anywhere
            k = np.flatnonzero(fresh)
            known[own[k] + place[k]] = value[k]
            used += fresh
            model.learn(place, one, two)
            places[a + i], rows[i], syms[i] = place, row, sym
        model.count(rows[: b - a], syms[: b - a])
        model.mix()
    return known[own[:, None] + places.T]


def bit_sizes(ids: np.ndarray) -> int:
    return int(ids.max(initial=0)).bit_length()


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(number of ids, CRC-32, payload) of each block; all but the last have BLOCK ids."""
    if not len(ids):
        return []
    blocks = -(-len(ids) // BLOCK)
    lengths = [BLOCK] * (blocks - 1) + [len(ids) - BLOCK * (blocks - 1)]
    wide = min(len(ids), BLOCK)
    padded = np.full(blocks * wide, ids[-1], np.int64)  # what fills the last block is not read back
    padded[: len(ids)] = ids
    raw = ids.astype("<u4")
    payloads = _encode(padded.reshape(blocks, wide), bit_sizes(ids))
    return [(n, zlib.crc32(raw[i * BLOCK : i * BLOCK + n]), p) for i, (n, p) in enumerate(zip(lengths, payloads))]


def decode_blocks(blocks: list[tuple[int, int, bytes]], bits: int) -> np.ndarray:
    """The ids of blocks in order, bits being bit_sizes of them all; raises where a checksum differs."""
    if not blocks:
        return np.zeros(0, "<u4")
    got = _decode([p for _, _, p in blocks], max(n for n, _, _ in blocks), bits).astype("<u4")
    parts = [row[:n] for row, (n, _, _) in zip(got, blocks)]
    for i, (part, (_, crc, _)) in enumerate(zip(parts, blocks)):
        if zlib.crc32(part.tobytes()) != crc:
            raise ValueError(f"block {i}: the checksum differs")
    return np.concatenate(parts)


def pack_frame(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Header, (present, id, length) of each document, (ids, CRC-32, bytes) of each block, payloads."""
    flat = np.concatenate(ids)
    blocks = encode_blocks(flat)
    docs = np.array([(k is not None, k or 0, len(x)) for k, x in zip(keys, ids)], "<i8")
    sizes = np.array([(n, crc, len(p)) for n, crc, p in blocks], "<u4")
    return b"".join([HEAD.pack(MAGIC, 2, bit_sizes(flat), len(keys), len(blocks)), docs.tobytes(), sizes.tobytes(), *(p for _, _, p in blocks)])


def unpack_frame(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, version, bits, n_docs, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC or version != 2:
        raise ValueError("not a frame")
    docs = np.frombuffer(data, "<i8", 3 * n_docs, HEAD.size).reshape(-1, 3)
    at = HEAD.size + 24 * n_docs
    blocks = []
    start = at + 12 * n_blocks
    for n, crc, size in np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3).tolist():
        blocks.append((n, crc, data[start : start + size]))
        start += size
    ids = decode_blocks(blocks, bits)
    return [k if there else None for there, k, _ in docs.tolist()], np.split(ids, np.cumsum(docs[:, 2])[:-1])


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids in ascending id order under the path."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        tok, part, frame = worker_ids(TokenizerIds, vocabulary), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0

        def row():
            data = pack_frame(keys, ids)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([frame], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                ["part", "frame", "n_docs", "n_tokens", "data"],
            )

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts):
                for key, x in zip(own[a:b], tok.ids(texts[a:b])):
                    x = np.append(x, np.uint32(end_id))
                    keys.append(key)
                    ids.append(x)
                    held += len(x)
                    if held >= FRAME:
                        yield row()
                        keys, ids, held, frame = [], [], 0, frame + 1
        if keys:
            yield row()

    rows = id_and_text(docs, id_col, text_col)
    tie = F.xxhash64("_text")
    dealt = rows.withColumn("_tie", tie).repartitionByRange(parts, "_id", "_tie").sortWithinPartitions("_id", "_tie")
    dealt.select("_id", "_text").mapInArrow(run, "part int, frame long, n_docs long, n_tokens long, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """id, start (ids before it in all files), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches):
        for batch in batches:
            for part, frame, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                keys, ids = unpack_frame(data)
                n = np.array([len(x) for x in ids], np.int64)
                cols = [
                    pa.array([part] * len(keys), pa.int32()),
                    pa.array([frame] * len(keys), pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(np.cumsum(n) - n),
                    pa.array(n),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names)

    names = ["part", "frame", "_id", "_in", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "part int, frame long, _id long, _in long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    frames = spark.read.parquet(path)
    # frames a part, then parts: few rows reach the window that has no partition
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier("n", Window.orderBy("part")).alias("_part"))
    starts = frames.select("part", "frame", earlier("n_tokens", Window.partitionBy("part").orderBy("frame")).alias("_frame"))
    found = frames.select("part", "frame", "data").mapInArrow(run, schema)
    rows = found.join(starts, ["part", "frame"]).join(parts, "part")
    start = F.col("_part") + F.col("_frame") + F.col("_in")
    return rows.select(F.col("_id").alias(id_col), start.alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
