"""Packing documents into sequences by deficit round-robin over source queues."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_few, checkpoint, mixed_hash, prefix_sums, spread, table, tidy
from tessera.shipping import ship

#: What a text has beyond the letters, digits, signs and white space whose pieces are known by heart.
OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("rid", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


#: Bytes of lower-case texts that are cut into pieces at a time, and the longest piece that is known by its hash.
BATCH, LONGEST = 1 << 20, 32
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.array([_LETTER if b >= 128 or 97 <= b < 123 else _DIGIT if 48 <= b < 58 else 0 if b < 33 else _SIGN for b in range(256)], dtype=np.int8)
_BYTE = np.random.default_rng(41).integers(1, 1 << 63, size=256, dtype=np.uint64)
_ONE = np.zeros(256, dtype=bool)
_ONE[[ord(c) for c in "stmd"]] = True


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the vocabulary's pieces in bytes of lower-case texts without OTHER: runs of letters, single digits, runs of signs; an apostrophe that begins a run takes s, t, m, d, re, ve or ll after it."""
    kind = np.zeros(len(raw) + 2, dtype=np.int8)
    kind[1:-1] = _CLASS[raw]
    here, single = kind[1:-1], kind[1:-1] == _DIGIT
    edge = kind[1:] != kind[:-1]
    start = np.flatnonzero((here != 0) & (edge[:-1] | single))
    stop = np.flatnonzero((here != 0) & (edge[1:] | single)) + 1
    k = np.flatnonzero((raw[start] == 39) & (stop - start == 1))
    k = k[k + 1 < len(start)]
    k = k[(start[k + 1] == stop[k]) & (here[start[k + 1]] == _LETTER)]
    if len(k):
        at = start[k + 1]
        a, b = raw[at], np.where(stop[k + 1] - at > 1, raw[np.minimum(at + 1, len(raw) - 1)], 0)
        two = (b == 101) & ((a == 114) | (a == 118)) | (a == 108) & (b == 108)
        n = np.where(_ONE[a], 1, np.where(two, 2, 0))
        stop[k] += n
        start[k + 1] += n
        keep = start < stop
        start, stop = start[keep], stop[keep]
    return start, stop


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 16-bit numbers.

    Pieces are cut and hashed in numpy, and their ids are found in a table of this process by open addressing; pieces
    that it lacks are encoded together. Texts with characters of OTHER, special tokens, pieces over LONGEST bytes or
    over BATCH bytes themselves are encoded one by one.
    """

    def __init__(self, path: str, end_id: int, most: int = 900_000, bits: int = 21):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most, self.bits = Tokenizer.from_file(path), np.array([end_id], dtype="<u2").tobytes(), most, bits
        self.special = [str(t.content).lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(1 << 16, dtype=bool)  # of tokens that end a piece
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.powers = []
        base = int(_BYTE[0]) | 1
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(BATCH + 1, x, dtype=np.uint64)
            p[0] = 1
            self.powers.append(np.multiply.accumulate(p))
        self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        self.n, self.used = 0, 0  # pieces and ids kept
        self.first, self.count, self.ids = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 18, dtype="<u2")

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the kept pieces; -1 of those that are new."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo, slot, mask = np.arange(len(h)), self.slots(h), np.uint64((1 << self.bits) - 1)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            more = ~hit & (key != 0)
            todo, slot = todo[more], (slot[more] + np.uint64(1)) & mask
        return out

    def keep(self, h: np.ndarray, pieces: list[str]) -> None:
        """Adds new pieces, each once, with their ids."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u2")  # without offsets
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            each = [self.direct(p) for p in pieces]
            ids, stops = np.frombuffer(b"".join(each), dtype="<u2"), np.cumsum([len(x) // 2 for x in each])
        new = np.arange(self.n, self.n + len(h))
        for name, size in (("first", self.n + len(h)), ("count", self.n + len(h)), ("ids", self.used + len(ids))):
            if len(x := getattr(self, name)) < size:
                setattr(self, name, np.concatenate([x, np.zeros(max(size, len(x)), dtype=x.dtype)]))
        self.first[new], self.count[new] = self.used + np.concatenate([[0], stops[:-1]]), np.diff(stops, prepend=0)
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(h), self.used + len(ids)
        todo, slot, mask = np.arange(len(h)), self.slots(h), np.uint64((1 << self.bits) - 1)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]  # of several for one slot the last stays
            mine = free & (self.keys[slot] == h[todo])
            self.at[slot[mine]] = new[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + np.uint64(1)) & mask

    def encode_simple(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of lower-case texts without OTHER, BATCH bytes in all; None of those with a piece over LONGEST bytes."""
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        start, stop = cut(raw)
        ends = np.cumsum([len(t) + 1 for t in texts])
        long = stop - start > LONGEST
        odd = np.unique(np.searchsorted(ends, start[long], side="right")).tolist()
        start, stop = start[~long], stop[~long]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * self.powers[0][: len(raw)], out=sums[1:])
        h = (sums[stop] - sums[start]) * self.powers[1][start] | np.uint64(1)
        if self.n > self.most:
            self.forget()
        at = self.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, k = np.unique(h[new], return_index=True)
            k = new[k]
            data = raw.tobytes()
            self.keep(keys, [data[a:b].decode() for a, b in zip(start[k].tolist(), stop[k].tolist())])
            at[new] = self.find(h[new])
        n = self.count[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[at] - total[:-1], n) + np.arange(total[-1])]
        to = total[np.searchsorted(start, ends)].tolist()
        out = ids.tobytes()
        got: list[bytes | None] = [out[2 * a : 2 * b] for a, b in zip([0, *to[:-1]], to)]
        for k in odd:
            got[k] = None
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and the end id."""
        out: list = [None] * len(texts)
        held, simple, size = [], [], 0

        def flush() -> None:
            for k, ids in zip(held, self.encode_simple(simple) if simple else ()):
                out[k] = (self.direct(texts[k]) if ids is None else ids) + self.end
            held.clear()
            simple.clear()

        for k, t in enumerate(texts):
            low = t.lower()
            if OTHER.search(t) or any(x in low for x in self.special) or len(raw := low.encode()) >= BATCH:
                out[k] = self.direct(t) + self.end
                continue
            if size + len(raw) + 1 > BATCH:
                flush()
                size = 0
            held.append(k)
            simple.append(raw)
            size += len(raw) + 1
        flush()
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """This process's encoder, which later tasks use again."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _tokenized(path: str, end_id: int, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, pack = encoder(SparkFiles.get(os.path.basename(path)), end_id), zstandard.ZstdCompressor(level=1)
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, step):
                c = b.slice(i, step)
                ids = own.encode([t or "" for t in c.column(2).to_pylist()])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(range(rid, rid + n), pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())], schema=_TOKENS)
                rid += n

    return run


class Deal:
    """Which tokens of each source's queue go to which partition.

    In virtual time every source sends its weight until its queue is empty. Partition p ends at the time by which
    p + 1 equal parts of all tokens are sent; a source has then sent a whole number of tokens and is owed a fraction,
    which the next partition starts with.
    """

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, parts: int):
        self.tokens, self.weights, self.parts = tokens.astype(float), weights.astype(float), parts
        self.time = np.unique(np.concatenate([[0.0], self.tokens / self.weights]))
        self.sent = np.minimum(self.tokens[:, None], self.weights[:, None] * self.time).sum(axis=0)

    def owed(self, g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whole tokens, fraction) that source g has sent by the start of partition p."""
        t = np.interp(np.clip(p, 0, self.parts) * (self.sent[-1] / self.parts), self.sent, self.time)
        x = np.where(p >= self.parts, self.tokens[g], np.minimum(self.tokens[g], self.weights[g] * t))
        whole = np.floor(x)
        return whole.astype(np.int64), x - whole

    def cut(self, g: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, partition, start, length, fraction owed) for rows of n tokens at place ``at`` of their queue."""
        guess = lambda x: np.floor(np.interp(x / self.weights[g], self.time, self.sent) * (self.parts / self.sent[-1])).astype(np.int64)
        lo, hi = np.maximum(guess(at) - 1, 0), np.minimum(guess(at + n) + 1, self.parts - 1)
        k = hi - lo + 1
        row = np.repeat(np.arange(len(g)), k)
        p = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        (a, owed), (b, _) = self.owed(g[row], p), self.owed(g[row], p + 1)
        start, stop = np.maximum(a, at[row]), np.minimum(b, (at + n)[row])
        keep = stop > start
        return tuple(x[keep] for x in (row, p, start - at[row], stop - start, owed))


def drr(queues: Mapping[int, deque], weights: Mapping[int, float], deficits: dict[int, float], window: int, segment: int) -> list[tuple[int, int, int, int, int]]:
    """(rid, start, length, sequence, offset) from queues of [rid, start, length], which are used up.

    At the start of a window every waiting source earns its share of the window; in turn, each sends segments of at
    most ``segment`` tokens while its deficit covers them; what room is left goes to the largest deficits, which may
    fall below 0. Deficits carry over to the next window. The end is cut into powers of two, so nothing is padded.
    """
    left = sum(x[2] for q in queues.values() for x in q)
    caps = [window] * (left // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (left % window) >> b & 1]
    out: list[tuple[int, int, int, int, int]] = []
    active, first = [g for g in queues if queues[g]], 0
    for seq, cap in enumerate(caps):
        used, total = 0, sum(weights[g] for g in active)
        for g in active:
            deficits[g] += cap * weights[g] / total

        def send(g: int) -> None:
            nonlocal used
            head = queues[g][0]
            n = min(head[2], segment, cap - used)
            if out and out[-1][3] == seq and out[-1][0] == head[0] and out[-1][1] + out[-1][2] == head[1]:
                r, s, m, _, o = out[-1]
                out[-1] = (r, s, m + n, seq, o)
            else:
                out.append((head[0], head[1], n, seq, used))
            used += n
            deficits[g] -= n
            head[1] += n
            head[2] -= n
            if not head[2]:
                queues[g].popleft()

        for k in range(len(active)):
            g = active[(first + k) % len(active)]
            while queues[g] and used < cap and min(queues[g][0][2], segment) <= deficits[g]:
                send(g)
        first += 1
        while used < cap:
            send(max((g for g in active if queues[g]), key=lambda g: (deficits[g], -g)))
        active = [g for g in active if queues[g]]
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, segment: int = 512, windows: int = 256, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every window follows the target proportions of tokens by source: ``weights``, or the sources' own shares, by which
    all queues end together. Queues stand in hash order and are dealt to partitions of about ``windows`` windows in
    closed form (``Deal``); in each, deficit round-robin fills the windows (``drr``), starting with the fractions that
    its sources are owed. A partition's last, partial window becomes full sequences of powers of two. Sources without
    a weight get weight 1. The driver and tasks see a few numbers for each source. The tokenizer's file goes to executors with the session's files.

    Null and empty texts are the end id alone. Null sources form one source. Rows that repeat another, or have no
    doc_id, are packed separately. No rows: no rows. Very long texts are cut over windows and partitions.
    """
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(tokenizer)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    tokens = checkpoint(spread(d).mapInArrow(tidy(_tokenized(tokenizer, end_id)), "doc_id long, source string, rid long, n long, ids binary"))
    stats = tokens.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # a row a source
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, r.source is None, r.source or "") for i, r in enumerate(stats)], "gi int, __null boolean, __source string")
    total = sum(r.n for r in stats)
    parts = max(1, round(total / (window * windows)))
    target = np.array([float(r.n) if weights is None else float(weights.get(r.source, 1)) for r in stats])
    deal = Deal(np.array([r.n for r in stats]), target, parts) if stats else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, gi, n, at = (x.to_numpy() for x in b.columns)
            row, p, start, length, owed = deal.cut(gi, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, rid[row], gi[row], at[row] + start, start, length, owed)], names=["p", "rid", "gi", "at", "start", "length", "owed"])

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        queues: dict[int, deque] = {}
        deficits: dict[int, float] = {}
        for gi, rid, start, length, owed in rows.sort_values(["gi", "at"])[["gi", "rid", "start", "length", "owed"]].itertuples(index=False, name=None):
            queues.setdefault(gi, deque()).append([rid, start, length])
            deficits.setdefault(gi, owed)
        out = drr(queues, {g: target[g] for g in queues}, deficits, window, segment)
        made = pd.DataFrame(out, columns=["rid", "start", "length", "sequence_id", "offset"])
        made["sequence_id"] += int(key[0]) << 24
        return made

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, n, ids, got in zip(*(x.to_pylist() for x in b.columns)):
                raw = memoryview(np.frombuffer(unpack.decompress(ids), dtype="<u2").astype("<u4")).cast("B")
                for x in got:
                    s, m = x["start"], x["length"]
                    for c, v in zip(cols, (doc_id, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n, x["sequence_id"], x["offset"])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    meta = tokens.select(F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), "rid", "n")
    meta = meta.join(broadcast_few(names, len(stats)), ["__null", "__source"]).select("rid", "gi", "n", mixed_hash("rid").alias("h"))
    meta = checkpoint(meta)
    placed = prefix_sums(meta, "gi", "h", [F.col("rid")], "n", "at", sum(r.rows for r in stats)).select("rid", "gi", "n", "at")
    cuts = placed.mapInArrow(tidy(cut), "p long, rid long, gi int, at long, start long, length long, owed double")
    pieces = cuts.groupBy("p").applyInPandas(fill, "rid long, start long, length long, sequence_id long, offset long")
    by_doc = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    found = tokens.select("rid", "doc_id", "n", "ids").join(by_doc, "rid").select("doc_id", "n", "ids", "pieces")
    return found.mapInArrow(tidy(crcs), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def word_tokenizer() -> str:
    """The file of the public word vocabulary, where its package is installed or lies in /opt/tokenizers."""
    try:
        import public_tokenizers
    except ImportError:
        return "/opt/tokenizers/word_bpe_49k.json"
    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())
