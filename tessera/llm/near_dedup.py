"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Store, spread, table, tidy
from tessera.shipping import ship

#: Counters of the document-frequency sketch, and of one row that carries part of it.
SLOTS, PART = 1 << 22, 1 << 12
#: Shingles of at most this share of all texts weigh 1, the most.
RARE = 1e-3
#: Weights of inverse document frequency are kept in steps of 1 / STEPS.
STEPS = 200
#: Bytes of a text that are hashed at a time.
SEGMENT = 1 << 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MUL = np.random.default_rng(3).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(4).integers(1, 1 << 63, size=256, dtype=np.uint64)
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or chr(b) == "_" for b in range(256)], dtype=np.int8)
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS:
        base = int(_MUL[40])
        for x in (base, pow(base, -1, 1 << 64)):
            out = np.full(SEGMENT + 1, x, dtype=np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text: runs of ASCII letters and digits, _ and all characters beyond ASCII, in lower case.

    A word's hash is a sum of its bytes' numbers times powers, got from running sums, and divided by the power where
    the word begins. A word of over SEGMENT bytes counts as several.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    up, down = powers()
    out, at = [], 0
    while at < len(raw):
        part = raw[at : at + SEGMENT]
        if len(part) == SEGMENT and at + SEGMENT < len(raw) and len(gaps := np.flatnonzero(_IN_WORD[part] == 0)):
            part = part[: gaps[-1] + 1]
        at += len(part)
        edges = np.diff(_IN_WORD[part], prepend=np.int8(0), append=np.int8(0))
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        out.append((sums[stop] - sums[start]) * down[start])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the distinct shingles of ``size`` words; fewer words are one shingle, no words none."""
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    k = min(size, len(words))
    x = np.full(len(words) - k + 1, len(words) if k < size else size, dtype=np.uint64)
    for i in range(k):
        x += words[i : len(words) - k + 1 + i] * _MUL[i]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return np.unique(x, return_counts=True)


def node_of(text: str | None, words: np.ndarray) -> bytes:
    """Digest of the sequence of words, or of the text if it has none."""
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"\0" + (text or "").encode("utf-8", "surrogatepass"))


def slot_counts(size: int):
    """(part, counts): how many texts have a shingle in each slot, as compressed parts of PART counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total, held, n, docs = np.zeros(SLOTS, dtype=np.int32), [], 0, 0

        def add() -> None:
            np.add(total, np.bincount(np.concatenate(held).astype(np.int64), minlength=SLOTS), out=total, casting="same_kind")

        for b in batches:
            for text in b.column(0):
                x, _ = shingles(word_hashes(text.as_py()), size)
                held.append(x & np.uint64(SLOTS - 1))
                n, docs = n + len(x), docs + 1
                if n > 1 << 20:
                    add()
                    held, n = [], 0
        if held:
            add()
        pack, parts = zstandard.ZstdCompressor(level=1), total.reshape(-1, PART)
        some = np.flatnonzero(parts.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int32()), pa.array([*(pack.compress(parts[i].astype(np.int64).tobytes()) for i in some), pack.compress(np.int64(docs).tobytes())], pa.binary())], names=["part", "counts"])

    return run


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts that one task gets."""
    import zstandard

    unpack, pack, sums = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(unpack.decompress(counts.as_py()), dtype=np.int64)
            sums[part] = sums[part] + x if part in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack.compress(x.tobytes()) for x in sums.values()], pa.binary())], names=["part", "counts"])


def least_weight(least: float, guard: float) -> float:
    """The weight of a shingle that all texts have, such that two texts of counted Jaccard similarity ``guard`` have a weighted one of ``least`` at least, however frequent what they share is."""
    return least / (1 - least) * (1 - guard) / guard


def idf_steps(counts: np.ndarray, n: int, floor: float) -> np.ndarray:
    """Steps of the weight by slot, from how many of n texts have a shingle in each.

    The weight is floor + (1 - floor) x with x = ln(n / df) / ln(1 / RARE), and 1 at the share RARE of all texts and
    below. It depends on the share df / n alone, so a corpus twice as large of the same kind gives the same weights. What
    other shingles add to a slot is taken off as the median slot has it, and varies with a deviation of at most
    n sqrt(RARE x distinct shingles a text / SLOTS): at 300 of them 0.27 of RARE, at any n, 0.01 of the weight.
    """
    df = np.clip(counts - np.median(counts), 1, max(1, n))
    x = np.clip(np.log(max(1, n) / df) / np.log(1 / RARE), 0, 1)
    return np.clip(np.rint((floor + (1 - floor) * x) * STEPS), 1, 255).astype(np.uint8)


def idf_table(docs: DataFrame, size: int, floor: float | None = None) -> np.ndarray:
    """Steps of the weight of inverse document frequency by slot (``idf_steps``), over all rows of docs; floor: ``least_weight`` of 0.8 and 0.85 by default.

    Document frequencies are counted in SLOTS counters, so what is sent to the driver and broadcast has a fixed size (4 MB).
    """
    import zstandard

    ship(docs.sparkSession)
    parts = spread(docs.select("text")).mapInArrow(tidy(slot_counts(size)), "part int, counts binary")
    sums = parts.repartition("part").mapInArrow(tidy(add_counts), "part int, counts binary")
    unpack, df, n = zstandard.ZstdDecompressor(), np.zeros((SLOTS // PART, PART), dtype=np.int64), 0
    for r in sums.collect():  # at most SLOTS / PART rows
        x = np.frombuffer(unpack.decompress(bytes(r.counts)), dtype=np.int64)
        if r.part < 0:
            n = int(x[0])
        else:
            df[r.part] = x
    return idf_steps(df.ravel(), n, least_weight(0.8, 0.85) if floor is None else floor)


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010) with ``k`` samples.

    Each (shingle, sample) draws r and c from Gamma(2, 1) and beta from 0 to 1 by its hash: r and c from a table of
    2**16 seeded pairs, beta from other bits. Weights enter by sums of tabled logarithms, so equal shingles of equal
    weight draw the same in every text.
    """

    def __init__(self, k: int, idf: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.k, self.idf = k, idf
        r, c = (rng.gamma(2, 1, 1 << 16) for _ in range(2))
        self.r, self.inverse, self.log_c = r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32)
        self.part, self.least = (r * 2.0**-16).astype(np.float32), (np.log(c) - r).astype(np.float32)
        self.a = rng.integers(1, 1 << 63, size=(k, 1), dtype=np.uint64) | np.uint64(1)
        self.log_idf = np.log(np.maximum(1, np.arange(256)) / STEPS).astype(np.float32)
        self.log_tf = np.log(np.maximum(1, np.arange(1 << 12))).astype(np.float32)

    def weights(self, x: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[x & np.uint64(SLOTS - 1)].astype(np.float64)

    def sample(self, x: np.ndarray, tf: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """k 64-bit samples; two texts agree in each with the probability of their weighted Jaccard similarity."""
        log_tf = self.log_tf[tf] if tf.max() < len(self.log_tf) else np.log(tf).astype(np.float32)
        log_s = self.log_idf[self.idf[x & np.uint64(SLOTS - 1)]] + log_tf
        plain = log_s == 0
        if plain.all():
            return self._least(x, None, most)[0]
        if not plain.any():
            return self._least(x, log_s, most)[0]
        (one, low), (more, least) = self._least(x[plain], None, most), self._least(x[~plain], log_s[~plain], most)
        return np.where(least < low, more, one)

    def _least(self, x: np.ndarray, log_s: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(samples, their values) of shingles of weight exp(log_s); None: all of weight 1, for which t is 0."""
        out, low, step = np.empty(self.k, dtype=np.uint64), np.empty(self.k, dtype=np.float32), max(1, most // len(x))
        for i in range(0, self.k, step):
            h = (x * self.a[i : i + step]).view(np.uint16).reshape(-1, len(x), 4)  # the low bits first
            at = h[:, :, 3].astype(np.intp)
            y = h[:, :, 2].astype(np.float32)
            if log_s is None:
                y *= self.part.take(at)
                y += self.least.take(at)  # ln c - r (1 - beta)
            else:
                y *= np.float32(2.0**-16)  # beta
                t = self.inverse.take(at)
                t *= log_s
                t += y
                np.floor(t, out=t)
                y -= t
                y -= np.float32(1)
                y *= self.r.take(at)
                y += self.log_c.take(at)  # ln c - r (t - beta + 1)
            j, rows = np.argmin(y, axis=1), np.arange(len(y))
            low[i : i + step] = y[rows, j]
            out[i : i + step] = x[j] * _MUL[9] if log_s is None else (x[j] ^ t[rows, j].astype(np.int64).view(np.uint64) * _MUL[8]) * _MUL[9]
        return out, low


def similarity(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Weighted Jaccard: the sum of smaller weights over the sum of larger ones."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(wx[i], wy[j]).sum()
    whole = wx.sum() + wy.sum() - both
    return float(both / whole) if whole else 0.0


def components(edges: DataFrame, store: Store, most: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b).

    In a turn each node takes the smallest label of its neighbours and then that label's own label, so long chains
    shorten by half.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    for turn in range(most):
        heard = both.join(labels.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        all_ = heard.unionByName(labels.select("node", "label", F.col("label").alias("old")))
        near = all_.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        ends = near.select(F.col("node").alias("label"), F.col("label").alias("end"))
        new, seen = near.join(ends, "label").select("node", "old", F.least("label", "end").alias("label")), Observation()
        new = store.keep(new.observe(seen, F.coalesce(F.sum((F.col("label") != F.col("old")).cast("long")), F.lit(0)).alias("changed")))
        if turn:
            store.drop(labels)
        labels = new
        if not seen.get["changed"]:
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most} turns")


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with their label; those that no link has are their own."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def leaders(pool: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of a bucket of several labels with the bucket's first node, in turn 0 the smallest; in later turns with the first and the last of an order of its own for each bucket and turn. pool: node, band, label."""
    mask = F.xxhash64("band", F.lit(turn)) if turn else F.lit(0).cast("long")  # xor with it orders nodes anew
    key = F.col("node").bitwiseXOR(mask)
    ends = pool.groupBy("band").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    leads = F.array(F.col("lo").bitwiseXOR(mask), F.col("hi").bitwiseXOR(mask)) if turn else F.array("lo")
    led = pool.select("node", "band").join(ends.select("band", leads.alias("leads")), "band")
    return led.select(F.col("node").alias("a"), F.explode("leads").alias("b")).where("a <> b").distinct()


def agreeing(pairs: DataFrame, info: DataFrame, share: float) -> DataFrame:
    """(a, b, n) of the pairs with different labels of which n samples agree, at least ``share`` of them. info: node, label, samples."""
    of = lambda c: info.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("samples").alias(f"samples_{c}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b")
    agree = F.size(F.filter(F.zip_with("samples_a", "samples_b", lambda x, y: x == y), lambda v: v))
    return full.select("a", "b", agree.alias("n")).where(F.col("n") >= share * F.size("samples_a"))


def verified(pairs: DataFrame, texts: DataFrame, idf, size: int, least: float, each: int = 64) -> DataFrame:
    """Of pairs (a, b) those whose weighted Jaccard similarity is at least ``least``.

    The partners a of a node b are dealt to cells of about ``each``, to which b's text goes as well, so a node of any
    number of partners spreads over tasks. A task streams its sorted cells: b first, then the partners.
    """
    n = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / each).alias("cells"))
    p = pairs.join(n, "b").select("a", "b", F.pmod(F.xxhash64("a"), "cells").cast("int").alias("cell"))
    rows = p.select(F.col("a").alias("node"), "b", "cell", F.lit(1).alias("role")).unionByName(p.select(F.col("b").alias("node"), "b", "cell", F.lit(0).alias("role")).distinct())
    rows = rows.join(texts, "node").select("b", "cell", "role", "node", "text").repartition("b", "cell").sortWithinPartitions("b", "cell", "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, lead, at = Sampler(1, np.frombuffer(idf.value, dtype=np.uint8)), (), None
        for batch in batches:
            good = []
            for b, cell, role, text in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(4)):
                if role == 0 and at == (b, cell):  # a row that repeats b's
                    good.append(False)
                    continue
                x, tf = shingles(word_hashes(text.as_py()), size)
                w = sampler.weights(x, tf)
                if role == 0:
                    lead, at = (x, w), (b, cell)
                good.append(role == 1 and at == (b, cell) and similarity(x, w, *lead) >= least)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(mask), batch.column(0).filter(mask)], names=["a", "b"])

    return rows.mapInArrow(tidy(check), "a long, b long")


def texts_of(d: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """(node, text) of wanted nodes (node, first_id, th), from a row that stands for each; repeats: rows may repeat a doc_id and text."""
    used = wanted.select("node", F.col("first_id").alias("__id"), F.col("first_th").alias("th"))
    found = d.select(F.coalesce("doc_id", F.lit(_LAST)).alias("__id"), "th", "text").join(used.hint("shuffle_hash"), ["__id", "th"]).select("node", "text")
    return found.groupBy("node").agg(F.first("text").alias("text")) if repeats else found


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (band, i, j) of one sorted partition."""
    key, held = None, []
    for b in batches:
        keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("band", "i", "j")], axis=1).astype(np.int64)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
        for start, stop in zip(starts, [*starts[1:], len(keys)]):
            if held and key != keys[start].tolist():
                yield pa.Table.from_batches(held)
                held = []
            key = keys[start].tolist()
            held.append(b.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def meetings(t: pa.Table, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, n, labels) of one cell: the rows of different label of which this is the first common bucket and n samples agree, at least ``share`` of them, most first; numbers of the rows' labels."""
    of = lambda c: t.column(c).combine_chunks()
    i, j, k, own = (of(c).to_numpy() for c in ("i", "j", "k", "own"))
    samples, keys = (of(c).flatten().to_numpy().reshape(len(own), -1) for c in ("samples", "bands"))
    labels = of("label").dictionary_encode().indices.to_numpy()
    left, right, found = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]), []
    for at in range(0, len(left), 64):
        l = left[at : at + 64]  # noqa: E741
        agree = (samples[l, None] == samples[None, right]).sum(axis=2)
        ok = (agree >= share * samples.shape[1]) & (labels[l, None] != labels[None, right])
        if i[0] == j[0]:
            ok &= l[:, None] < right[None]
        x, y = np.nonzero(ok)
        first = (keys[l[x]] == keys[right[y]]).argmax(axis=1) == k[0]
        found.append((l[x][first], right[y][first], agree[x, y][first]))
    p, q, n = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, dtype=np.int64) for c in range(3))
    order = np.argsort(-n, kind="stable")
    return p[order], q[order], n[order], labels


def all_links(pool: DataFrame, info: DataFrame, texts: DataFrame, store: Store, idf, size: int, least: float, share: float, block: int = 512) -> DataFrame:
    """(a, b): links that connect all nodes of different labels that share a bucket and are similar by at least ``least``.

    The nodes of a bucket are dealt by hash to blocks of about ``block``, and each two blocks meet in a cell of their
    own, so a bucket of any size spreads over tasks. Pairs meet in the first bucket they share. In a cell those whose
    samples agree most are verified first, and those that links of the cell connect by then are left out. Buckets of
    up to three nodes have met by their leaders. Texts go only to cells in which they have partners.
    """
    n = pool.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high and n > 3")
    mixed = pool.join(n.select("band", F.ceil(F.col("n") / block).cast("int").alias("m")), "band")
    rows = mixed.join(info.select("node", "bands", "samples"), "node").withColumn("own", F.pmod(F.xxhash64("node", "band"), "m").cast("int"))
    k = (F.array_position("bands", F.col("band")) - 1).cast("int").alias("k")
    rows = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"), "own", k, "node", "label", "bands", "samples")
    rows = rows.select("band", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "k", "node", "label", "bands", "samples")
    schema = "band long, i int, j int, own int, k int, node long, label long, bands array<long>, samples array<int>"
    gathered = lambda df: df.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells(batches):
            p, q, _, _ = meetings(t, share)
            if len(p):
                yield from t.take(pa.array(np.union1d(p, q))).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(1, np.frombuffer(idf.value, dtype=np.uint8))
        for t in cells(batches):
            p, q, _, labels = meetings(t, share)
            par, sets, text, node, good = list(range(int(labels.max()) + 1)), {}, t.column("text"), t.column("node"), []

            def find(x: int) -> int:
                while par[x] != x:
                    par[x] = x = par[par[x]]  # noqa: B023
                return x

            def weighed(r: int) -> tuple[np.ndarray, np.ndarray]:
                if r not in sets:  # noqa: B023
                    x, tf = shingles(word_hashes(text[r].as_py()), size)  # noqa: B023
                    sets[r] = x, sampler.weights(x, tf)  # noqa: B023
                return sets[r]  # noqa: B023

            for a, b in zip(p.tolist(), q.tolist()):
                x, y = find(int(labels[a])), find(int(labels[b]))
                if x != y and similarity(*weighed(a), *weighed(b)) >= least:
                    par[x] = y
                    good.append((node[a].as_py(), node[b].as_py()))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in good], pa.int64()) for c in range(2)], names=["a", "b"])

    met = store.keep(gathered(rows).mapInArrow(tidy(partnered), schema))
    full = met.join(texts, "node").select(*met.columns, "text")
    return gathered(full).mapInArrow(tidy(link), "a long, b long")


#: Stands for a null doc_id where the smallest is looked for.
_LAST = 2**63 - 1


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5, bands: int = 14, rows: int = 3, turns: int = 2, share: float = 0.5, guard: float = 0.85) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of its class), n_texts, kept, text_hash (xxhash64).

    Texts are multisets of shingles of ``size`` words (``word_hashes``), weighed by count times inverse document
    frequency (``idf_steps``; ``guard``: see ``least_weight``). Texts of equal words are one node from the start. ``bands`` bands of ``rows`` consistent weighted samples name buckets: at similarity 0.8 a pair shares one with probability 0.99996.
    In a bucket each node first meets the smallest one; of these pairs, each node's with the most samples in common is
    verified by weighted Jaccard similarity. In each later turn, up to ``turns`` in all, the nodes of buckets that still hold
    several components meet two leaders of another order. Pairs with fewer than ``share`` of their samples in common are
    dropped (of those at similarity 0.8, 3e-06). The turns only save work: in buckets whose nodes then still have
    different labels, all pairs of different label meet (``all_links``), with no cap. Classes are connected components.
    n_texts is the number of different texts (by words) in the class; kept says that the row has the class's smallest doc_id.

    Null and empty texts, and texts without words, are near only to equal texts; a text of fewer words than ``size`` is
    one shingle. A class of null doc_ids alone has a null class_id and keeps them all. Rows that repeat a doc_id and
    text are kept or not together. No rows: no rows. Other columns are not read. A very long text is hashed in segments;
    a task holds its words and shingles, and one batch. Buckets of one node are dropped before anything else; the others are summed
    up before they are shuffled, and no bucket is gathered. Steps are tables in the shared folder (``Store``), dropped as
    soon as no later step reads them; the last three stay with the result.
    """
    spark = docs.sparkSession
    store = Store(spark, "near")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    idf = spark.sparkContext.broadcast(idf_table(d, size, least_weight(least, max(least, guard))).tobytes())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows, np.frombuffer(idf.value, dtype=np.uint8))
        salt = _MUL[16 : 16 + bands]
        for b in batches:
            digests, keys, samples = [], [], []
            for text in b.column(1):
                t = text.as_py()
                words = word_hashes(t)
                digests.append(node_of(t, words))
                if not len(words):
                    keys.append([])
                    samples.append([])
                    continue
                s = sampler.sample(*shingles(words, size)).reshape(bands, rows)
                samples.append((s.ravel() >> np.uint64(32)).astype(np.uint32).view(np.int32))
                key = salt.copy()
                for r in range(rows):
                    key = (key ^ s[:, r]) * _MIX
                    key ^= key >> np.uint64(30)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(samples, pa.list_(pa.int32()))], names=["doc_id", "th", "digest", "bands", "samples"])

    signed = store.keep(spread(d).mapInArrow(tidy(sign), "doc_id long, th long, digest binary, bands array<long>, samples array<int>"))
    # A class's smallest doc_id and the text of a row that has it stand for equal texts; node is a number of their own.
    one = signed.groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "th")).alias("rep"), F.first(F.struct("bands", "samples")).alias("x"))
    nodes = store.keep(one.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("rep.id").alias("first_id"), F.col("rep.th").alias("first_th"), "x.bands", "x.samples"))
    repeats = not signed.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    inside = nodes.select("node", F.explode("bands").alias("band"))
    shared = inside.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band")
    live = store.keep(inside.join(shared, "band").select("node", "band"))
    info = store.keep(nodes.join(live.select("node").distinct(), "node", "left_semi").drop("digest"))
    texts = store.keep(texts_of(d, info, repeats))
    own = info.withColumn("label", F.col("node"))
    pairs = store.keep(agreeing(leaders(live.withColumn("label", F.col("node")), 0), own, share))
    best = pairs.groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", "x.b")
    edges = store.keep(verified(best, texts, idf, size, least))
    labels = components(edges, store)
    for turn in range(1, turns):
        here = store.keep(labelled(info.select("node", "samples"), labels))
        again = leaders(live.join(here.select("node", "label"), "node"), turn)
        again = agreeing(again.unionByName(pairs.select("a", "b")).distinct() if turn == 1 else again, here, share).select("a", "b")
        again = store.keep(again)
        edges = edges.unionByName(store.keep(verified(again, texts, idf, size, least)))
        store.drop(here, again)
        labels = components(edges, store)
    pool = store.keep(labelled(live, labels))
    more = store.keep(all_links(pool, info, texts, store, idf, size, least, share))
    if not more.isEmpty():
        labels = components(edges.unionByName(more), store)
    # Nodes without a link are classes of their own.
    ids = labels.join(nodes.select("node", F.nullif("first_id", F.lit(_LAST)).alias("first_id")), "node")
    classes = ids.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    members = store.keep(labels.join(classes, "label").select("node", "class_id", "n_texts"))
    store.drop_others(signed, nodes, members)
    known = nodes.select("node", "digest", "first_id").join(members, "node", "left")
    class_id = F.when(F.col("n_texts").isNull(), F.nullif("first_id", F.lit(_LAST))).otherwise(F.col("class_id"))
    known = known.select("digest", class_id.alias("class_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))
    out = signed.select("doc_id", "th", "digest").join(known, "digest")
    return out.select("doc_id", "class_id", "n_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("th").alias("text_hash"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
