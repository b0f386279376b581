import hashlib
import re
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import pytest

from tessera.llm.mix import _rng, hypergeometric, leaf, mix, mixed_documents, op1_mix, permuted, targets_of
from tessera.llm.packing import Deal, Encoder, drr, pack, word_tokenizer
from tests.llm.conftest import EDGE, frame, words

ROWS = [(i, words(5 + i % 40, i), "abc"[i % 3] if i % 5 else "d") for i in range(300)]


def size(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def check_mix(rows, m):
    docs, taken = m.docs.collect(), defaultdict(int)
    for r in m.pieces.collect():
        taken[r.gi, r["at"]] += r.taken
    by, want = defaultdict(int), {}
    for r in docs:
        t = taken[r.gi, r["at"]] if r["size"] else 0
        assert 0 <= t <= 2 * r["size"]
        by[r.gi] += t
        want[r.gi] = r.target
    assert all(abs(by[g] - want[g]) <= 0.5 for g in by)
    assert Counter(r.doc_id for r in docs) == Counter(i for i, _, _ in rows)
    return docs


def test_mix_targets(spark):
    docs = check_mix(ROWS, mix(frame(spark, ROWS).repartition(4), shard_blocks=2))
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += size(t)
    names = sorted(sizes)
    want = targets_of([sizes[s] for s in names], [3, 1, 2, 3], 1.5 * sum(sizes.values()), 2)
    assert {(r.source_size, r.target) for r in docs} == {(sizes[s], t) for s, t in zip(names, want)}
    assert sum(want) == pytest.approx(1.5 * sum(sizes.values()))


def tree(quotas, shards, seed):
    """The whole splitting tree, node by node from the root: what each shard gets of each source."""
    total, out = int(quotas.sum()), {}

    def node(lo, hi, counts):
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        left = hypergeometric(_rng(seed, lo, hi), counts, total * mid // shards - total * lo // shards)
        node(lo, mid, left)
        node(mid, hi, counts - left)

    node(0, shards, quotas)
    return [out[s] for s in range(shards)]


@pytest.mark.parametrize("block, shard_blocks", [(40, 3), (200, 2)])
def test_mix_equals_one_by_one(spark, block, shard_blocks):
    got = {(r.doc_id, r.epoch): (r.taken, r.shard) for r in mix(frame(spark, ROWS).repartition(4), shard_blocks=shard_blocks, block=block).pieces.collect()}
    names = sorted({r[2] for r in ROWS})
    of = {s: sorted(((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, size(t)) for i, t, x in ROWS if x == s)) for s in names}
    z = [sum(r[2] for r in of[s]) for s in names]
    want = [min(2 * a, round(t)) for a, t in zip(z, targets_of(z, [3, 1, 2, 3], 1.5 * sum(z), 2.0))]
    drawn = []  # by source: the (epoch, block) of each draw
    for g, s in enumerate(names):
        n, order = -(-z[g] // block), []
        for e in range(-(-want[g] // z[g])):
            to = permuted(np.arange(n), n, 12 + g * 64 + e).tolist()
            order += [(e, to.index(k)) for k in range(n)]
        drawn.append(order)
    expect, quotas, owner = {}, [], []
    for g, s in enumerate(names):
        left, places, draws = want[g], defaultdict(list), 0
        at = 0
        for _, i, n in of[s]:
            places[at // block].append((i, n))
            at += n
        for k, (e, b) in enumerate(drawn[g]):
            for i, n in places[b]:
                if left > 0:
                    expect[i, e] = min(n, left), (g, k)
                    left -= min(n, left)
                    draws = k + 1
        quotas.append(draws)
        assert left == 0
    shards = -(-sum(quotas) // shard_blocks)
    first = [0] * len(names)
    for s, counts in enumerate(tree(np.array(quotas), shards, 11)):
        for g, n in enumerate(counts):
            owner += [((g, k), s) for k in range(first[g], first[g] + n)]
            first[g] += int(n)
    owner = dict(owner)
    assert shards > 3 and got == {k: (n, owner[d]) for k, (n, d) in expect.items()}


def test_mixed_rows_keep_their_source(spark):
    """The same doc_id and text in two sources: each draw comes out as a row of the source that it was drawn from."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), *((10 + i, words(4, i), "xy"[i % 2]) for i in range(6))]
    docs = frame(spark, rows)
    drawn = Counter(r.gi for r in mix(docs).pieces.collect())
    assert Counter("xy".index(r.source) for r in mixed_documents(docs).collect()) == drawn
    taken = defaultdict(int)
    for r in mix(docs).pieces.collect():
        taken[r.gi] += r.taken
    out = defaultdict(int)
    for r in mixed_documents(docs).collect():
        out["xy".index(r.source)] += size(r.text)
    assert out == taken


def test_mix_edges(edge, empty, tmp_path, spark):
    check_mix(EDGE, mix(edge))
    assert mix(empty).docs.collect() == []
    assert mixed_documents(empty).collect() == []
    frame(spark, EDGE).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = (Counter(op1_mix(spark, str(tmp_path)).collect()) for _ in range(2))
    assert a == b and sum(a.values()) == len(EDGE)


def test_mixed_documents(spark):
    got = mixed_documents(frame(spark, ROWS)).collect()
    text = {i: t for i, t, _ in ROWS}
    m = mix(frame(spark, ROWS))
    assert sum(size(r.text) for r in got) == sum(r.taken for r in m.pieces.collect())
    assert all(text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)


def test_splitting_tree_is_exact():
    quotas = np.array([100, 7, 0, 893])
    parts = [leaf(quotas, 13, s, 5) for s in range(13)]
    assert (sum(n for _, n in parts) == quotas).all()
    for g in range(4):
        at = 0
        for first, n in parts:
            assert first[g] == at
            at += n[g]
    assert {int(n.sum()) for _, n in parts} <= {76, 77}
    big = np.array([3 * 10**9, 10**9])
    assert hypergeometric(np.random.default_rng(1), big, 10**9).sum() == 10**9


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def check_packing(rows, got, window=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    ids = defaultdict(list)
    for i, x, _ in rows:
        ids[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for v in docs.values():
        copies = sum(r.start == 0 for r in v)
        assert sum(r.length for r in v) == copies * v[0].doc_tokens
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    return seqs


def test_packing(spark):
    rows = [(i, words(200 + i % 400, i), "abc"[i % 3]) for i in range(120)]
    got = pack(frame(spark, rows).repartition(3), word_tokenizer(), windows=4).collect()
    check_packing(rows, got)
    source = {i: s for i, _, s in rows}
    total = Counter()
    for r in got:
        total[source[r.doc_id]] += r.length
    part = Counter()
    first = [r for r in got if r.sequence_id >> 24 == 1]
    for r in first:
        part[source[r.doc_id]] += r.length
    n, whole = sum(part.values()), sum(total.values())
    assert all(abs(part[s] - n * total[s] / whole) <= 1.5 for s in total)  # partitions follow the sources' shares


def test_packing_edges(edge, empty, spark):
    check_packing(EDGE, pack(edge, word_tokenizer(), window=512, windows=2).collect(), 512)
    assert pack(empty, word_tokenizer()).collect() == []
    weighted = pack(edge, word_tokenizer(), weights={"a": 5.0, "c": 1.0}).collect()
    check_packing(EDGE, weighted)


def test_windows_follow_target():
    from collections import deque

    queues = {0: deque([[k, 0, 700] for k in range(60)]), 1: deque([[100 + k, 0, 300] for k in range(70)])}
    out = drr(queues, {0: 2.0, 1: 1.0}, {0: 0.0, 1: 0.0}, 1024, 64)
    sent = 0
    for w in range(15):
        sent += sum(n for r, _, n, s, _ in out if s == w and r < 100)
        assert abs(sent - (w + 1) * 1024 * 2 / 3) <= 128  # deficits carry over


def test_deal_covers_every_token():
    deal = Deal(np.array([1000, 10, 3]), np.array([5.0, 1.0, 1.0]), 7)
    for g, n in enumerate((1000, 10, 3)):
        row, p, start, length, _ = deal.cut(np.array([g, g]), np.array([0, n // 2]), np.array([n // 2, n - n // 2]))
        spans = sorted(zip(row.tolist(), start.tolist(), length.tolist()))
        for k, m in ((0, n // 2), (1, n - n // 2)):
            at = 0
            for _, s, x in [v for v in spans if v[0] == k]:
                assert s == at
                at += x
            assert at == m


def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    e, t = Encoder(word_tokenizer(), 2), Tokenizer.from_file(word_tokenizer())
    texts = [x or "" for _, x, _ in EDGE] + ["It's 'S ''s !!'re 12a", "a\x1cb\x85c d", "<|StartOfText|> <|startoftext|>", "É é É"]
    for x, got in zip(texts, e.encode(texts)):
        assert got == np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u2").tobytes()


def round_robin(queues, weights, deficits, window, segment):
    """Deficit round-robin token by token: where each (rid, token) goes."""
    flat = {g: [(r, s + k, n - k) for r, s, n in q for k in range(n)] for g, q in queues.items()}  # with what is left of its piece
    total, out, seq, turn = sum(map(len, flat.values())), {}, 0, 0
    active = [g for g in flat if flat[g]]
    while total:
        cap = window if total >= window else 1 << (total.bit_length() - 1)
        room = cap
        for g in active:
            deficits[g] += cap * weights[g] / sum(weights[x] for x in active)

        def send(g):
            nonlocal room
            n = min(flat[g][0][2], segment, room)
            for r, k, _ in flat[g][:n]:
                out[r, k] = seq, cap - room  # noqa: B023
                room -= 1
            del flat[g][:n]
            deficits[g] -= n

        for g in active[turn % len(active) :] + active[: turn % len(active)]:
            while flat[g] and room and min(flat[g][0][2], segment) <= deficits[g]:
                send(g)
        while room:
            send(max((g for g in active if flat[g]), key=lambda g: (deficits[g], -g)))
        turn, seq, total = turn + 1, seq + 1, total - cap
        active = [g for g in active if flat[g]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_drr_equals_round_robin_by_token(seed):
    rng = np.random.default_rng(seed)
    queues = {g: [[100 * g + k, int(rng.integers(0, 5)), int(rng.integers(1, 90))] for k in range(int(rng.integers(1, 25)))] for g in range(4)}
    weights = {g: float(w) for g, w in enumerate(rng.integers(1, 6, 4))}
    owed = {g: float(x) for g, x in enumerate(rng.random(4))}
    want = round_robin(queues, weights, dict(owed), 64, 16)
    got = {}
    for rid, start, length, seq, offset in drr({g: deque([list(x) for x in q]) for g, q in queues.items()}, weights, dict(owed), 64, 16):
        got |= {(rid, start + k): (seq, offset + k) for k in range(length)}
    assert got == want


def test_deal_equals_sending_in_small_steps():
    """Sources that send their weight in small steps of time until they are empty; partitions end when a share of all tokens is sent."""
    tokens, weights, parts = np.array([500, 120, 77, 1]), np.array([3.0, 1.0, 2.0, 5.0]), 7
    deal, step = Deal(tokens, weights, parts), 1e-3
    sent, ends = np.zeros(4), [np.zeros(4)]
    while len(ends) < parts:
        sent = np.minimum(tokens, sent + weights * step)
        if sent.sum() >= tokens.sum() / parts * len(ends):
            ends.append(sent.copy())
    for p, want in enumerate([*ends, tokens.astype(float)]):
        whole, part = deal.owed(np.arange(4), np.full(4, p))
        assert whole + part == pytest.approx(want, abs=0.02)
    for g in range(4):  # a row that is the whole queue is cut where partitions end
        row, p, start, length, _ = deal.cut(np.array([g]), np.array([0]), tokens[g : g + 1])
        assert length.sum() == tokens[g] and (start[1:] == start[:-1] + length[:-1]).all() and (np.diff(p) > 0).all()
