import functools
import inspect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import chunk_dedup, near_dedup, url_trust
from tessera.llm.common import Store
from tests.llm.conftest import EDGE, frame, words


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))]
    rest = rest[len(host) :]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def rule(host, path):
    fits = []
    for verdict, r in url_trust.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "nothing", "HTTP://A.Example.NET/en/x?q#f", "https://example.net/en", "x://example.net/en/", "http://net/", "http://xnet/", "http://a.net", "http://a.net/", "a://b://c.org/fr/", "https://q.org/fr/1?x", "https://q.org#fr/", "http://é.example.com/de/é", "http://example.com/de/\nx", "http://bad.org/1", "http://good.org/1", "http://mid.org/1"]


def test_url_trust(spark):
    link = {"http://bad.org/1": '<a href="http://spam.net/x">', "http://mid.org/1": "<A class=x HREF='//bad.org/'> <a href=http://q.org/y>", "http://good.org/1": '<a href="/local"> <a href="https://good.org/2">'}
    rows = [(i, u, link.get(u, "<p>" if i % 2 else None), 1.0) for i, u in enumerate(URLS)] + [(99, "http://spam.net/x", "", 1.0)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, trust double")
    got = url_trust.url_verdicts(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows + rows[:3])
    for r in got:
        u = dict((i, u) for i, u, _, _ in rows)[r.page_id]
        assert (r.host, r.path) == host_path(u)
        want = rule(r.host, r.path)
        assert r.rule == want[0] and (want[1] is None or r.verdict == want[1])
    by = {r.host: r for r in got if r.host}
    assert by["bad.org"].verdict == "block"  # it links to a blocked host only
    assert by["good.org"].verdict == "allow" and by["good.org"].distrust == 0
    assert by["mid.org"].distrust > 0 and by["q.org"].trust > 0
    assert all(r.verdict == "allow" for r in got if not r.host)
    assert url_trust.url_verdicts(pages.where("false")).collect() == []


def rank_by_hand(edges, seed, hosts, steps=100, damping=0.8):
    """Personalised PageRank by plain steps, in units of a seed. Own links take their share, and walks end there."""
    out = defaultdict(int)
    for (a, _), n in edges.items():
        out[a] += n
    r = {h: seed.get(h, 0.0) for h in hosts}
    for _ in range(steps):
        new = {h: seed.get(h, 0.0) for h in hosts}
        for (a, b), n in edges.items():
            if a != b:
                new[b] += damping * r[a] * n / out[a]
        r = new
    return r


def test_spread_is_personalised_pagerank(spark):
    rng = random.Random(4)
    hosts = [f"h{i}" for i in range(14)]
    links = {(a, b): rng.randint(1, 4) for a in hosts[:12] for b in rng.sample(hosts, 3)}
    links |= {(h, h): rng.randint(1, 9) for h in hosts[:6]}
    trusted = {h: rng.random() for h in hosts[:4]}
    blocked = {h: rng.random() for h in [*hosts[7:], "alone"]}
    hosts.append("alone")
    seeds = spark.createDataFrame([(h, trusted.get(h, 0.0), blocked.get(h, 0.0)) for h in hosts], "host string, trusted double, blocked double")
    df = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_trust.spread(df, seeds, 12, 0.8).collect()}
    t, d = rank_by_hand(links, trusted, hosts), rank_by_hand({(b, a): n for (a, b), n in links.items()}, blocked, hosts)
    part = rank_by_hand(links, trusted, hosts, 12), rank_by_hand({(b, a): n for (a, b), n in links.items()}, blocked, hosts, 12)
    assert all(got.get(h, (0, 0)) == pytest.approx((part[0][h], part[1][h])) for h in hosts)
    left = 5 * 0.8**13 * sum(trusted.values()), 5 * 0.8**13 * sum(blocked.values())
    assert all(t[h] - part[0][h] <= left[0] and d[h] - part[1][h] <= left[1] for h in hosts)
    assert got["alone"][1] == pytest.approx(blocked["alone"])
    exact = {r.host: (r.trust, r.distrust) for r in url_trust.spread(df, seeds, 60, 0.8).collect()}
    assert all(exact.get(h, (0, 0)) == pytest.approx((t[h], d[h]), abs=1e-4) for h in hosts)


def test_host_edges(spark):
    html = """<base href='http://CDN.x.org/a'><a href="/local"><A href=other.html><a href='//B.net:80/x?y'><a href="mailto:a@b.c"><a
     href="https://r.com/go?x=1&url=https%3A%2F%2Ffar.org%2Fp"><a name=x><a href="javascript:void(0)">"""
    rows = [("www.a.x.org", html), ("www.a.x.org", None), ("x.org", "<a href=#top>"), ("10.0.0.1", '<a href="http://x.org">'), ("", "<a href=//no.org>"), ("single", "")]
    got = {(r.src, r.dst): r.n for r in url_trust.host_edges(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert got == {
        ("www.a.x.org", "cdn.x.org"): 2,
        ("www.a.x.org", "b.net:80"): 1,
        ("www.a.x.org", "r.com"): 1,
        ("www.a.x.org", "far.org"): 1,
        ("www.a.x.org", "www.a.x.org"): 2,
        ("www.a.x.org", "a.x.org"): 2,
        ("a.x.org", "x.org"): 2,
        ("x.org", "a.x.org"): 1,
        ("a.x.org", "www.a.x.org"): 1,
        ("x.org", "x.org"): 2,
        ("10.0.0.1", "x.org"): 1,
        ("10.0.0.1", "10.0.0.1"): 1,
        ("single", "single"): 1,
    }


def test_url_trust_over_many_hosts(spark):
    """4000 hosts with links, a hub that half of all pages are of, long html and clashing columns, against plain steps."""
    rng, rows = random.Random(9), []
    for i in range(8000):
        host = "hub.big.com" if i % 2 else f"h{rng.randrange(4000)}.d{rng.randrange(40)}.{rng.choice(['net', 'org', 'com'])}"
        path = rng.choice(["/en/1", "/fr/2", "/de/3"])
        rows.append((i, f"http://{host}{path}", "".join(f'<a href="http://h{rng.randrange(4000)}.d{rng.randrange(40)}.net/x">' for _ in range(rng.randrange(3))) + "<p>" * (200_000 if i == 5 else 1), "h", "p", "r", "v"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, rule string, verdict string").repartition(4)
    got = {r.page_id: r for r in url_trust.url_verdicts(pages, few=0).collect()}  # links are shuffled
    p = spark.createDataFrame([(host_path(r[1])[0], r[2]) for r in rows], "host string, html string")
    links = {(r.src, r.dst): r.n for r in url_trust.host_edges(p).collect()}
    by = defaultdict(list)
    for r in rows:
        by[host_path(r[1])[0]].append(rule(*host_path(r[1]))[1])
    hosts = set(by) | {x for e in links for x in e}
    t = rank_by_hand(links, {h: v.count("allow") / len(v) for h, v in by.items()}, hosts, 80)
    d = rank_by_hand({(b, a): n for (a, b), n in links.items()}, {h: v.count("block") / len(v) for h, v in by.items()}, hosts, 80)
    verdicts = Counter()
    for i, u, *_ in rows:
        h, path = host_path(u)
        r, v = rule(h, path)
        assert (got[i].host, got[i].path, got[i].rule) == (h, path, r)
        if v is None and abs(d[h] - t[h] - 0.2) > 0.03:
            v = "block" if d[h] - t[h] > 0.2 else "allow"
            verdicts[v] += 1
        assert v in (None, got[i].verdict)
    assert min(verdicts["block"], verdicts["allow"]) > 20  # propagation decides either way


def edited(text, k, seed):
    w, rng = text.split(), random.Random(seed)
    for _ in range(k):
        w[rng.randrange(len(w))] = words(1, rng.random())
    return " ".join(w)


def near_rows():
    rows = [(i, words(150 + i % 50, i), "a") for i in range(150)]
    for i in range(40):  # pairs of growing distance
        rows.append((200 + i, edited(rows[i][1], i % 6, i), "b"))
    base = words(300, 999)
    rows += [(300 + i, edited(base, 2, 1000 + i), "c") for i in range(60)]  # a large group
    rows += [(400 + i, rows[i % 3][1], "d") for i in range(50)]  # copies
    passage = words(60, 7777)
    rows += [(500 + i, passage + " " + words(120, 2000 + i), "e") for i in range(60)]  # a shared passage
    random.Random(1).shuffle(rows)
    return rows


def near_by_hand(rows, idf):
    s, sets = near_dedup.Sampler(1, idf), []
    for _, t, _ in rows:
        x, tf = near_dedup.shingles(near_dedup.word_hashes(t), 5)
        sets.append((x, s.weights(x, tf)))
    par = list(range(len(rows)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") if not len(sets[i][0]) else near_dedup.similarity(*sets[i], *sets[j]) >= 0.8
            if same:
                par[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    docs = frame(spark, rows).repartition(4)
    want = near_by_hand(rows, near_dedup.idf_table(docs.select("text"), 5))
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {r[0]: c for r, c in zip(rows, want)} and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert len({r.class_id for r in got if 300 <= r.doc_id < 360}) == 1
    assert len({r.class_id for r in got if r.doc_id >= 500}) == 60


def template_rows(pairs):
    """Pairs of near copies that share most of a template with all others, at about 0.75."""
    template, rows = words(400, 31), []
    for i in range(pairs):
        own = words(50, 5000 + i)
        rows += [(2 * i, template + " " + own, "a"), (2 * i + 1, template + " " + edited(own, 3, 9000 + i), "a")]
    return rows


def test_near_duplicates_meet_in_mixed_buckets(spark):
    rows = template_rows(150)
    docs = frame(spark, rows).repartition(4)
    want = near_by_hand(rows, near_dedup.idf_table(docs.select("text"), 5))
    assert len(set(want)) == 150
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {r[0]: c for r, c in zip(rows, want)}


def test_all_links_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "all_links", functools.partial(near_dedup.all_links, block=16))
    rows = template_rows(40)
    got = near_dedup.near_duplicates(frame(spark, rows), turns=1).collect()  # few links are known before
    assert {r.doc_id: r.class_id for r in got} == {r[0]: r[0] // 2 * 2 for r in rows}


def test_second_leaders_do_not_depend_on_the_first(spark, monkeypatch):
    turns, run = [], near_dedup.leaders
    monkeypatch.setattr(near_dedup, "leaders", lambda pool, turn: turns.append(turn) or run(pool, turn))
    assert near_dedup.near_duplicates(frame(spark, template_rows(4))).count() == 8
    assert turns == [0, 1]


def test_recall_on_documents(spark):
    """Rows whose doc_id is divisible by 50 against all rows: every pair of 0.8 or more by brute force is in one class, and classes are no larger than the links make them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()]
    s, idf = None, near_dedup.idf_table(docs.select("text"), 5)
    s = near_dedup.Sampler(1, idf)
    sets = []
    for _, t, _ in rows:
        x, tf = near_dedup.shingles(near_dedup.word_hashes(t), 5)
        sets.append((x, s.weights(x, tf)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    pairs = [(i, j) for i in range(len(rows)) if rows[i][0] % 50 == 0 for j in range(len(rows)) if i != j and len(sets[i][0]) and near_dedup.similarity(*sets[i], *sets[j]) >= 0.8]
    assert pairs and all(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)
    assert near_by_hand(rows, idf) == [got[r[0]] for r in rows]


def test_weights_do_not_depend_on_the_size():
    """Slots of corpora of one kind, of 20 thousand and of 2 billion texts, with 300 other shingles a text: the weight of a shingle that a given share of texts has."""
    rng, shares = np.random.default_rng(2), np.repeat([0.0, 1e-4, 2e-3, 1e-2, 0.1, 0.5], 4000)
    floor = near_dedup.least_weight(0.8, 0.85)
    assert floor == pytest.approx(0.70588, abs=1e-5)
    got = []
    for n in (20_000, 2_000_000_000):
        counts = rng.poisson(300 * n / near_dedup.SLOTS, near_dedup.SLOTS).astype(np.int64)
        counts[: len(shares)] += (shares * n).astype(np.int64)
        got.append(near_dedup.idf_steps(counts, n, floor)[: len(shares)].reshape(6, -1) / near_dedup.STEPS)
    assert np.abs(got[0].mean(axis=1) - got[1].mean(axis=1)).max() < 0.005
    x = np.clip(np.log(1 / np.maximum(shares[::4000], 1e-9)) / np.log(1000), 0, 1)
    assert np.abs(got[1].mean(axis=1) - (floor + (1 - floor) * x)).max() < 0.01 and (got[1][:2] == 1).mean() > 0.99


def test_guard_links_copies_that_share_only_frequent_shingles():
    floor = near_dedup.least_weight(0.8, 0.85)
    x, y = np.arange(100, dtype=np.uint64), np.concatenate([np.arange(92), np.arange(200, 208)]).astype(np.uint64)  # counted similarity 92 / 108
    weigh = lambda z: np.where(z < 92, floor, 1.0)
    assert near_dedup.similarity(x, weigh(x), y, weigh(y)) >= 0.8


def test_pairs_at_the_threshold_share_a_bucket():
    of = inspect.signature(near_dedup.near_duplicates).parameters
    assert (1 - of["least"].default ** of["rows"].default) ** of["bands"].default < 5e-5


def test_near_duplicates_edges(spark, edge, empty):
    want = near_by_hand(EDGE, near_dedup.idf_table(edge.select("text"), 5))
    got = near_dedup.near_duplicates(edge).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(((r[0], c) for r, c in zip(EDGE, want)), key=str)
    assert near_dedup.near_duplicates(empty).collect() == []


def test_sampler_estimates_weighted_similarity():
    idf = np.random.default_rng(5).integers(10, 200, near_dedup.SLOTS).astype(np.uint8)
    s = near_dedup.Sampler(3000, idf)
    a = words(200, 1)
    for k in (1, 4, 12):
        x, y = (near_dedup.shingles(near_dedup.word_hashes(t), 5) for t in (a, edited(a, k, k)))
        want = near_dedup.similarity(x[0], s.weights(*x), y[0], s.weights(*y))
        assert np.mean(s.sample(*x) == s.sample(*y)) == pytest.approx(want, abs=0.04)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 100)] + [(200, 201 + i) for i in range(30)]
    store = Store(spark, "test")
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), store).collect()}
    assert got == {i: 0 for i in [*range(41), 100, 101]} | {i: 200 for i in range(200, 231)}


def test_idf_counts_all_rows(spark):
    docs = spark.createDataFrame([("a b c d e f",)] * 30 + [(words(30, i),) for i in range(70)], "text string").repartition(5)
    idf = near_dedup.idf_table(docs, 5)
    x, _ = near_dedup.shingles(near_dedup.word_hashes("a b c d e f"), 5)
    assert idf[x & np.uint64(near_dedup.SLOTS - 1)].tolist() == [round((0.70588 + 0.29412 * np.log(100 / 30) / np.log(1000)) * near_dedup.STEPS)] * 2


def test_word_hashes_are_of_words():
    h = near_dedup.word_hashes("The cat, the CAT; a_1 é-cat\nthe")
    assert h[0] == h[2] == h[7] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 4
    assert len(near_dedup.word_hashes(None)) == len(near_dedup.word_hashes("... !")) == 0
    long = "ab " * (near_dedup.SEGMENT // 2)
    assert set(near_dedup.word_hashes(long).tolist()) == set(near_dedup.word_hashes("ab").tolist())
    assert len(near_dedup.word_hashes(long)) == near_dedup.SEGMENT // 2
    assert len(near_dedup.word_hashes("z" * (2 * near_dedup.SEGMENT + 5))) == 3


def test_boundaries():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 20_000, dtype=np.uint8)
    ends = chunk_dedup.boundaries(raw)
    n = np.diff([0, *ends])
    assert ends[-1] == len(raw) and n[:-1].min() >= 16 and n.max() <= 128
    h = [0] * len(raw)
    for i in range(len(raw)):  # the rolling form, in which old bytes leave by the shift
        h[i] = sum(int(chunk_dedup.GEAR[raw[i - j]]) << j for j in range(min(i + 1, chunk_dedup.REACH))) & 0xFFFFFFFF
    assert chunk_dedup.gear(raw).tolist() == h
    moved = chunk_dedup.boundaries(np.concatenate([raw[:5000], np.frombuffer(b"inserted", dtype=np.uint8), raw[5000:]]))
    assert len(set(ends) - {e if e <= 5000 else e - 8 for e in moved}) < 12  # cuts beside the insertion only
    for tiny in (b"", b"a", b"ab" * 7, b"z" * 1000):
        e = chunk_dedup.boundaries(np.frombuffer(tiny, dtype=np.uint8))
        assert e == sorted(set(e)) and (not tiny or e[-1] == len(tiny))


def test_repeated_spans(spark, edge, empty):
    passage = words(60, 7777)
    rows = [(i, words(100, i), "a") for i in range(60)]
    rows += [(100 + i, words(40, 300 + i) + " " + passage + " " + words(40, 600 + i), "b") for i in range(30)]
    rows += [(200, rows[0][1], "c")]
    got = chunk_dedup.repeated_spans(frame(spark, rows).repartition(4)).collect()
    assert {r.doc_id for r in got} == {0, 200, *range(100, 130)}
    text = {i: t.encode() for i, t, _ in rows}
    for r in got:
        span = text[r.doc_id][r.start : r.start + r.length]
        if r.doc_id < 100 or r.doc_id == 200:
            assert span == text[0] and r.n_docs == 2 and r.keep_id == 0 and r.keep == (r.doc_id == 0)
        else:
            assert span[16:-16] in passage.encode() and r.n_docs >= 2 and 100 <= r.keep_id <= r.doc_id
    edges = chunk_dedup.repeated_spans(edge).collect()
    assert {r.doc_id for r in edges} == {9} and len(edges) == 2
    assert chunk_dedup.repeated_spans(empty).collect() == []


def spans_by_hand(rows, least=100):
    cuts, where = [], defaultdict(set)
    for k, (_, t, _) in enumerate(rows):
        raw = (t or "").encode()
        ends = chunk_dedup.boundaries(np.frombuffer(raw, dtype=np.uint8))
        cuts.append([(a, b, raw[a:b]) for a, b in zip([0, *ends[:-1]], ends)])
        for _, _, c in cuts[-1]:
            where[c].add(k)
    low = {c: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for c, ks in where.items()}
    out = []
    for k, chunks in enumerate(cuts):
        run = []
        for a, b, c in [*chunks, (0, 0, None)]:
            if c is not None and len(where[c]) > 1:
                run.append((a, b, c))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                ids = [low[x[2]] for x in run]
                out.append((rows[k][0], run[0][0], run[-1][1] - run[0][0], len(run), min(len(where[x[2]]) for x in run), min((i for i in ids if i is not None), default=None), all(i == rows[k][0] for i in ids)))
            run = []
    return out


def test_repeated_spans_equal_brute_force(spark, edge):
    rng = random.Random(6)
    parts = [words(rng.randint(5, 60), 100 + i) for i in range(25)]
    rows = [(i if i % 17 else None, " ".join(rng.choices(parts, k=rng.randint(0, 6))) + words(rng.randint(1, 80), 900 + i), "a") for i in range(150)]
    rows += [(300 + i, "la " * 400 + words(20, i), "a") for i in range(60)] + [(500, None, "a"), (501, "", "a"), (3, rows[3][1], "a")]
    cols = ["doc_id", "start", "length", "n_chunks", "n_docs", "keep_id", "keep"]
    for docs, want in ((frame(spark, rows).repartition(4), rows), (edge, EDGE)):
        got = Counter(tuple(r[c] for c in cols) for r in chunk_dedup.repeated_spans(docs).collect())
        assert got == Counter(spans_by_hand(want)) and (want is EDGE or len(got) > 100)


def test_near_dedup_keeps_classes_of_repeated_ids(spark):
    near, alone = words(100, 1), words(100, 2)
    rows = [(1, near, "a"), (5, edited(near, 1, 3), "a"), (5, alone, "a"), (6, None, "a")]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, near), (5, alone)] and got.count() == 3


def test_pipeline_stages(spark, tmp_path):
    rows = near_rows()
    frame(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted(kept["quality"]) == sorted(r[0] for r in rows)
    first = {}
    for i, t, _ in sorted(rows):
        first.setdefault(t, i)
    assert sorted(kept["exact_dedup"]) == sorted(first.values())
    left = [r for r in rows if r[0] in set(first.values())]
    classes = near_by_hand(left, near_dedup.idf_table(frame(spark, left).select("text"), 5))
    assert sorted(kept["near_dedup"]) == sorted(set(classes))
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and set(kept["packing"]) == set(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
