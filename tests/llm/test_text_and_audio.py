import hashlib
import re
import zlib

import numpy as np
import pytest

from tessera.llm import licenses, quality, telephony
from tests.llm.conftest import EDGE, frame, words


BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"


def test_license_spans_are_verified(spark):
    w = BSD.split()
    rng = np.random.default_rng(3)
    scrambled = " ".join(" ".join(w[k : k + 4]) for k in rng.permutation(np.arange(18)).tolist())  # all its 4-grams, in no order
    drifting = " ".join(x + " and" * (k % 3) for k, x in enumerate(w))
    rows = [
        (1, scrambled, "a"),
        (2, "see here: " + BSD.upper() + ".", "a"),
        (3, BSD.replace("with or", "with any or"), "a"),  # a word more
        (4, BSD.replace(" following", ""), "a"),  # a word less
        (5, drifting, "a"),
        (6, " ".join(reversed(w)), "a"),
        (7, " ".join(w[:9]) + " " + words(30, 5) + " " + " ".join(w[9:]), "a"),  # the halves far apart
        (8, "mit license " * 50 + "x" * 2_500_000 + " apache license " + words(200_000, 1) + " the mit license", "a"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert [i for i, r in got.items() if "bsd" in r.labels] == [i for i in got if i in (2, 3, 4)]
    assert got[2].score == 1 and got[2].labels == "bsd" and got[6].score < 0.2
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels) == (100 + 1 + 2 + 200_000 + 3, 52, 0, 200_104, "apache,mit")


def labelled(spark, n=400):
    rows = [(i, words(60, i) + ". " if i % 4 else " | ".join(words(60, i).split()), "abc"[i % 3]) for i in range(n)]
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(0, n, 1)], "doc_id long, quality int, toxic int")
    return frame(spark, rows), labels


def test_quality_holds_out_and_learns(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == int(bool(r.doc_id % 4)) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    flipped = labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got)  # held-out labels have no say


def test_quality_edges(spark, edge, empty):
    _, labels = labelled(spark)
    assert len(quality.quality_scores(edge, labels).collect()) == len(EDGE)
    assert quality.quality_scores(empty, labels).collect() == []
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(edge, none).collect()} == {0.5}
    assert quality.good_documents(edge, none).count() == len(EDGE)


def test_linear_time_pairs_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    idx, val = quality.features("Some words, some more words; and numbers 12.", quality.Slots())
    z, _ = quality.logits(m, idx, val.astype(float), np.array([0]))
    want = m.bias + m.linear[idx] @ val + sum(m.factors[idx[i]] @ m.factors[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i))
    assert z[0] == pytest.approx(want)


def test_training_rows_are_bounded(spark, monkeypatch):
    docs, labels = labelled(spark, 100)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, **_: seen.append(rows) or quality.Model(0.0, np.zeros(quality.SIZE), np.zeros((quality.SIZE, 1))))
    quality.train(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels), sample=2)
    assert len(seen[-1]) == 2
    order = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    n = [len(quality.features(docs.where(f"doc_id = {i}").first().text, quality.Slots())[0]) for _, i in order[:3]]
    quality.train(docs, labels, most_slots=sum(n) - 1)
    assert sorted(len(r[0]) for r in seen[-1]) == sorted(n[:2])  # whole texts, until the third goes beyond


def test_training_equals_plain_descent():
    """Steps of AdaGrad on the logistic loss with gradients by differences, over dense vectors and all pairs."""
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.normal(size=3).astype(np.float32), int(k % 2)) for k in range(8)]
    got = quality.fit(rows, rank=2, epochs=2, batch=4)
    r = np.random.default_rng(5)
    w, v = np.zeros(6), r.normal(0, 0.02, (quality.SIZE, 2)).astype(np.float32)[:6].astype(float)
    bias, gw, gv, gb = 0.0, np.full(6, 1e-3), np.full((6, 2), 1e-3), 1e-3
    x = np.zeros((8, 6))
    for k, (idx, val, _) in enumerate(rows):
        x[k, idx] = val
    y = np.array([q[2] for q in rows])

    def loss(b, w, v, at):
        z = np.array([b + w @ x[k] + sum(v[i] @ v[j] * x[k, i] * x[k, j] for i in range(6) for j in range(i)) for k in at])
        return np.mean(np.log1p(np.exp(-z)) + (1 - y[at]) * z)

    def slope(f, a):
        out = np.zeros_like(a)
        for i in np.ndindex(a.shape):
            up, down = a.copy(), a.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            out[i] = (f(up) - f(down)) / 2e-6
        return out

    for _ in range(2):
        order = r.permutation(8)
        for i in range(0, 8, 4):
            at = order[i : i + 4]
            used = (x[at] != 0).any(axis=0)
            dw, dv = slope(lambda a: loss(bias, a, v, at), w) + 1e-5 * w * used, slope(lambda a: loss(bias, w, a, at), v) + 1e-5 * v * used[:, None]  # noqa: B023
            db = float(slope(lambda a: loss(a[0], w, v, at), np.array([bias]))[0])  # noqa: B023
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, bias = w - 0.08 * dw / np.sqrt(gw), v - 0.08 * dv / np.sqrt(gv), bias - 0.08 * db / gb**0.5
    assert got.linear[:6] == pytest.approx(w, abs=2e-3) and got.factors[:6] == pytest.approx(v, abs=2e-3) and got.bias == pytest.approx(bias, abs=2e-3)


def test_quality_of_documents(spark):
    """Scores of real rows by the sum over all pairs, and how well labels that were held out are told."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    model = quality.train(docs, labels)
    for d in docs.where("length(text) between 10 and 600").limit(15).collect():
        idx, val = quality.features(d.text, quality.Slots())
        z = model.bias + float(model.linear[idx] @ val) + sum(float(model.factors[idx[i]] @ model.factors[idx[j]]) * val[i] * val[j] for i in range(len(idx)) for j in range(i))
        assert got[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 30 and np.mean([(g.score >= 0.5) == bool(q) for g, q in held]) > 0.9


def adpcm_by_hand(block):
    x, at, out = int(np.array(block[:2], dtype=np.uint8).view("<i2")[0]), min(block[2], 88), []
    out.append(x)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[at])
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            x = max(-32768, min(32767, x - d if code & 8 else x + d))
            at = max(0, min(88, at + int(telephony.MOVES[code])))
            out.append(x)
    return out


def test_codecs():
    assert telephony.MU[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert telephony.A[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(telephony.STEPS) == 89 and (np.diff(telephony.STEPS) > 0).all()
    blocks = np.random.default_rng(2).integers(0, 256, (9, telephony.BLOCK), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [adpcm_by_hand(b.tolist()) for b in blocks]
    assert telephony.resample(np.array([0, 10, -5], dtype=np.int16)).tolist() == [0, 5, 10, 2, -5, -5]
    for kind in (telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM):
        media = telephony.wav(blocks.tobytes(), kind)
        assert telephony.read_wav(media) == (kind, 8000, blocks.tobytes())
        assert len(telephony.decode(media)) == 2 * (9 * telephony.BLOCK_SAMPLES if kind == telephony.IMA_ADPCM else blocks.size)
    with pytest.raises(ValueError):
        telephony.read_wav(b"not a wav")


def test_telephony_edges(spark, edge, empty, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    got = telephony.op6_telephony(spark, str(tmp_path)).collect()
    assert len(got) == len(EDGE)
    want = sorted((t or "").encode() for _, t, _ in EDGE)
    assert sorted(telephony.read_wav(bytes(r.media))[2][: r.n_bytes] for r in got) == want
    for r in got:
        payload = telephony.read_wav(bytes(r.media))[2]
        assert r.payload_bytes == len(payload) == max(64, -(-r.n_bytes // 64) * 64) and set(payload[r.n_bytes :]) <= {0}
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert bytes(r.pcm) == telephony.decode(bytes(r.media)).tobytes() and telephony.features([bytes(r.media)]) == [r.feature]
        assert r.pcm_bytes == len(r.pcm) == 4 * r.payload_bytes and r.pcm_sha256 == hashlib.sha256(r.pcm).hexdigest()
    assert telephony.telephony(empty).collect() == []


LICENSED = [
    (1, "Released under the MIT License. mit-license, MIT/license", "a"),
    (2, "GNU General Public License\nCC BY cc by CC-BY-NC. apache license", "a"),
    (3, "gnu general the public license; commit license", "a"),
    (4, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "a"),
    (5, "This work is licensed under the GNU General Public License, version 3.", "a"),
]


def phrases_by_hand(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, edge, empty):
    rows = LICENSED + EDGE
    for docs, rows in ((frame(spark, rows), rows), (edge, EDGE)):
        got = licenses.license_scan(docs).collect()
        assert len(got) == len(rows)
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted((phrases_by_hand(t) for _, t, _ in rows), key=key)
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    by = {r.doc_id: r for r in licenses.license_scan(frame(spark, LICENSED)).collect()}
    assert by[3].labels == "" and by[3].score < 1
    assert by[4].labels == "mit" and by[4].base_labels == "" and by[4].score < 1  # words were inserted
    assert by[5].labels == "gpl,gpl-3"
    assert licenses.license_scan(empty).collect() == []
