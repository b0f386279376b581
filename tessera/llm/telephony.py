"""Telephony audio: mu-law, A-law and IMA ADPCM payloads in WAV files, decoded to PCM with numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spread, table
from tessera.shipping import ship

BLOCK = 64
#: Samples of an ADPCM block of BLOCK bytes: one in its header and two in each byte after it.
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
#: WAV format numbers.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17


def mu_law_table() -> np.ndarray:
    """The 16-bit sample of each G.711 mu-law byte."""
    u = ~np.arange(256, dtype=np.int64) & 255
    x = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -x, x).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 16-bit sample of each G.711 A-law byte."""
    a = np.arange(256, dtype=np.int64) ^ 85
    e, m = (a >> 4) & 7, (a & 15) << 4
    x = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(a & 128, x, -x).astype(np.int16)


#: Fixed values of the IMA ADPCM standard: its step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MU, A = mu_law_table(), a_law_table()
#: Fixed values of the standard: how a 4-bit code moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
_CODES = np.arange(16, dtype=np.int32)
_DELTAS = (STEPS[:, None] >> 3) + np.where(_CODES & 4, STEPS[:, None], 0) + np.where(_CODES & 2, STEPS[:, None] >> 1, 0) + np.where(_CODES & 1, STEPS[:, None] >> 2, 0)
#: Change of the sample, and next step index, by (step index, code).
DELTA = np.where(_CODES & 8, -_DELTAS, _DELTAS).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89, dtype=np.int32)[:, None] + MOVES, 0, 88) * 16).ravel().astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, BLOCK_SAMPLES) of n mono IMA ADPCM blocks (n, BLOCK), all blocks at once, one code after the other. A header's step index above 88 counts as 88."""
    cols = np.ascontiguousarray(blocks.T)
    x = (cols[0].astype(np.int32) | cols[1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    at = np.minimum(cols[2], 88).astype(np.int32) * 16
    out = np.empty((BLOCK_SAMPLES, len(blocks)), dtype=np.int16)
    out[0] = x
    k = 1
    for byte in cols[4:]:
        for code in (byte & 15, byte >> 4):
            at += code
            x += DELTA[at]
            np.clip(x, -32768, 32767, out=x)
            out[k] = x
            at = NEXT[at]
            k += 1
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next (the last: itself), rounded down."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def wav(payload: bytes, kind: int = MU_LAW, rate: int = 8000) -> bytes:
    """A mono WAV file that holds the payload unchanged."""
    adpcm = kind == IMA_ADPCM
    samples = len(payload) // BLOCK * BLOCK_SAMPLES if adpcm else len(payload)
    fmt = struct.pack("<HHIIHHH", kind, 1, rate, rate * BLOCK // BLOCK_SAMPLES if adpcm else rate, BLOCK if adpcm else 1, 4 if adpcm else 8, 2 if adpcm else 0) + (struct.pack("<H", BLOCK_SAMPLES) if adpcm else b"")
    head = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format number, rate, data) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, data = 12, 0, 0, b""
    while at + 8 <= len(media):
        n = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif media[at : at + 4] == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return kind, rate, data


def decode(media: bytes) -> np.ndarray:
    """The PCM samples of a mu-law, A-law or ADPCM WAV file at twice its rate."""
    kind, _, data = read_wav(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int16)
    if kind == IMA_ADPCM:
        return resample(decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1))
    return resample((A if kind == A_LAW else MU)[raw])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes before padding, the text in UTF-8 padded with zeros to a positive multiple of BLOCK)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


class Sums(NamedTuple):
    rms: int
    peak: int
    crossings: int
    crc: int


def sums(pcm: np.ndarray) -> Sums:
    """Integer features of one signal: root mean square, largest magnitude, changes of sign, and the CRC-32 of its bytes."""
    x = pcm.astype(np.int32)
    s = pcm < 0
    return Sums(int(np.sqrt(np.dot(pcm.astype(np.float64), pcm) / max(1, len(pcm)))), int(np.abs(x).max(initial=0)), int(np.count_nonzero(s[1:] != s[:-1])), zlib.crc32(np.ascontiguousarray(pcm).view(np.uint8)))


def features(stored: list[bytes]) -> list[str]:
    """One text for each stored file: its signal expanded as mu-law, as A-law and as ADPCM blocks, at twice the rate.

    The files' ADPCM blocks are decoded together; each file's features depend on its own bytes alone.
    """
    data = [np.frombuffer(read_wav(m)[2], dtype=np.uint8) for m in stored]
    out, step = [], 1 << 16
    blocks = np.concatenate(data).reshape(-1, BLOCK) if data else np.zeros((0, BLOCK), dtype=np.uint8)
    decoded = np.concatenate([decode_adpcm(blocks[i : i + step]) for i in range(0, len(blocks), step)]) if len(blocks) else None
    at = 0
    for raw in data:
        n = len(raw) // BLOCK
        parts = [("mu", MU[raw]), ("a", A[raw]), ("adpcm", decoded[at : at + n].reshape(-1))]
        at += n
        out.append(";".join(f"{k}:{s.rms},{s.peak},{s.crossings},{s.crc:08x}" for k, s in ((k, sums(resample(x))) for k, x in parts)))
    return out


def _store(step_bytes: int = 1 << 20):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "payload_bytes", "media", "feature", "pcm"]

    def rows(part: list[tuple]) -> pa.RecordBatch:
        media = [wav(p) for _, _, p in part]
        cols = [[i for i, _, _ in part], [n for _, n, _ in part], [len(read_wav(m)[2]) for m in media], media, features(media), [decode(m).tobytes() for m in media]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                part.append((i.as_py(), *payload_of(t.as_py())))
                held += len(part[-1][2])
                if held >= step_bytes:
                    yield rows(part)
                    part, held = [], 0
        if part:
            yield rows(part)

    return run


def telephony(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its text stored as a mu-law WAV file of 8-bit samples at 8 kHz, read back and decoded.

    Columns: doc_id, n_bytes (of the text), payload_bytes (read back), media (the file), feature, and pcm (its samples at
    16 kHz, 16 bits, little-endian). Null and empty texts are 64 zero bytes. Equal texts have equal values; rows that
    repeat another stay. No rows: no rows. Other columns are not read. A task holds about 1 MB of payload at a time with its
    file and samples, or one text if that is longer.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(d).mapInArrow(_store(), "doc_id long, n_bytes long, payload_bytes long, media binary, feature string, pcm binary")


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored files and samples with their digests. The payload is the end of the file, as its header says (``wav``)."""
    out = telephony(table(spark, sf_dir, "documents"))
    payload = lambda n: F.expr(f"substring(media, -({n}))")
    return out.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2(payload("payload_bytes"), 256).alias("payload_sha256"),
        F.crc32(payload(BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
        "media",
        "pcm",
    )
