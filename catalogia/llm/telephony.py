"""Telephony audio: G.711 mu-law and A-law by lookup tables, IMA ADPCM decoded with numpy across blocks, resampled PCM.

The codes are those of ITU-T G.711 and of the IMA/DVI ADPCM recommendation (WAV format tags 7, 6 and 17).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalogia.llm import common

MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 17, 1
#: Payloads are padded with PAD to a positive multiple of FRAME bytes.
FRAME, PAD = 192, 32
RATE, OUT_RATE = 8_000, 16_000
#: What stored_and_read stores, so that the samples take no more room than the texts.
STORED_RATE = 4_000
#: Bytes of an ADPCM block of one channel: a header of 4, then two samples a byte.
ADPCM_BLOCK = 192
#: Blocks that are decoded together, at most.
BLOCKS_AT_ONCE = 8_192
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: the code's bits are inverted; sign, 3 bits of exponent, 4 bits of mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law: every second bit is inverted; the first segment is linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 step sizes: each a tenth larger than the one before, with the recommendation's roundings as they fall."""
    # Fixed values of the IMA ADPCM recommendation.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


MU, A, STEPS = mu_law_table(), a_law_table(), ima_steps()


def decode_adpcm(data: bytes, block: int = ADPCM_BLOCK) -> np.ndarray:
    """IMA ADPCM of one channel: all blocks advance together, one sample at a time. A last block that is cut short is padded with zero codes."""
    n = -(-len(data) // block)
    if n > BLOCKS_AT_ONCE:
        step = block * BLOCKS_AT_ONCE
        return np.concatenate([decode_adpcm(data[at : at + step], block) for at in range(0, len(data), step)])
    raw = np.frombuffer(data + bytes(n * block - len(data)), np.uint8).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    out = np.empty((n, 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = value
    codes = np.empty((2 * (block - 4), n), np.int32)
    codes[0::2], codes[1::2] = (raw[:, 4:] & 15).T, (raw[:, 4:] >> 4).T
    for k, code in enumerate(codes):
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


@lru_cache(16)
def low_pass(rate: int, to: int) -> np.ndarray:
    """Taps of a windowed sinc that ends below half of the lower rate, as integers whose sum is 2 ** 15."""
    half = 16 * rate // to
    k = np.arange(-half, half + 1)
    taps = np.sinc(k * 0.9 * to / rate) * np.hamming(2 * half + 1)
    whole = np.round(taps / taps.sum() * (1 << 15)).astype(np.int64)
    whole[half] += (1 << 15) - whole.sum()
    return whole


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate's instants, in integer arithmetic (halves away from the lower neighbour).

    To a lower rate, what lies above its half is filtered out first (the ends go on as they are), so that it doesn't come back as lower tones.
    """
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = len(samples) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // to, at % to
    x = samples.astype(np.int64)
    if to < rate:
        taps = low_pass(rate, to)
        wide = np.pad(x, len(taps) // 2, mode="edge")
        x = np.clip((np.convolve(wide, taps, "valid") + (1 << 14)) >> 15, -32768, 32767)
    high = np.minimum(low + 1, len(x) - 1)
    return ((x[low] * (to - part) + x[high] * part + to // 2) // to).astype(np.int16)


def wav(payload: bytes, tag: int, rate: int, bits: int, block: int) -> bytes:
    """A RIFF/WAVE file of one channel; payload as it is."""
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block, block, bits)
    if tag != PCM:
        fmt += struct.pack("<H", 0)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and the data chunk of a WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, block = 12, 0, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", data, at + 8)
        elif name == b"data":
            return tag, rate, block, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def adpcm_together(media: list[bytes]) -> list[np.ndarray | None]:
    """The samples of those of the files that are IMA ADPCM of whole blocks of ADPCM_BLOCK bytes, all their blocks decoded together; none for others."""
    parts = [read_wav(m) for m in media]
    mine = [i for i, (tag, _, block, data) in enumerate(parts) if tag == IMA_ADPCM and block == ADPCM_BLOCK and data and len(data) % block == 0]
    out: list[np.ndarray | None] = [None] * len(media)
    if mine:
        samples = decode_adpcm(b"".join(parts[i][3] for i in mine))
        ends = np.cumsum([len(parts[i][3]) // ADPCM_BLOCK * (1 + 2 * (ADPCM_BLOCK - 4)) for i in mine])
        for i, x in zip(mine, np.split(samples, ends[:-1])):
            out[i] = x
    return out


def to_pcm(media: bytes, out_rate: int = OUT_RATE, samples: np.ndarray | None = None) -> np.ndarray:
    """16-bit samples at out_rate of a mu-law, A-law, IMA ADPCM or PCM WAV file of one channel; samples: those of the file, if they are decoded already."""
    tag, rate, block, data = read_wav(media)
    if samples is not None:
        pass
    elif tag == MU_LAW:
        samples = MU[np.frombuffer(data, np.uint8)]
    elif tag == A_LAW:
        samples = A[np.frombuffer(data, np.uint8)]
    elif tag == IMA_ADPCM:
        samples = decode_adpcm(data, block)
    elif tag == PCM and block == 2:
        samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    else:
        raise ValueError(f"format {tag} is not telephony audio")
    return resample(samples, rate, out_rate)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes([PAD]) * (-len(raw) % FRAME if raw else FRAME)


def codec_of(payload: bytes) -> int:
    """Of eight payloads, by their CRC-32, four are taken as mu-law, three as A-law, one as ADPCM: equal texts are the same audio."""
    return (MU_LAW, MU_LAW, MU_LAW, MU_LAW, A_LAW, A_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) & 7]


def store_media(docs: DataFrame, tag: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes as the code samples of a telephony WAV file of the format tag (none: codec_of): doc_id, n_bytes, media. No exchange.

    The codes are stored as they are, so the payload comes back byte for byte; equal texts give equal media. Null texts are empty; null and repeated
    ids are rows like others; other columns of docs don't matter.
    """
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column("text").to_pylist():
                n, payload = payload_of(text)
                mine = tag or codec_of(payload)
                sizes.append(n)
                media.append(wav(payload, mine, RATE, *((4, ADPCM_BLOCK) if mine == IMA_ADPCM else (8, 1))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return src.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_file(samples: np.ndarray, rate: int, bits: int) -> bytes:
    """A PCM WAV file: 16 bits, signed; or the rounded upper 8, unsigned, as WAV has them."""
    if bits == 8:
        return wav((np.clip((samples.astype(np.int32) + 128) >> 8, -128, 127) + 128).astype(np.uint8).tobytes(), PCM, rate, 8, 1)
    return wav(samples.astype("<i2").tobytes(), PCM, rate, 16, 2)


def decoded(media: DataFrame, out_rate: int = OUT_RATE, bits: int = 16) -> DataFrame:
    """From stored files: the payload's length, SHA-256 and the CRC-32 of its last 16 bytes, the file's length and SHA-256, and pcm, a PCM WAV file at out_rate."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            files = [m.as_buffer().to_pybytes() for m in b.column("media")]
            for name, n, data, done in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), files, adpcm_together(files)):
                payload = read_wav(data)[3]
                samples = pcm_file(to_pcm(data, out_rate, done), out_rate, bits)
                rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), samples))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    common.small_batches(media.sparkSession, 1000)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm binary")


def pcm(media: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """doc_id and pcm, a 16-bit PCM WAV file at out_rate, of each stored file."""
    return decoded(media, out_rate).select("doc_id", "pcm")


def described(made: DataFrame) -> DataFrame:
    """The columns of decoded(), but feature instead of pcm: seconds, root mean square, peak, zero crossings a second, and the SHA-256 of the PCM bytes (16 digits of it)."""

    def of(data: bytes) -> str:
        _, rate, block, raw = read_wav(data)
        x = np.frombuffer(raw, "<i2") if block == 2 else (np.frombuffer(raw, np.uint8).astype(np.int16) - 128) * 256
        wide = x.astype(np.float64)
        seconds = len(x) / rate
        crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        peak = int(np.abs(x.astype(np.int32)).max()) if len(x) else 0
        rms = float(np.sqrt(np.dot(wide, wide) / len(x))) if len(x) else 0.0
        return f"s={seconds:.3f} rms={rms:.2f} peak={peak} zcr={crossings / seconds if seconds else 0:.2f} pcm={hashlib.sha256(raw).hexdigest()[:16]}"

    names = [c for c in made.columns if c != "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feature = pa.array([of(m.as_buffer().to_pybytes()) for m in b.column("pcm")], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), feature], [*names, "feature"])

    return made.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*names).schema) + ", feature string")


def features(media: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """The digests of stored files and the features of their resampled PCM."""
    return described(decoded(media, out_rate))


def stored_and_read(docs: DataFrame, out_rate: int = STORED_RATE) -> DataFrame:
    """Stores docs as telephony files (one Parquet column in the shared folder), decodes what is read back, stores the PCM at out_rate in 8 bits a sample, and returns the features of that, read back."""
    return described(common.saved(decoded(common.saved(store_media(docs), "media"), out_rate, 8), "pcm"))


def stored_and_described(docs: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """Stores docs as telephony files (one Parquet column in the shared folder), and returns the digests of what is read back and the features of its 16-bit PCM at out_rate.

    The PCM goes from the decoder to the features within a task: at the full rate it is four times the texts or more, so it isn't stored.
    """
    return features(common.saved(store_media(docs), "media"), out_rate)
