"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM blocks decoded by numpy across blocks, resampled PCM.

Audio travels in WAV containers (format tags 7, 6 and 0x11; one channel, 8 kHz). `decode` gives 16-bit PCM and the PCM resampled
to another rate. Mu-law and A-law take one byte a sample; an ADPCM block is a 4-byte header (first sample, step index) and then
two samples a byte.

Defined results: null or unreadable media give null PCM and feature; a null text counts as empty, and its payload is 64 zero bytes;
equal texts give equal rows, whatever batch they come in; texts of any length are stored whole."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackweave.llm.common import map_batches

RATE, RESAMPLED = 8000, 16000
PAD = 64
CODECS = {7: "mulaw", 6: "alaw", 0x11: "ima"}
TAGS = {name: tag for tag, name in CODECS.items()}
#: Payload bytes of an ADPCM block; its header of 4 zero bytes comes before them.
IMA_BODY, IMA_HEADER = 64, 4
#: Fixed values of IMA ADPCM: how the step index moves for each code.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Fixed values of IMA ADPCM: the step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """Byte to 16-bit sample by G.711's rule for mu-law."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    level = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -level, level).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Byte to 16-bit sample by G.711's rule for A-law."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    power, level = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    level = np.where(power > 0, (level + 0x100) << np.maximum(power - 1, 0), level)
    return np.where(code & 0x80, level, -level).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of all blocks (rows of header and body bytes) at once: a numpy step for each code, over all blocks."""
    n, width = blocks.shape
    head = blocks[:, :IMA_HEADER].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], len(STEPS) - 1)
    body = np.ascontiguousarray(blocks[:, IMA_HEADER:].T)
    out = np.empty((1 + 2 * (width - IMA_HEADER), n), np.int16)
    out[0] = value
    for k in range(width - IMA_HEADER):
        for half, code in ((1, body[k] & 15), (2, body[k] >> 4)):
            step = STEPS[index]
            move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + INDEX_MOVE[code], 0, len(STEPS) - 1)
            out[2 * k + half] = value
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file whose data are the payload, byte for byte; for ADPCM each block gets a header of zeros before it."""
    tag, data, align, bits, more = TAGS[codec], payload, 1, 8, b""
    if codec == "ima":
        rows = np.frombuffer(payload, np.uint8).reshape(-1, IMA_BODY)
        data = np.pad(rows, ((0, 0), (IMA_HEADER, 0))).tobytes()
        align, bits, more = IMA_HEADER + IMA_BODY, 4, struct.pack("<H", 1 + 2 * IMA_BODY)
    speed = rate * align // (1 + 2 * IMA_BODY) if codec == "ima" else rate
    head = struct.pack("<HHIIHHH", tag, 1, rate, speed, align, bits, len(more)) + more
    size = 4 + 8 + len(head) + 8 + len(data)
    return b"RIFF" + struct.pack("<I", size) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data


def read_wav(media: bytes | None) -> tuple[str, int, int, bytes] | None:
    """(codec, rate, block size, data) of a WAV file with one channel; None if it can't be read."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[0] not in CODECS or form[1] != 1:
        return None
    if CODECS[form[0]] == "ima" and (form[4] <= IMA_HEADER or len(data) % form[4]):
        return None
    return CODECS[form[0]], form[2], form[4], data


def stored_payload(codec: str, block: int, data: bytes) -> bytes:
    """The payload that `wav` stored."""
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, IMA_HEADER:].tobytes() if codec == "ima" else data


def decode_all(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """(rate, 16-bit samples) of each file; the ADPCM blocks of all files with one block size are decoded together."""
    read = [read_wav(m) for m in media]
    out: list = [None] * len(media)
    by_block: dict[int, list[int]] = {}
    for k, r in enumerate(read):
        if r and r[0] == "ima":
            by_block.setdefault(r[2], []).append(k)
        elif r:
            out[k] = r[1], (MULAW if r[0] == "mulaw" else ALAW)[np.frombuffer(r[3], np.uint8)]
    for block, ks in by_block.items():
        rows = np.frombuffer(b"".join(read[k][3] for k in ks), np.uint8).reshape(-1, block)
        pcm, at = decode_ima(rows), 0
        for k in ks:
            n = len(read[k][3]) // block
            out[k], at = (read[k][1], pcm[at : at + n].ravel()), at + n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers at `to` samples a second; ends are held."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    low, part = at // to, at % to
    high = np.minimum(low + 1, len(pcm) - 1)
    return ((pcm[low].astype(np.int64) * (to - part) + pcm[high].astype(np.int64) * part) // to).astype(np.int16)


def feature(codec: str, pcm: np.ndarray, resampled: np.ndarray) -> str:
    """Counts and sums in integers: samples, peak, mean size, sign changes, and a checksum of the resampled PCM."""
    wide = pcm.astype(np.int32)
    size = np.abs(wide)
    turns = int((np.signbit(wide[1:]) != np.signbit(wide[:-1])).sum()) if len(wide) > 1 else 0
    return f"{codec};n={len(pcm)};peak={int(size.max(initial=0))};mean={int(size.sum(dtype=np.int64)) // max(1, len(pcm))};turns={turns};pcm{RESAMPLED // 1000}k={zlib.crc32(resampled.astype('<i2').tobytes())}"


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % PAD if data else PAD)


def decode(frame: DataFrame, media: str = "media", to: int = RESAMPLED) -> DataFrame:
    """The rows with columns pcm (16-bit little-endian bytes at rate `to`), pcm_rate and feature added or replaced."""
    from pyspark.sql.types import StructType

    base = frame.drop("pcm", "pcm_rate", "feature")
    schema = StructType([*base.schema.fields, *StructType.fromDDL("pcm binary, pcm_rate int, feature string").fields])
    names = base.columns
    at = names.index(media)

    def run(batch: pa.RecordBatch) -> dict:
        files = batch.column(at).to_pylist()
        pcm, kinds = decode_all(files), [read_wav(m) for m in files]
        new = [p and resample(p[1], p[0], to) for p in pcm]
        return dict(zip(names, batch.columns)) | {
            "pcm": [None if x is None else x.astype("<i2").tobytes() for x in new],
            "pcm_rate": [None if x is None else to for x in new],
            "feature": [None if x is None else feature(k[0], p[1], x) for k, p, x in zip(kinds, pcm, new)],
        }

    return map_batches(base, schema, run)


def store(docs: DataFrame, files: bool = True) -> DataFrame:
    """Store each text's payload as WAV, in the codec that the payload's checksum picks, read it back, decode and resample it, and
    describe all of it; columns media (the WAV file) and pcm (16-bit little-endian samples at 16 kHz) hold the stored bytes themselves.
    Without `files` these two are left out and their digests stay."""

    def run(batch: pa.RecordBatch) -> dict:
        pay = [payload(t) for t in batch.column(1).to_pylist()]
        media = [wav(p, CODECS[sorted(CODECS)[zlib.crc32(p) % 3]]) for _, p in pay]
        read = [read_wav(m) for m in media]
        back = [stored_payload(r[0], r[2], r[3]) for r in read]
        pcm = decode_all(media)
        new = [resample(p, rate, RESAMPLED).astype("<i2") for rate, p in pcm]
        return {
            "doc_id": batch.column(0),
            "n_bytes": [n for n, _ in pay],
            "payload_bytes": [len(b) for b in back],
            "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            "tail_crc32": [zlib.crc32(b[-PAD:]) for b in back],
            "media_bytes": [len(m) for m in media],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "feature": [feature(r[0], p, x) for r, (_, p), x in zip(read, pcm, new)],
            "pcm_bytes": [x.nbytes for x in new],
            "pcm_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in new],
        } | ({"media": media, "pcm": [x.tobytes() for x in new]} if files else {})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return map_batches(docs.select("doc_id", "text"), schema + (", media binary, pcm binary" if files else ""), run)
