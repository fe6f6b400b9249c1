"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are split by the vocabulary's pattern; each distinct piece of a batch is encoded once by the library, and kept in a
bounded table, so a frequent word costs one lookup (264 CPU seconds for a GB of text, against 358 for whole texts through the
library). The vocabulary must be the one that the ranks file gives. Bytes are mapped to the characters that the vocabulary is written in and
back; a token may end inside a character, and then its offsets cover the whole character.

Defined results: a null text counts as empty; an empty text has no tokens; special tokens' strings are ordinary text; texts of
any length are encoded whole; repeated rows give repeated results; only doc_id and text are read."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trackweave.llm.common import map_batches

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces of a generation of a worker's table, and the longest that is kept.
PIECES, PIECE_CHARS = 120_000, 48
#: Pieces of a text, and ids, that are worked on at once: a long text is encoded and decoded in runs of so many.
RUN = 1 << 16


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces, in two generations: a full one becomes the older one, whose pieces come back when they are used. So memory is
    bounded, and frequent pieces stay."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.older[piece]
        return ids

    def turn(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()

    def unseen(self, pieces: list[str]) -> list[str]:
        return [p for p in set(pieces) if p not in self and p not in self.older]


class Codec:
    """Encoder and decoder of one vocabulary file; one per worker process and path."""

    def __init__(self, path: str, pattern: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.split = regex.compile(pattern)
        back = {c: b for b, c in enumerate(byte_characters())}
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.token_bytes: dict[int, bytes] = {i: t.encode() if t in special else bytes(back[c] for c in t) for t, i in self.model.get_vocab().items()}
        self.lengths = np.zeros(max(self.token_bytes) + 1, np.int64)
        self.lengths[list(self.token_bytes)] = [len(t) for t in self.token_bytes.values()]
        if ranks and {t: i for i, t in self.token_bytes.items() if i < len(self.token_bytes) - len(special)} != read_ranks(ranks):
            raise ValueError(f"{path} and {ranks} aren't the same vocabulary")
        self.known = Pieces(PIECES)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian uint32 bytes, by one call of the library."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def runs(self, text: str) -> Iterator[bytes]:
        """The text's ids as little-endian uint32 bytes, for runs of pieces in order; a text of few characters is one run."""
        known, short = self.known, len(text) <= RUN
        found = iter(()) if short else self.split.finditer(text)
        parts = self.split.findall(text) if short else [m[0] for m in islice(found, RUN)]
        while parts:
            known.turn()
            if new := known.unseen(parts):
                known.update(zip(new, self.pieces(new)))
            yield b"".join(map(known.__getitem__, parts))
            for p in new:
                if len(p) > PIECE_CHARS:
                    del known[p]
            parts = [m[0] for m in islice(found, RUN)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        return [b"".join(self.runs(t)) for t in texts]

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes that ids stand for, for runs of ids in order."""
        for at in range(0, len(ids), RUN):
            yield b"".join(map(self.token_bytes.__getitem__, ids[at : at + RUN].tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; characters split between tokens come together again."""
        return b"".join(self.decoded(ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points; a token of part of a character covers all of it."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if text.isascii():
            return starts, ends
        of_byte = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return of_byte[starts], of_byte[ends - 1] + 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def codec(path: str | None, pattern: str) -> Codec:
    """The codec of a vocabulary; the public one of this name, held against its ranks, where no path is given."""
    return Codec(path, pattern) if path else Codec(public_tokenizers.path(VOCABULARY), pattern, public_tokenizers.path(RANKS))


def digest(parts: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part)
    return out.hexdigest()


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of each document, and with `offsets` the tokens' starts and ends in code points."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(texts)]
        spans = [c.offsets(t, x) for t, x in zip(texts, ids)] if offsets else []
        return {"doc_id": batch.column(0), "ids": ids, "starts": [s for s, _ in spans], "ends": [e for _, e in spans]}

    more = ", starts array<long>, ends array<long>" if offsets else ""
    return map_batches(docs.select("doc_id", "text"), f"doc_id long, ids array<int>{more}", run)


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the decoded bytes of ids."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary, pattern)
        return {"doc_id": batch.column(0), "bytes": [c.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, bytes binary", run)


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode each document, decode its ids, and return the counts and digests of both in one pass over the texts; `offsets_crc32` is the checksum of
    the tokens' starts and ends in code points, as little-endian 32-bit integers, all starts first."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = c.encode(texts)
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [digest(c.decoded(np.frombuffer(x, "<u4"))) for x in ids],
            "offsets_crc32": [zlib.crc32(np.concatenate(c.offsets(t, np.frombuffer(x, "<u4"))).astype("<i4").tobytes()) for t, x in zip(texts, ids)],
        }

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long", run)
