"""Wavelet matrix files: a sequence of token ids as bit-planes with rank and select, read in place from one compressed file.

Plane 0 holds the highest bit of every id in order; the ids are then parted, zeros before ones and each side in order, and the next
plane holds the next bit. Planes are stored in compressed blocks of 2**16 bits with the number of ones before each block, so a lookup
reads one block a plane.

File, little-endian: magic, blocks of all planes, document table, footer (JSON, compressed), length of the footer in 8 bytes, magic.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Sequence
from typing import BinaryIO

import numpy as np
import zstandard

MAGIC = b"WMTOKEN1"
#: Bits in a block, and decompressed blocks a reader keeps.
BLOCK, KEPT = 1 << 16, 512


def _dense(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _sparse(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 40) if raw else b"", dtype=kind)


def planes_of(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit-planes of ids below ``2**bits``, highest first, as arrays of booleans."""
    found = []
    for b in range(bits - 1, -1, -1):
        plane = (ids & ids.dtype.type(1 << b)).astype(bool)
        found.append(plane)
        ids = np.concatenate([np.compress(~plane, ids), np.compress(plane, ids)])
    return found


def write_file(out: BinaryIO, ids: np.ndarray, lengths: Sequence[int], doc_ids: Sequence[int | None], bits: int) -> None:
    """Writes the ids of whole documents, in order; ``lengths`` adds up to their number, and a doc_id may be null."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if int(lengths.sum()) != len(ids) or (len(ids) and int(ids.max()) >> bits):
        raise ValueError("ids, lengths and bits do not fit")
    press, at = zstandard.ZstdCompressor(level=1), len(MAGIC)
    out.write(MAGIC)
    planes = []
    for plane in planes_of(ids, bits):
        packed = np.packbits(plane, bitorder="little").tobytes()
        blocks = [press.compress(packed[i : i + BLOCK // 8]) for i in range(0, len(packed), BLOCK // 8)]
        ones = np.add.reduceat(plane, np.arange(0, len(plane), BLOCK), dtype=np.int64) if len(plane) else np.zeros(0, dtype=np.int64)
        for block in blocks:
            out.write(block)
        planes.append({"at": at, "sizes": [len(b) for b in blocks], "ones": ones.tolist()})
        at += sum(map(len, blocks))
    null = np.array([d is None for d in doc_ids], dtype=bool)
    tables = [_dense(lengths), _dense(np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)), _dense(null)]
    for table in tables:
        out.write(table)
    footer = zstandard.ZstdCompressor(level=3).compress(json.dumps(
        {"n": len(ids), "bits": bits, "docs": len(lengths), "at": at, "tables": [len(t) for t in tables], "planes": planes}).encode())
    out.write(footer)
    out.write(len(footer).to_bytes(8, "little") + MAGIC)


class TokenFile:
    """Reads a file in place; ``source`` has ``seek``, ``read`` and a known ``size``."""

    def __init__(self, source: BinaryIO, size: int):
        self._source = source
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:8], "little")
        self._footer = json.loads(zstandard.ZstdDecompressor().decompress(self._read(size - 16 - length, length), max_output_size=1 << 40))
        self.n, self.bits, self.docs = (self._footer[k] for k in ("n", "bits", "docs"))
        self._planes = [(p["at"] + np.cumsum([0, *p["sizes"]]), np.cumsum([0, *p["ones"]])) for p in self._footer["planes"]]
        self._kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _read(self, at: int, length: int) -> bytes:
        self._source.seek(at)
        return self._source.read(length)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids, doc_id and whether it is null, of every document."""
        at, found = self._footer["at"], []
        for length, kind in zip(self._footer["tables"], ("<i8", "<i8", "?"), strict=True):
            found.append(_sparse(self._read(at, length), kind))
            at += length
        return tuple(found)

    def _bytes(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._kept:
            places = self._planes[plane][0]
            raw = self._read(int(places[block]), int(places[block + 1] - places[block]))
            self._kept[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=BLOCK // 8), dtype=np.uint8)
            if len(self._kept) > KEPT:
                self._kept.popitem(last=False)
        self._kept.move_to_end(key)
        return self._kept[key]

    def _ones(self, plane: int, i: int) -> int:
        """Ones in the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        total = int(self._planes[plane][1][block])
        if rest:
            raw = self._bytes(plane, block)
            total += int(np.bitwise_count(raw[: rest // 8]).sum())
            if rest % 8:
                total += int(raw[rest // 8] & ((1 << rest % 8) - 1)).bit_count()
        return total

    def _zeros(self, plane: int) -> int:
        return self.n - int(self._planes[plane][1][-1])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = int(self._bytes(plane, i // BLOCK)[i % BLOCK // 8]) >> i % 8 & 1
            ones = self._ones(plane, i)
            i = self._zeros(plane) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among the first ``end`` ids stand after the last plane."""
        low, high = 0, end
        if token < 0 or token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones(plane, low), self._ones(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self._zeros(plane) + a, self._zeros(plane) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token among the first ``end`` ids (all, if not given)."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th bit of this kind (from 0) in a plane."""
        ones = self._planes[plane][1]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(plane, block), bitorder="little", count=min(BLOCK, self.n - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of a token, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._find(plane, bit, at - self._zeros(plane) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, as unsigned 32-bit integers, put together from the lowest plane upwards."""
        ids = np.zeros(self.n, dtype="<u4")
        for plane in range(self.bits - 1, -1, -1):
            blocks = len(self._planes[plane][0]) - 1
            raw = np.concatenate([self._bytes(plane, b) for b in range(blocks)]) if blocks else np.zeros(0, dtype=np.uint8)
            bits = np.unpackbits(raw, bitorder="little", count=self.n).view(bool)
            zeros, above = self.n - int(bits.sum()), np.empty(self.n, dtype="<u4")
            above[np.flatnonzero(~bits)] = ids[:zeros]
            above[np.flatnonzero(bits)] = ids[zeros:] | np.uint32(1 << (self.bits - 1 - plane))
            ids = above
        return ids
