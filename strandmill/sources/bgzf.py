"""Block-compressed gzip (BGZF) in ranges of its bytes, as partitions of a scan.

A place is a virtual offset: the compressed place of a block and the place within its text, as one number. A task starts at
the first block in its range, finds the first record in it by what records look like, and reads those that start in its
blocks, the last one to its end. It then knows where the next range's first record starts, and compares that with what
the next range's task will find: a wrong guess is an error, never a wrong row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

SHIFT = 16
#: Most bytes of a block.
BLOCK_BYTES = 1 << 16


def _size_of(head: bytes) -> int | None:
    """The length of the block that starts with these bytes; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def is_bgzf(raw) -> bool:
    raw.seek(0)
    return _size_of(raw.read(64)) is not None


def first_block(raw, at: int, size: int) -> int:
    """Where the first block from a place on starts; the file's size if none does.

    Bytes in a block may look like one's start; a real one is followed by another, or by the file's end, and can be unpacked.
    """
    while at < size:
        raw.seek(at)
        window = raw.read(2 * BLOCK_BYTES + 64)
        k = window.find(b"\x1f\x8b\x08\x04")
        while k >= 0 and k <= BLOCK_BYTES:
            n = _size_of(window[k : k + 64])
            if n and (at + k + n == size or _size_of(window[k + n : k + n + 64])) and _unpacks(window[k : k + n]):
                return at + k
            k = window.find(b"\x1f\x8b\x08\x04", k + 1)
        at += BLOCK_BYTES + 1
    return size


def _unpacks(data: bytes) -> bool:
    try:
        zlib.decompress(data, 31)
    except zlib.error:
        return False
    return True


class BlockReader:
    """The text from a block on, as a file that tells virtual offsets."""

    def __init__(self, raw, start: int, size: int):
        self.raw, self.size, self.next = raw, size, start
        self.block, self.text, self.at = start, b"", 0

    def _load(self) -> bool:
        """The next block that has text; False at the end."""
        while self.next < self.size:
            self.raw.seek(self.next)
            head = self.raw.read(64)
            n = _size_of(head)
            if n is None:
                raise ValueError(f"No BGZF block at byte {self.next}")
            data = head[:n] + self.raw.read(max(0, n - len(head)))
            if len(data) < n:
                raise ValueError(f"The BGZF block at byte {self.next} is cut off")
            self.block, self.text, self.at, self.next = self.next, zlib.decompress(data, 31), 0, self.next + n
            if self.text:
                return True
        self.block, self.text, self.at = self.size, b"", 0
        return False

    def tell(self) -> int:
        """The place of the next byte."""
        if self.at >= len(self.text):
            self._load()
        return self.block << SHIFT | self.at

    def seek(self, place: int) -> None:
        self.next, self.text, self.at = place >> SHIFT, b"", 0
        if self._load():
            self.at = place & ((1 << SHIFT) - 1)

    def read(self, n: int) -> bytes:
        parts = []
        while n and (self.at < len(self.text) or self._load()):
            part = self.text[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def readline(self) -> bytes:
        parts = []
        while self.at < len(self.text) or self._load():
            k = self.text.find(b"\n", self.at) + 1
            part = self.text[self.at : k or len(self.text)]
            self.at += len(part)
            parts.append(part)
            if k:
                break
        return b"".join(parts)


def records(raw, lo: int, hi: int, size: int, find: Callable[[BlockReader], int], parse: Callable[[BlockReader, int], Iterator]) -> Iterator:
    """The records that start in blocks from ``lo`` to below ``hi`` of the compressed file, and one at the start of the next block.

    find: the place of the first record after a block's first byte (whether one starts there can't be seen from the block);
    parse: records while they start before a place.
    """
    reader = BlockReader(raw, 0 if lo == 0 else first_block(raw, lo, size), size)
    if reader.tell() >> SHIFT >= hi:
        return
    # the first block with text from the range's end on
    behind = BlockReader(raw, first_block(raw, hi, size), size).tell() >> SHIFT if hi < size else size
    stop = behind << SHIFT | (behind < size)
    start = find(reader) if lo else 0
    if start >= stop:
        return
    reader.seek(start)
    yield from parse(reader, stop)
    if behind < size and reader.tell() != find(BlockReader(raw, behind, size)):
        raise ValueError(f"Records from byte {hi} on can't be told apart: read the file with larger ranges")
