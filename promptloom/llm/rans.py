"""Static range asymmetric numeral system over token ids: numpy in, bytes out.

A block is cut into segments; a segment has LANES interleaved coders, token t going to lane t % LANES. The state of a lane is a
64-bit number in [2**31, 2**63) that gives and takes 32-bit words. The states at the start of every segment are the
checkpoints from which segments are decoded independently, and at once.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

LANES, SEGMENT, BLOCK, SCALE_BITS = 128, 32_768, 65_536, 20
MAGIC = b"RNS1"
_HEAD = struct.Struct("<4sIHBxIII")  # magic, ids, lanes, scale bits, segment length, words, crc32 of the ids
_LOW = np.uint64(1 << 31)


def frequencies(ids: np.ndarray, counts: np.ndarray, scale_bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their shares of 2**scale_bits); each share is at least 1. ids ascend."""
    order = np.argsort(ids)
    ids, counts = np.asarray(ids)[order], np.asarray(counts, dtype=np.float64)[order]
    total = 1 << scale_bits
    if len(ids) > total:
        raise ValueError("more distinct ids than shares: raise scale_bits")
    if not len(ids):
        return ids.astype(np.uint32), np.zeros(0, np.uint32)
    share = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
    extra = total - share.sum()
    if extra > 0:
        share[np.argmax(share)] += extra
    while extra < 0:  # too many ids were raised to 1: the largest give way
        top = np.argmax(share)
        cut = min(-extra, share[top] // 2)
        share[top] -= cut
        extra += cut
    return ids.astype(np.uint32), share.astype(np.uint32)


class Model:
    def __init__(self, ids: np.ndarray, shares: np.ndarray, scale_bits: int = SCALE_BITS):
        self.bits, self.ids = scale_bits, ids.astype(np.uint32)
        self.freq = shares.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(shares.astype(np.int64))[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        self.symbol = np.repeat(np.arange(len(ids), dtype=np.uint32), shares)  # slot -> index in ids
        self.index = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
        self.index[ids] = np.arange(len(ids))

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Each block of at most BLOCK ids -> its bytes. Segments of all blocks are coded side by side."""
        lanes, steps = LANES, SEGMENT // LANES
        parts = [b[at : at + SEGMENT] for b in blocks for at in range(0, max(len(b), 1), SEGMENT)]
        sizes = np.array([len(p) for p in parts])
        least = int(sizes.min(initial=SEGMENT))
        grid = np.zeros((len(parts), steps * lanes), np.uint32)
        for i, p in enumerate(parts):
            grid[i, : len(p)] = self.index[p]
        x = np.full((len(parts), lanes), _LOW, np.uint64)
        lane, bits = np.arange(lanes), np.uint64(self.bits)
        words, owners = [], []
        for s in range(-(-int(sizes.max(initial=0)) // lanes) - 1, -1, -1):
            live = s * lanes + lane[None, :] < sizes[:, None] if (s + 1) * lanes > least else None
            sym = grid[:, s * lanes : (s + 1) * lanes]
            f, c = self.freq[sym], self.start[sym]
            out = x >= f << np.uint64(63 - self.bits)
            if live is not None:
                out &= live
            if out.any():
                words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                owners.append(np.nonzero(out)[0].astype(np.uint32))
                x >>= out * np.uint64(32)
            q = x // f
            coded = (q << bits) + (x - q * f) + c
            x = coded if live is None else np.where(live, coded, x)
        flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, np.uint32)
        flat = flat[np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=len(parts)))
        out_blocks, at = [], 0
        for b in blocks:
            n = max(1, -(-len(b) // SEGMENT))
            first = ends[at - 1] if at else 0
            offsets = (np.concatenate([[first], ends[at : at + n - 1]]) - first).astype("<u4")
            own = flat[first : ends[at + n - 1]].astype("<u4")
            head = _HEAD.pack(MAGIC, len(b), lanes, self.bits, SEGMENT, len(own), zlib.crc32(b.astype("<u4").tobytes()))
            body = head + offsets.tobytes() + x[at : at + n].astype("<u8").tobytes() + own.tobytes()
            out_blocks.append(body + struct.pack("<I", zlib.crc32(body)))
            at += n
        return out_blocks

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; ValueError when a checksum fails."""
        sizes, states, words, firsts, heads, at = [], [], [], [], [], 0
        for p in payloads:
            if zlib.crc32(p[:-4]) != struct.unpack("<I", p[-4:])[0]:
                raise ValueError("block checksum does not match")
            magic, n, lanes, bits, segment, n_words, crc = _HEAD.unpack_from(p)
            if magic != MAGIC or bits != self.bits or lanes != LANES or segment != SEGMENT:
                raise ValueError("not a block of this format")
            k = max(1, -(-n // segment))
            pos = _HEAD.size
            firsts.append(np.frombuffer(p, "<u4", k, pos).astype(np.int64) + at)
            states.append(np.frombuffer(p, "<u8", k * lanes, pos + 4 * k).reshape(k, lanes))
            words.append(np.frombuffer(p, "<u4", n_words, pos + 4 * k + 8 * k * lanes))
            sizes += [min(segment, n - i * segment) for i in range(k)]
            heads.append((n, k, crc))
            at += n_words
        if not payloads:
            return []
        size, x = np.array(sizes), np.concatenate(states).astype(np.uint64)
        flat, ptr = np.concatenate(words).astype(np.uint64), np.concatenate(firsts)
        least = int(size.min())
        lane, bits, mask = np.arange(LANES), np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        steps = -(-int(size.max(initial=0)) // LANES)
        grid = np.zeros((len(size), steps * LANES), np.uint32)
        for s in range(steps):
            live = s * LANES + lane[None, :] < size[:, None] if (s + 1) * LANES > least else None
            slot = x & mask
            sym = self.symbol[slot]
            nxt = self.freq[sym] * (x >> bits) + slot - self.start[sym]
            x = nxt if live is None else np.where(live, nxt, x)
            grid[:, s * LANES : (s + 1) * LANES] = sym
            need = x < _LOW
            if live is not None:
                need &= live
            if need.any():
                row, col = np.nonzero(need)
                taken = np.bincount(row, minlength=len(ptr))
                words_at = np.arange(len(row)) + np.repeat(ptr - (np.cumsum(taken) - taken), taken)
                x[row, col] = (x[row, col] << np.uint64(32)) | flat[words_at]
                ptr = ptr + taken
        out, row = [], 0
        for n, k, crc in heads:
            ids = self.ids[grid[row : row + k].reshape(-1)[: n]] if k == 1 else self.ids[np.concatenate([grid[row + i, : size[row + i]] for i in range(k)])] if n else np.zeros(0, np.uint32)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("ids do not match their checksum")
            out.append(ids)
            row += k
        return out


def _times(m: list[int], v: int) -> int:
    s, i = 0, 0
    while v:
        if v & 1:
            s ^= m[i]
        v >>= 1
        i += 1
    return s


@lru_cache
def _zeros(power: int) -> list[int]:
    """What 2**power zero bytes do to a CRC-32."""
    if power:
        op = _zeros(power - 1)
        return [_times(op, v) for v in op]
    op = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        op = [_times(op, v) for v in op]  # 2, 4, 8 bits
    return op


def crc32_joined(a: int, b: int, length: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the second's length: a is carried over `length` zero bytes."""
    for power in range(length.bit_length()):
        if length >> power & 1:
            a = _times(_zeros(power), a)
    return a ^ b
