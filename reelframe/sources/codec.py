"""Frame payloads: runs of changed pixels packed into code words, 16 and 32 bits."""

from __future__ import annotations

import zlib

import numpy as np

#: Fixed values of the format: op codes, and the largest count of a code word.
SKIP, DUP, COPY, DONE = 0, 1, 2, 3
MAX_22, MAX_14, MAX_30, MAX_SKIP_AFTER = 0x3FFFFF, 0x3FFF, 0x3FFFFFFF, 255
PAGE = 16384


def generic_word(op: int, num: int, value: int = 0) -> int:
    return op << 30 | (value & MAX_14) << 16 | num & 0xFFFF


def word32(op: int, num: int, skip_after: int = 0) -> int:
    return num << 10 | op << 8 | skip_after


def word16(op: int, num: int, px: int = 0) -> int:
    return op << 30 | num if op == SKIP else op << 30 | num << 16 | px


def segments(old: np.ndarray, new: np.ndarray) -> list[tuple[int, int, int]]:
    """(op, start, num) of the changed pixels: equal neighbours of an island are a DUP, the others COPYs."""
    at = np.flatnonzero(old != new)
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) != 1) | (new[at][1:] != new[at][:-1])) + 1
    starts, ends = np.r_[0, breaks], np.r_[breaks, len(at)]
    out: list[tuple[int, int, int]] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        start, num = int(at[a]), b - a
        if num >= 2:
            out.append((DUP, start, num))
        elif out and out[-1][0] == COPY and out[-1][1] + out[-1][2] == start:
            out[-1] = (COPY, out[-1][1], out[-1][2] + 1)
        else:
            out.append((COPY, start, 1))
    return out


def _chunks(num: int, most: int, op: int):
    """Counts of at most `most`; a DUP never leaves a rest of one."""
    while num:
        n = min(num, most)
        if op == DUP and num - n == 1:
            n -= 1
        num -= n
        yield n, num == 0


def encode32(old: np.ndarray, new: np.ndarray) -> bytes:
    words: list[int] = []
    runs = segments(old, new)
    at = 0
    skip = runs[0][1] if runs else len(new)
    words += [word32(SKIP, n) for n, _ in _chunks(skip, MAX_22, SKIP)]
    for k, (op, start, num) in enumerate(runs):
        after = (runs[k + 1][1] if k + 1 < len(runs) else len(new)) - start - num
        fold, at = min(after, MAX_SKIP_AFTER), start
        for n, last in _chunks(num, MAX_22, op):
            words.append(word32(op, n, fold if last else 0))
            words += [int(new[at])] if op == DUP else new[at : at + n].tolist()
            at += n
        words += [word32(SKIP, n) for n, _ in _chunks(after - fold, MAX_22, SKIP)]
    return np.array([*words, word32(DONE, 0), 0], "<u4").tobytes()


def decode32(data: bytes, frame: np.ndarray) -> None:
    words = np.frombuffer(data, "<u4")
    i = at = 0
    while True:
        w = int(words[i])
        op, num = w >> 8 & 3, w >> 10
        i += 1
        if op == DONE:
            return
        if op == DUP:
            frame[at : at + num] = words[i]
            i += 1
        elif op == COPY:
            frame[at : at + num] = words[i : i + num]
            i += num
        at += num + (w & 255)


def encode16(old: np.ndarray, new: np.ndarray) -> bytes:
    words: list[int] = []
    at = 0
    for op, start, num in segments(old, new):
        words += [word16(SKIP, n) for n, _ in _chunks(start - at, MAX_30, SKIP)]
        at = start
        for n, _ in _chunks(num, MAX_14, op):
            if op == DUP:
                words.append(word16(DUP, n, int(new[at])))
            else:
                px = new[at : at + n]
                first = at % 2 == 1 or n == 1  # then pairs are word aligned
                words.append(word16(COPY, n, int(px[0]) if first else 0))
                rest = px[1:] if first else px
                rest = np.append(rest, np.zeros(len(rest) % 2, rest.dtype)).astype("<u2")
                words += rest.view("<u4").tolist()
            at += n
    words += [word16(SKIP, n) for n, _ in _chunks(len(new) - at, MAX_30, SKIP)]
    return np.array([*words, DONE << 30], "<u4").tobytes()


def decode16(data: bytes, frame: np.ndarray) -> None:
    words = np.frombuffer(data, "<u4")
    i = at = 0
    while True:
        w = int(words[i])
        op, num, px = w >> 30, w >> 16 & MAX_14, w & 0xFFFF
        i += 1
        if op == DONE:
            return
        if op == SKIP:
            num = w & MAX_30
        elif op == DUP:
            frame[at : at + num] = px
        else:
            first = at % 2 == 1 or num == 1
            if first:
                frame[at] = px
            rest = num - first
            pairs = words[i : i + (rest + 1) // 2]
            frame[at + first : at + num] = pairs.view("<u2")[:rest]
            i += len(pairs)
        at += num


def pixel_type(bpp: int) -> str:
    return "<u2" if bpp == 16 else "<u4"


def frame_bytes(px: np.ndarray, bpp: int) -> bytes:
    """The pixels, and one zero pixel more if they are odd."""
    return np.append(px, np.zeros(len(px) % 2, px.dtype)).astype(pixel_type(bpp)).tobytes()


def adler(px: np.ndarray, bpp: int) -> int:
    """Adler-32 with seed 0; 0 is given as 0xFFFFFFFF."""
    return zlib.adler32(frame_bytes(px, bpp), 0) or 0xFFFFFFFF


def encode_frame(old: np.ndarray | None, new: np.ndarray, bpp: int, key: bool) -> tuple[str, bytes]:
    """("key" | "nop" | "delta", payload). All pixels changed makes a key frame."""
    if key or old is None or (old != new).all():
        return "key", frame_bytes(new, bpp)
    if (old == new).all():
        return "nop", b""
    return "delta", (encode16 if bpp == 16 else encode32)(old, new)


def apply_frame(frame: np.ndarray, data: bytes, bpp: int, is_key: bool) -> None:
    """Change a framebuffer by a frame's payload."""
    if is_key:
        frame[:] = np.frombuffer(data, pixel_type(bpp))[: len(frame)]
    else:
        (decode16 if bpp == 16 else decode32)(data, frame)
