"""Word and shingle hashes of whole texts.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case: just
what ``bytes.lower().split()`` gives. A word's hash is XXH3 to 64 bits; a shingle's
hash mixes the hashes of its words in order. Where a decision must be certain,
``common`` compares the words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
from xxhash import xxh3_64_digest

from quern.llm.common import mix64, random_u64

#: Bytes that are cut into words at once; a longer text goes through in pieces cut at spaces.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def pieces(data: np.ndarray):
    """The words of a text of any length, list by list."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            cut = np.flatnonzero(_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word fills the block
                while end < len(data) and not _SPACE[data[end]]:
                    step = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
                    end = end + int(step[0]) if len(step) else min(len(data), end + BLOCK)
        yield data[at:end].tobytes().lower().split()
        at = end


def words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text."""
    return np.frombuffer(b"".join(b"".join(map(xxh3_64_digest, piece)) for piece in pieces(data)), np.uint64)


def words_and_key(data: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Hashes of the words, and 128 bits of BLAKE2b of the words themselves."""
    key, out = hashlib.blake2b(digest_size=16), []
    for piece in pieces(data):
        if piece:
            out.append(b"".join(map(xxh3_64_digest, piece)))
            key.update(b" ".join(piece))
            key.update(b" ")
    return np.frombuffer(b"".join(out), np.uint64), key.digest()


def starts(data: np.ndarray) -> np.ndarray:
    """Where the words begin (bytes)."""
    gap = _SPACE[data]
    return np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))


_PLACE = random_u64(13, 64) | np.uint64(1)


def shingle(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if there are fewer, none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += mix64(hashes[k : k + n] * _PLACE[k])
        out *= _PLACE[k]
    return mix64(out)


def common(a: np.ndarray, b: np.ndarray, width: int) -> tuple[int, int, int]:
    """Sizes of two texts' shingle sets and of their intersection, from the words themselves.

    Words are numbered by a dictionary of the pair; runs of one word more are numbered
    by sorting pairs of numbers, so nothing is hashed to a fixed size.
    """
    number: dict[bytes, int] = {}
    one, two = (np.fromiter((number.setdefault(w, len(number)) for piece in pieces(x) for w in piece), np.int64) for x in (a, b))
    if min(len(one), len(two)) < width:
        sizes = [min(len(x), 1) if len(x) < width else len(_runs(x, len(number), width)) for x in (one, two)]
        return *sizes, int(len(one) == len(two) > 0 and bool((one == two).all()))
    # a number of its own between the texts; runs that hold it are left out
    ids = _runs(np.concatenate((one, [len(number)], two)), len(number) + 1, width, all_=True)
    left, right = np.unique(ids[: len(one) - width + 1]), np.unique(ids[len(one) + 1 :])
    return len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))


def _runs(ids: np.ndarray, many: int, width: int, all_: bool = False) -> np.ndarray:
    """Numbers of the runs of ``width`` ids, equal for equal runs; without ``all_`` each once."""
    run = ids
    for k in range(1, width):
        kinds, run = np.unique(run[:-1] * many + ids[k : k + len(run) - 1], return_inverse=True)
    return run if all_ else np.unique(run)
