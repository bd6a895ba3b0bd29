"""Vectorised hashing of the words of many texts, for use inside tasks."""

import numpy as np

#: Texts are hashed in groups of about so many bytes; a longer text makes a group alone.
GROUP_BYTES = 2 * 2**20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def powers(base, count):
    """base^0 .. base^(count-1) modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        row = np.full(max(count, 4096), base, np.uint64)
        row[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(row)
    return known[:count]


def mix(x):
    """Spreads the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(items, size):
    """Lists of consecutive items of about GROUP_BYTES, as ``size`` measures them."""
    held, total = [], 0
    for item in items:
        n = size(item)
        if held and total + n > GROUP_BYTES:
            yield held
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield held


def word_hashes(texts, lower=False):
    """(hash, text index, first byte, end byte) of every word of the given byte strings.

    Words are runs without ASCII white space. Byte positions count from the start of the
    texts joined by one line feed. The hash is that of the word's bytes.
    """
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, end = edge[0::2], edge[1::2]
    data = _LOWER[joined] if lower else joined
    n = len(joined)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    hashes = (sums[end] - sums[first]) * powers(INVERSE, n)[first]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text = np.searchsorted(np.cumsum(lengths), first, side="right")
    return mix(hashes), text, first, end


def gram_hashes(hashes, n):
    """Hash of every run of ``n`` consecutive word hashes, one less than ``n`` shorter."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total = total * BASE + hashes[j : j + count]
    return mix(total)


def shingle_sets(texts, n):
    """Sorted distinct hashes of the ``n``-word shingles of each text, lower-cased (A-Z).

    A text of fewer words has one shingle of all its words, one without words none.
    """
    hashes, text, _, _ = word_hashes(texts, lower=True)
    grams = gram_hashes(hashes, n)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        else:
            sets.append(gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets
