"""Word shingles of whole texts as sets of 64-bit hashes, in numpy, a batch at a time.

Words are runs of ASCII letters (case folded), digits and non-ASCII characters; a shingle is
five consecutive words, and a text of one to four words is one shingle.  Sets are compared
as sets of hashes: two different shingles of a pair of documents share a hash with a
probability of about 1e-13.
"""

import numpy as np

SHINGLE = 5

_codes = np.arange(256)
IN_WORD = (_codes >= 128) | np.isin(_codes, [ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
FOLDED = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes of all words in a row, first place of each word in it, number of its text)."""
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = np.flatnonzero(IN_WORD.take(data))
    if not inside.size:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(inside[1:] - inside[:-1] > 1) + 1])
    ends = np.cumsum([len(r) for r in raw])
    return FOLDED.take(data.take(inside)), first, np.searchsorted(ends, inside.take(first), side="right")


def hashes_of(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of every word of ``word_bytes``."""
    if not first.size:
        return np.zeros(0, np.uint64)
    sizes = np.diff(first, append=data.size)
    place = np.arange(data.size) - np.repeat(first, sizes)
    codes = data.astype(np.uint64)
    codes += np.uint64(1)
    codes *= powers(BASE, int(sizes.max())).take(place)
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text)."""
    data, first, owner = word_bytes(texts)
    return hashes_of(data, first), owner


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of text after text, how many each text has)."""
    words, owner = word_hashes(texts)
    per_text = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    parts, owners = [], []
    if words.size >= SHINGLE:
        together = words[:words.size - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            together = together * STEP + words[k:words.size - SHINGLE + 1 + k]
        whole = owner[SHINGLE - 1:] == owner[:words.size - SHINGLE + 1]
        parts.append(mix(together[whole]))
        owners.append(owner[:words.size - SHINGLE + 1][whole])
    for i in np.flatnonzero((per_text > 0) & (per_text < SHINGLE)):
        h = words[first[i]:first[i] + 1]
        for k in range(1, per_text[i]):
            h = h * STEP + words[first[i] + k]
        parts.append(mix(h + np.uint64(per_text[i])))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(texts))
