"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

# Fixed values of the splitmix64 finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def powers(base: int, count: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    done, step = 1, np.full(1, base, np.uint64)
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * step
        step = step * step
        done *= 2
    return out


#: An odd factor for each place of a shingle.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)

#: Bytes that are hashed at a time.
CHUNK = 1 << 17
_FACTOR = 0xD1342543DE82EF95
_UP, _DOWN = powers(_FACTOR, CHUNK), powers(pow(_FACTOR, -1, 1 << 64), CHUNK)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mixed(np.arange(2000, 2256, dtype=np.uint64))
_VALUE[65:91] = _VALUE[97:123]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of at most ``CHUNK`` bytes: a polynomial of its lower-cased bytes, by prefix sums."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _UP[: len(data)], out=total[1:])
    return start, mixed((total[end] - total[start]) * _DOWN[start])


def _long_text(text: bytes) -> np.ndarray:
    """Hashes of a longer text's words; it is cut at white space, and a word without any is summed up in parts."""
    data, at, out = np.frombuffer(text, np.uint8), 0, []
    while at < len(data):
        piece = data[at : at + CHUNK]
        if at + CHUNK < len(data):
            blanks = np.flatnonzero(_SPACE[piece])
            if not len(blanks):
                value, k = 0, 0
                while at < len(data):
                    piece = data[at : at + CHUNK]
                    blanks = np.flatnonzero(_SPACE[piece])
                    own = piece[: blanks[0]] if len(blanks) else piece
                    value += int((_VALUE[own] * _UP[: len(own)]).sum()) * pow(_FACTOR, k * CHUNK, 1 << 64)
                    k, at = k + 1, at + len(own)
                    if len(blanks):
                        break
                out.append(mixed(np.full(1, value % (1 << 64), np.uint64)))
                continue
            piece = piece[: blanks[-1] + 1]
        out.append(_words(piece)[1])
        at += len(piece)
    return np.concatenate(out)


class Shingler:
    """Maps texts (bytes) to sets. Words are split at ASCII white space and A-Z are lower-cased. A text with
    fewer words than a shingle is one shingle; one without words has none."""

    def __init__(self, size: int = 5) -> None:
        self.size = size

    def set_of(self, text: bytes | None) -> np.ndarray:
        return self.sets([text])[0]

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The set of each text; short texts are hashed together."""
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            if texts[k] and len(texts[k]) >= CHUNK:
                out.append(self._of_words(_long_text(texts[k])))
                k += 1
                continue
            group, size = [], 0
            while k < len(texts) and size + len(texts[k] or b"") < CHUNK:
                group.append(texts[k] or b"")
                size += len(group[-1]) + 1
                k += 1
            first = np.cumsum([0, *(len(t) + 1 for t in group)])
            start, words = _words(np.frombuffer(b"\n".join(group), np.uint8))
            cut = np.searchsorted(start, first)
            whole = self._hashes(words, self.size) if len(words) >= self.size else None
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out.append(np.unique(whole[x : y - self.size + 1]) if y - x >= self.size else self._of_words(words[x:y]))
        return out

    def _hashes(self, w: np.ndarray, k: int) -> np.ndarray:
        h = w[: len(w) - k + 1] * PLACES[0]
        for i in range(1, k):
            h = h + w[i : len(w) - k + 1 + i] * PLACES[i]
        return mixed(h + PLACES[40 + k % 20])

    def _of_words(self, w: np.ndarray) -> np.ndarray:
        return np.unique(self._hashes(w, min(len(w), self.size))) if len(w) else np.empty(0, np.uint64)


def set_key(h: np.ndarray) -> int:
    """One signed 64-bit name of a set."""
    total = np.add.reduce(mixed(h ^ PLACES[39]), keepdims=True) + PLACES[38] * np.full(1, len(h), np.uint64)
    return int(mixed(total).view(np.int64)[0])
