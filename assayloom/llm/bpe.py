"""Byte-level BPE ids of many texts: words are cut with array operations and each distinct word is merged once.

Words are those of the pattern that files of this kind are made with: contractions, letters, digits or other signs with a space
before them, and white space.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import tiktoken
from tokenizers import Tokenizer


#: Texts whose code points all lie below this are cut here; others go through the tokenizer itself.
PLAIN = 0x250
LETTER, DIGIT, SPACE, OTHER = range(4)
#: Distinct words a process remembers; past that it starts over, which costs time only.
REMEMBERED = 150_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kinds() -> np.ndarray:
    out = np.full(PLAIN, OTHER, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACE
    return out


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins that vocabulary files of this kind use for bytes: printable Latin-1 as it is, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """The ids of words, as bytes; a word asked for the first time is merged then."""

    def __init__(self, merge: Callable[[str], list[int]], code: str):
        self.merge, self.code = merge, code

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array(self.code, self.merge(word)).tobytes()
        return ids


class Bpe:
    _have: dict[str, Bpe] = {}

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        #: The strings of added tokens, which the tokenizer finds before it cuts words.
        self.added = [t["content"] for t in stored.get("added_tokens", ())]
        special = {t["content"] for t in stored.get("added_tokens", ())}
        to_byte = _bytes_of()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}
        merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kind = np.uint16 if self.slow.get_vocab_size() <= 1 << 16 else np.uint32
        self.known = _Known(merge, np.dtype(self.kind).char)
        self.kinds = _kinds()

    @classmethod
    def of(cls, path: str | None = None) -> Bpe:
        path = path or default_path()
        if path not in cls._have:
            cls._have[path] = cls(path)
        return cls._have[path]

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start; ``first`` marks each text's first code point."""
        kind, n = self.kinds[points], len(points)
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last white space before other text stands alone, or joins that text if it is a plain space.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        quote = np.flatnonzero((points[: n - 1] == 0x27) & start[: n - 1] & ~first[1:])
        after = points[quote + 1]
        one = quote[np.isin(after, [ord(c) for c in "stmd"])]
        start[one + 1] = False
        start[one[one + 2 < n] + 2] = True
        two = quote[quote + 2 < n]
        two = two[~first[two + 2]]
        pair = points[two + 1].astype(np.int64) << 16 | points[two + 2]
        two = two[np.isin(pair, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])]
        start[two + 1] = False
        start[two[two + 3 < n] + 3] = True
        return start

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, no special ones added."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        whole = [i for i, p in enumerate(points) if len(p)]
        odd = [i for i in whole if points[i].max() >= PLAIN or any(t in texts[i] for t in self.added)]
        plain = sorted(set(whole) - set(odd))
        for i in odd:
            out[i] = np.asarray(self.slow.encode(texts[i], add_special_tokens=False).ids, self.kind)
        if plain:
            sizes = np.array([len(points[i]) for i in plain])
            line, begin = np.concatenate([points[i] for i in plain]), np.concatenate(([0], np.cumsum(sizes)))
            first = np.zeros(len(line), bool)
            first[begin[:-1]] = True
            starts = np.flatnonzero(self._starts(line, first))
            ids, at = self._ids("".join(texts[i] for i in plain), starts)
            cuts = np.concatenate((at, [len(ids)]))[np.searchsorted(starts, begin)]
            for k, i in enumerate(plain):
                out[i] = ids[cuts[k] : cuts[k + 1]]
        return out

    def _ids(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each word's ids start."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        begins = starts.tolist()
        parts = [self.known[text[a:b]] for a, b in zip(begins, [*begins[1:], len(text)], strict=True)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(parts), self.kind), np.cumsum(sizes) - sizes
