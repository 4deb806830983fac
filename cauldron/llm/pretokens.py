"""Pre-tokens of a byte-level BPE tokenizer as arrays, and the ids or lengths of the distinct ones.

The pre-token pattern is evaluated on code points with numpy: runs of letters,
digits, white space and other characters, with the rules for the space that
joins the next run and for apostrophe endings. Which class a character has is
asked of the tokenizer's own pre-tokenizer, once for each character seen, so
the split is the library's in every case. Distinct pre-tokens (exact, by
Arrow's dictionary) are then encoded by the library itself.

A text that contains an added token's string (special or not) is not split
here; the library encodes it whole. Only tokenizers without a normaliser, with the plain
byte-level pre-tokenizer and no added prefix are accepted.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .columnar import dictionary

_LETTER, _DIGIT, _WHITE, _OTHER = 1, 2, 3, 4
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_loaded: dict[str, "PreTokens"] = {}


def load(path: str) -> "PreTokens":
    """The tokenizer of ``path``, loaded once in each process."""
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def _alphabet() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class PreTokens:
    def __init__(self, path: str, cache_size: int = 1 << 18):
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get(
                "use_regex", True):
            raise ValueError("only byte-level BPE without normaliser and prefix space can be split here")
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.model, self.alphabet = self.tokenizer.model, _alphabet()
        self.cache_size = cache_size
        self.cache: dict[bytes, tuple] = {}  # ids of pre-tokens
        self.lengths: dict[bytes, int] = {}  # for callers that only count
        self.kinds = np.zeros(0x110000, np.uint8)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point; unseen ones are asked of the pre-tokenizer."""
        kinds = self.kinds[points]
        if not kinds.all():
            for c in np.unique(points[kinds == 0]).tolist():
                self.kinds[c] = self._ask(chr(c))
            kinds = self.kinds[points]
        return kinds

    def _ask(self, ch: str) -> int:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if len(split("a" + ch)) == 1:
            return _LETTER
        if len(split("1" + ch)) == 1:
            return _DIGIT
        if len(split("!" + ch)) == 1:
            return _OTHER
        return _WHITE

    def split(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(codes, distinct pre-tokens, n + 1 row offsets) of texts without added tokens."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.empty(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
        kinds = self._kinds(points)
        first = np.zeros(n, bool)  # first of its text
        first[bounds[:-1][lengths > 0]] = True
        last = np.append(first[1:], True)
        change = first.copy()
        change[1:] |= kinds[1:] != kinds[:-1]
        white = kinds == _WHITE
        begin = change.copy()
        # white space before something else in the same text: its last character stands alone, or, as a space, joins
        tail = np.flatnonzero(white & ~last & np.append(~white[1:], False))
        begin[tail] = True
        joins = tail[points[tail] == 32]
        begin[joins + 1] = False
        # apostrophe endings, where the apostrophe begins a token
        quotes = np.flatnonzero((points == 39) & begin)
        if len(quotes):
            row_end = bounds[1:][np.searchsorted(bounds[1:], quotes, side="right")]
            for q, stop in zip(quotes.tolist(), row_end.tolist()):
                after = joined[q + 1:min(q + 3, stop)]
                end = next((e for e in _ENDINGS if after.startswith(e)), None)
                if end:
                    begin[q + 1] = False
                    if q + 1 + len(end) < stop:
                        begin[q + 1 + len(end)] = True
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.flatnonzero(begin)
        sizes = np.add.reduceat(width, at)
        codes, distinct = dictionary(np.frombuffer(joined.encode("utf-8"), np.uint8), at, sizes)
        return codes, distinct, np.searchsorted(at, bounds)

    def encode(self, distinct: list[bytes]) -> list[tuple]:
        """The ids of pre-tokens; misses of the cache go to the library's model."""
        cache, found = self.cache, []
        for d in distinct:
            ids = cache.get(d)
            if ids is None:
                if len(cache) >= self.cache_size:
                    cache.clear()
                ids = cache[d] = self.merge(d)
            found.append(ids)
        return found

    def merge(self, token: bytes) -> tuple:
        """The ids of one pre-token, by the library's model."""
        return tuple([t.id for t in self.model.tokenize(token.decode("latin-1").translate(self.alphabet))])

    def has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as the library gives them without special tokens of its own."""
        plain = ["" if self.has_added(t) else t for t in texts]
        codes, distinct, rows = self.split(plain)
        per = self.encode(distinct.to_pylist())
        sizes = np.fromiter(map(len, per), np.int64, len(per))
        flat = np.fromiter((i for ids in per for i in ids), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        cuts = np.concatenate([[0], ends])[rows]
        done = [out[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        for i, t in enumerate(texts):
            if plain[i] != t:
                done[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return done
