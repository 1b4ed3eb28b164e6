"""Token ids by the tokenizers library, with a bounded cache of pieces between white space."""

from __future__ import annotations

import os
import re

import numpy as np

#: Unicode White_Space, as the vocabularies' own patterns mean \s (fixed values).
_WS = "\t-\r \x85\xa0  -     　"
#: A piece starts where the pattern of the vocabulary must start a new match, so that pieces can be encoded apart.
_BYTE_LEVEL = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_WORD_LEVEL = re.compile(f"[^{_WS}]+")
#: White space to str.split() that isn't Unicode White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARK = "\x01"
_OPEN: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes whole texts piece by piece; equal to encoding the text at once, because no match of the vocabulary's
    pattern runs from a non-space character over white space into the next piece. A text that holds an added token
    (such as <|endoftext|>) is encoded at once."""

    def __init__(self, path: str, most: int = 1_200_000, longest: int = 12):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.most, self.longest = most, longest  # of the cache: pieces, and characters of a piece
        self.cache: dict[str, bytes] = {}
        self.byte_level = self.tok.normalizer is None
        self.pattern = _BYTE_LEVEL if self.byte_level else _WORD_LEVEL
        if self.byte_level:
            size = self.tok.get_vocab_size()
            self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        else:
            self.mark = self._ids(_MARK)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encode_apart(self, new: list[str]) -> dict[str, bytes]:
        """Ids of each distinct piece, from one call over all of them where their borders can be seen in the ids."""
        if self.byte_level:
            joined = [p for p in new if len(p) > 1 and p[0] == " " and not p[1].isspace()]
            alone = [p for p in new if not (len(p) > 1 and p[0] == " " and not p[1].isspace())]
            ids = self._ids("".join(joined))
            at = np.flatnonzero(self.opens[ids]) if len(ids) else np.zeros(0, int)
            step = 0
        else:
            joined = [p for p in new if _MARK not in p]
            alone = [p for p in new if _MARK in p]
            ids = self._ids(f" {_MARK} ".join(["", *joined]))
            step = len(self.mark)
            at = np.flatnonzero(ids == self.mark[0]) if step == 1 else np.zeros(0, int)
        if len(at) != len(joined):
            alone, joined = new, []
        raw = ids.tobytes()
        ends = [*at[1:].tolist(), len(ids)]
        out = {p: raw[4 * (a + step) : 4 * b] for p, a, b in zip(joined, at.tolist(), ends)}
        for p in alone:
            out[p] = self._ids(p).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self.added):
            return self._ids(text).tobytes()
        if self.byte_level or _SEPARATORS.search(text):
            pieces = self.pattern.findall(text)
        else:
            pieces = text.split()
        cache = self.cache
        found = [cache.get(p) for p in pieces]
        if None in found:
            fresh = self._encode_apart(list({p for p, f in zip(pieces, found) if f is None}))
            found = [fresh[p] if f is None else f for p, f in zip(pieces, found)]
            if len(cache) < self.most:
                cache.update((p, ids) for p, ids in fresh.items() if len(p) <= self.longest)
        return b"".join(found)


def encoder(path: str) -> PieceEncoder:
    if path not in _OPEN:
        _OPEN[path] = PieceEncoder(path)
    return _OPEN[path]


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary; resolved where it is called, on the worker."""
    import public_tokenizers

    return public_tokenizers.path(name)
