"""Token ids of byte-level BPE vocabularies, as bytes of little-endian 32-bit ids.

The vocabulary is a ``tokenizers`` JSON file.  Its ids are produced by the same
merges in tiktoken's encoder, about four times as fast, behind a cache of
space-separated pieces.  A text is cut before each single space or line feed;
pre-tokens never cross such a place, so the pieces' ids joined are the text's
ids.  Texts with two white-space characters in a row (where this doesn't hold)
are encoded whole, and texts that hold one of the file's special tokens go
through ``tokenizers`` itself.

``encode_all`` does this for a column of texts: Arrow cuts them and finds the
distinct pieces, these are encoded in one call, and NumPy deals out their ids.
"""

from __future__ import annotations

import json
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: End-of-document id that the corpus operators append.
END = 2
#: Pieces kept per worker process before the cache is emptied.
CACHE_PIECES = 100_000
#: Bytes of texts that ``encode_all`` is best given at once: few repeats are encoded
#: again, and a worker holds some five times as much.
COLUMN_BYTES = 1 << 23
#: Longer texts are encoded one by one (Arrow's offsets end at 2 GB).
_LONG = 1 << 28
#: White space but for space and line feed, as Python's ``isspace``.
_SPACE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for a vocabulary file."""
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Uneven(Exception):
    """White space next to white space."""


class _Pieces(dict):
    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            raise _Uneven
        own = piece
        if piece[0] == "\n":
            if len(piece) == 1 or piece[1].isspace():
                raise _Uneven
        elif piece[0].isspace():
            raise _Uneven
        else:
            own = self.before + piece
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = array("I", self.encode(own)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.special, vocab = [t["content"] for t in held["added_tokens"]], held["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self.fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.fast.encode_ordinary, " ")

    @cached_property
    def exact(self):
        """The file in ``tokenizers``, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each (null: none)."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        get = self.pieces.__getitem__
        try:
            if first[:1].isspace() or (not first and text[0] == "\n"):
                raise _Uneven
            head = array("I", self.fast.encode_ordinary(first)).tobytes() if first else b""
            return head + b"".join(map(get, rest))
        except _Uneven:
            return array("I", self.fast.encode_ordinary(text)).tobytes()

    def _whole(self, text: str) -> np.ndarray:
        """The ids of a text that isn't cut."""
        special = any(s in text for s in self.special)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids if special else self.fast.encode_ordinary(text), np.uint32)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has (null: 0)."""
        texts = pc.fill_null(texts, "")
        if texts.nbytes > _LONG or not len(texts):
            each = [np.frombuffer(self.encode(t.as_py()), np.uint32) for t in texts]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
        texts = texts.cast(pa.string())
        whole = pc.match_substring_regex(texts, rf"\A[\n{_SPACE}]")
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first, heads = cut.offsets.to_numpy()[:-1], pc.list_element(cut, 0)
        cut = pc.list_flatten(cut).dictionary_encode()
        pieces, piece = cut.dictionary, cut.indices.to_numpy()
        uneven = pc.match_substring_regex(pieces, rf"\A\n?(?:[{_SPACE}]|\z)")
        pieces = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(" ", pieces, ""))
        pieces = pc.if_else(uneven, "", pieces)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), "")[0].as_py()
        pool = [np.array(self.fast.encode_ordinary(joined), np.uint32)]
        # the ids that end in a piece's bytes are the piece's
        token_ends, ends = (np.cumsum(x, dtype=np.int64) for x in (self.token_bytes[pool[0]], pc.binary_length(pieces).to_numpy()))
        stops = np.searchsorted(token_ends, ends, side="right").astype(np.int32)
        counts = np.diff(stops, prepend=np.int32(0))
        starts, n = (stops - counts)[piece], counts[piece]
        # texts that aren't cut, and first pieces, which no space precedes, have ids of their own
        bad = uneven.to_numpy(zero_copy_only=False)[piece]
        bad[first] = False
        whole = whole.to_numpy(zero_copy_only=False) | np.logical_or.reduceat(bad, first)
        n[np.repeat(whole, np.diff(first, append=len(piece)))] = 0
        at = len(pool[0])
        for k, (place, alone, head) in enumerate(zip(first.tolist(), whole.tolist(), heads.to_pylist(), strict=True)):
            own = self._whole(texts[k].as_py()) if alone else np.array(self.fast.encode_ordinary(head), np.uint32)
            pool.append(own)
            starts[place], n[place] = at, len(own)
            at += len(own)
        starts -= np.cumsum(n, dtype=np.int32) - n
        take = np.repeat(starts, n)
        take += np.arange(len(take), dtype=np.int32)
        return np.concatenate(pool)[take], np.add.reduceat(n, first, dtype=np.int64)
