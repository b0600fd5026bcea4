"""Token ids of whole texts by a public tokenizer file, with a cache of white-space chunks.

The tokenizer drops white space and never joins text across it, so a text's ids are its chunks'
ids in order. Chunks repeat; each new one is encoded once per task and a cache of bounded bytes keeps
it. The task frees the cache when it ends (:func:`release`).
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

DEFAULT_TOKENIZER = "word_bpe_49k.json"
CACHE_BYTES = 48 << 20
#: What an entry takes beside its characters and ids.
_ENTRY_BYTES = 190

# Characters whose lower case, composition and class are the same in every Unicode version.
_PLAIN = re.compile(r"[^\t\n\r -~¡-©«-±´¶-¸»¿-ÿŒœ]")
_GAPS = re.compile(r"[ \t\n\r]+")
# The tokenizer's own pieces, for plain characters in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-zß-öø-ÿœ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies, keyed by byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class _Chunks(dict):
    """Packed ids by chunk; a missing chunk is encoded and kept until the cache is full, when it starts anew."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.held = 0

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.search(chunk) or "<|" in chunk:
            ids = self.packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        else:
            pieces = _PIECES.findall(chunk.lower())
            if len(pieces) == 1 and pieces[0] == chunk:
                ids = self.piece(chunk)
            else:
                ids = b"".join(map(self.__getitem__, pieces))
        size = _ENTRY_BYTES + len(chunk) + len(ids)
        if self.held + size > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.held += size
        self[chunk] = ids
        return ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        units = piece
        if not piece.isascii():
            units = piece.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(units)])


@lru_cache(maxsize=2)
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def release() -> None:
    """Free all cached chunks and the tokenizers."""
    _chunks.cache_clear()


def packed_ids(text: str | None, path: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit numbers; null is empty."""
    if not text:
        return b""
    chunks = _chunks(path)
    if _PLAIN.search(text) or "<|" in text:
        return b"".join(map(chunks.__getitem__, filter(None, _GAPS.split(text))))
    return b"".join(map(chunks.__getitem__, text.lower().split()))


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
