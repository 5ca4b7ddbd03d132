"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken

SPECIAL = ("<|endoftext|>", 50256)
# A space joins what follows it; any other run of white space stands alone but for its last character.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
# White space to Python's expressions and not to the vocabulary's, or the other way round.
ODD = re.compile("[\x1c-\x1f\x85]")


class _Chunks(dict):
    """Ids of chunks already seen, little-endian 32-bit; forgets all of them beyond ``limit``."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[chunk] = array("I", self.encode(chunk)).tobytes()
        return ids


class BytePairs:
    """Ids as the tokenizers library gives them for ``<name>.json``, add_special_tokens=False.

    Reads the same vocabulary as ranks (``<name>.tiktoken``), which encodes some
    ten times as fast: white-space separated chunks are looked up, new ones are
    encoded. Ids do not depend on what was seen before.
    """

    def __init__(self, name: str = "byte_bpe_50k.json", limit: int = 400_000):
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = core._core_bpe.encode_ordinary if hasattr(core, "_core_bpe") else core.encode_ordinary
        self.chunks = _Chunks(self.whole, limit)

    def _plain(self, text: str) -> bytes:
        if ODD.search(text):
            return array("I", self.whole(text)).tobytes()
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        mark, number = SPECIAL
        if mark not in text:
            return self._plain(text)
        return array("I", [number]).tobytes().join(map(self._plain, text.split(mark)))


@lru_cache(maxsize=2)
def byte_pairs(name: str = "byte_bpe_50k.json") -> BytePairs:
    return BytePairs(name)
