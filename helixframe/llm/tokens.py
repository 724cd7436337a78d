"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file's path is a parameter. Ids are those of the ``tokenizers`` library for the same file: a text is cut at
the file's added tokens, each of which has its own id, and the stretches between them are encoded one by one. They are
found by ``tiktoken`` from the file's own vocabulary, with a bounded table of words met before, which takes a fifth of the
time.
"""

from __future__ import annotations

import array
import functools
import json
import re

#: Fixed value: the pre-splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id put after each document.
END_ID = 1
_SPACED = re.compile(r"\s ")


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers; every machine that Spark runs on is little-endian."""
    return array.array("I", ids).tobytes()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Printable bytes stand for themselves in the file, the others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _added(token: dict) -> str:
    """The pattern of an added token, with the white space that it takes in and the word bounds that it asks for."""
    body = f"({re.escape(token['content'])})"
    body = rf"(?<!\w){body}(?!\w)" if token.get("single_word") else body
    return (r"\s*" if token.get("lstrip") else "") + body + (r"\s*" if token.get("rstrip") else "")


class Encoder(dict):
    """Texts to little-endian unsigned 32-bit ids; the dict holds the ids of a blank with the word after it."""

    def __init__(self, path: str, limit: int = 300_000):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = model.get("added_tokens", [])
        known = {t["content"] for t in added}
        byte_of = _byte_of()
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in known}
        self.added = {t["content"]: _packed([t["id"]]) for t in added}
        self.cut = re.compile("|".join(map(_added, sorted(added, key=lambda t: -len(t["content"]))))) if added else None
        self.largest = max([*model["model"]["vocab"].values(), *(t["id"] for t in added)])
        self.limit, self.encode = limit, tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = _packed(self.encode(" " + word))
        if len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of the whole text."""
        if not any(map(text.__contains__, self.added)):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), self.added[m[m.lastindex]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens.

        The pattern never joins a blank to a character before it that isn't white space, so a text splits at such blanks
        without changing an id.
        """
        if not text:
            return b""
        if _SPACED.search(text):
            return _packed(self.encode(text))
        first, *rest = text.split(" ")
        head = _packed(self.encode(first)) if first else b""
        return head + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


END = _packed([END_ID])


def document_ids(text: str | None, path: str) -> bytes:
    """The ids of a document (null: empty) and the end id, as little-endian unsigned 32-bit numbers."""
    return encoder(path).ids(text or "") + END
