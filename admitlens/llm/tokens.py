"""Token ids of whole texts with a given tokenizer file, cut into pieces."""

from __future__ import annotations

import os
import unicodedata
import zlib
from functools import cache
from struct import pack

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

END_ID = 1
_TAILS = frozenset(b".,;:!?")


class WordTokens(dict):
    """Ids of a blank-separated word as little-endian 32-bit bytes, remembered up to a number of words.

    Meant for tokenizers that drop white space and lower-case, whose tokens never reach beyond a word. A word of
    plain Latin letters goes to the model at once; its closing punctuation is a word of its own; every other word takes the
    tokenizer's whole way.
    """

    limit = 600_000

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, {}

    def _letter(self, ch: str) -> str | None:
        """The character as the model spells it, or None if it isn't a plain lower-case Latin letter."""
        if ch not in self.letters:
            plain = ch.isalpha() and ch.lower() == ch and ord(ch) < 0x180 and unicodedata.normalize("NFC", ch) == ch
            self.letters[ch] = self.tokenizer.pre_tokenizer.pre_tokenize_str(ch)[0][0] if plain else None
        return self.letters[ch]

    def _encode(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in _TAILS and word[-2:-1].isalnum():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode("utf-8", "surrogatepass")
        spelled = [text] if word.isalpha() else [self._letter(ch) for ch in text]  # of bytes: A-Z and a-z
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if None in spelled else [t.id for t in self.model.tokenize("".join(spelled))]
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self._encode(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" in data:  # a special token may be spelled out
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, data.lower().split()))


@cache
def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that what it remembers serves all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path)


def pieces_udf(path: str, length: int, with_ids: bool):
    """text -> arrays (start, length, ids_crc32, ids or null) of its pieces; the text's ids end with END_ID."""
    fields = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("start", "length", "ids_crc32")]
    kind = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.BinaryType()))])

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.DataFrame:
        words, out = word_tokens(path), []
        for text in texts:
            ids = words.of_text(text) + END_ID.to_bytes(4, "little")
            parts = [ids[at : at + 4 * length] for at in range(0, len(ids), 4 * length)]
            out.append(([length * k for k in range(len(parts))], [len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts], parts if with_ids else None))
        return pd.DataFrame(out, columns=["start", "length", "ids_crc32", "ids"])

    return cut
