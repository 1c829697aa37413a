"""BPE encoding and decoding (operator 9).

Encoding is the backtracking form of byte-pair encoding: one Aho-Corasick pass
over a word finds the longest vocabulary token that starts at every position;
the encoder then walks from the left, takes the longest token that is
*compatible* with the one before it, tries shorter prefixes of that token when
it isn't, and steps back one token when none fits. A pair is compatible when
merging the two tokens' text by rank would give exactly these two tokens; that
is decided on the merge table alone. Every position is given up at most once,
so the work is linear in the word's length, and the result equals that of
applying the merges in order. (The automaton reports all tokens that end at a
position, at most as many as the longest token has characters, so time is linear
in the text for a vocabulary.)

White space, letters, numbers, lower case and normal form differ between
versions of Unicode. Up to U+024F Python and the library agree (a test compares
every code point); a text with any other character is normalised, and a piece
with one is cut into words, by the library's own tables.

Decoding joins token strings through an offset table: one byte string of all
tokens and the offset of each, gathered for a whole document at once.

Defined results: a null or empty text has no ids; any length of text is
encoded whole; the two added tokens' strings are recognised in raw text, as the
library does.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Fixed values of the vocabulary file's normaliser and pre-tokeniser.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Characters from here on are left to the library's tables.
FAR = re.compile("[^\x00-\u024f]")
#: str.split() also splits at these, the vocabulary's white space doesn't hold them.
NOT_SPACE = re.compile("[\x1c-\x1f]")
assert sys.byteorder == "little" and array("I").itemsize == 4

#: Entries of a worker's memo of words; a full memo is emptied, which costs time only.
MEMO = 600_000
#: Where the last symbol of a word is moved to, so that it differs from the same byte inside.
LAST = 0xE000


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte, by the usual byte-level rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in plain}
    table.update({b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in table)})
    return table


class Bpe:
    """A word-end BPE vocabulary, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        symbol = _byte_symbols()
        self.inner = {b: s for b, s in symbol.items()}
        self.bytes_to_inner = str.maketrans({chr(b): s for b, s in symbol.items()})

        def plain(token: str) -> str:
            """Over an alphabet in which a word's last symbol is one character of its own."""
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                token = token[: -len(suffix)]
                return token[:-1] + chr(LAST + ord(token[-1]))
            return token

        size = 1 + max([*vocab.values(), *self.added.values()])
        self.token_len = [0] * size
        by_text: dict[str, int] = {}
        for token, i in vocab.items():
            by_text[plain(token)] = i
            self.token_len[i] = len(plain(token))
        self.split = [(i, i) for i in range(size)]
        self.pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = i
            self.split[i] = (vocab[a], vocab[b])
        ranks = [vocab[(m if isinstance(m, list) else m.split(" "))[0] + (m if isinstance(m, list) else m.split(" "))[1]] for m in model["merges"]]
        if ranks != sorted(ranks):
            raise ValueError("the token ids of this vocabulary aren't in the order of its merges")
        self.matcher = ahocorasick.Automaton()
        for text, i in by_text.items():
            self.matcher.add_word(text, (len(text), i))
        self.matcher.make_automaton()
        self.shorter = [-1] * size
        for text, i in by_text.items():
            for end in range(len(text) - 1, 0, -1):
                if (j := by_text.get(text[:end])) is not None:
                    self.shorter[i] = j
                    break
        strings = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            strings[i] = token.encode("utf-8") + b" "
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.words = regex.compile(WORDS)
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer, Split(Regex(WORDS.replace(r"\p{White_Space}", r"\s")), "removed", invert=True)
        self.memo: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Would merging the text of both, by rank, leave exactly these two tokens?

        The boundary between them must survive every merge inside the two, in
        the order of ranks: undo the later of the two tokens' own merges step
        by step, and see whether a pair over the boundary would have come first.
        """
        split, pair, bound = self.split, self.pair, 1 << 60
        while True:
            joined = pair.get((left, right))
            if joined is not None and joined < bound:
                return False
            a, b = split[left][1], split[right][0]
            if left > right:
                if a != left:
                    bound, left = left, a
                elif b != right:
                    bound, right = right + 1, b
                else:
                    return True
            elif b != right:
                bound, right = right + 1, b
            elif a != left:
                bound, left = left, a
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-tokenised word."""
        text = word.encode("utf-8").decode("latin-1").translate(self.bytes_to_inner)
        text = text[:-1] + chr(LAST + ord(text[-1]))
        n = len(text)
        longest = [-1] * n
        for end, (length, i) in self.matcher.iter(text):
            longest[end - length + 1] = i  # later ends are longer tokens
        if self.token_len[longest[0]] == n and longest[0] >= 0:
            return [longest[0]]
        token_len, shorter, fits = self.token_len, self.shorter, self.fits
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + token_len[token]
                if open_[end]:
                    if last < 0:
                        break
                    key = (last, token)
                    good = fits.get(key)
                    if good is None:
                        good = fits[key] = self.compatible(last, token)
                    if good:
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                open_[at] = 0
                token = out.pop()
                at -= token_len[token]

    def _word(self, word: str) -> bytes:
        """The ids of one pre-tokenised word, as little-endian unsigned 32-bit integers."""
        ids = array("I", self.encode_word(word)).tobytes()
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
                self.fits.clear()
            self.memo[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """The same of a text without white space. Words and chunks share one memo: a chunk of letters alone is a word."""
        far = FAR.search(chunk)
        if not far and chunk.isalpha():
            return self._word(chunk)
        get, make = self.memo.get, self._word
        words = [w for w, _ in self.cut.pre_tokenize_str(chunk)] if far else self.words.findall(chunk)
        ids = b"".join([get(w) or make(w) for w in words])
        if len(chunk) <= 64:
            self.memo[chunk] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        text = text.lower() if text.isascii() or not FAR.search(text) else self.normal.normalize_str(text)
        chunks = regex.split(r"\p{White_Space}+", text) if NOT_SPACE.search(text) else text.split()
        get, make = self.memo.get, self._chunk
        return b"".join([get(c) or make(c) for c in chunks])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(a in text for a in self.added):
            return self._plain(text)
        added = self.added
        return b"".join(added[part].to_bytes(4, "little") if part in added else self._plain(part) for part in self.added_re.split(text))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: this vocabulary has no decoder, so token strings are joined by a space."""
        if not ids:
            return b""
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        lengths = self.lengths[i]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(self.offsets[i] - (ends - lengths), lengths)
        return self.blob[places[:-1]].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text.

    Returns one row per input row: ``id_col``, ``ids`` (binary, little-endian
    unsigned 32-bit) and ``decoded`` (string). Other columns are left out.
    """
    path = tokenizer or default_path()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            for part in (batch.iloc[i : i + 256] for i in range(0, len(batch), 256)):
                ids = [bpe.encode(t) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].array, "ids": ids, "decoded": [bpe.decode(x).decode("utf-8") for x in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document."""
    path = tokenizer or default_path()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                ids = bpe.encode(text)
                rows.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
