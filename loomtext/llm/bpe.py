"""BPE encoding and decoding with a contiguous rank array.

A word is a list of parts and, beside it, the merge rank of each neighbouring
pair.  The smallest rank is found by a scan, its boundary is deleted and the two
ranks beside it are refreshed, until no pair can merge.  Words are short, so the
scan beats a heap; words beyond ``SCAN_LIMIT`` bytes take a heap, which gives
the same ids without the quadratic cost.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import map_arrow, resident, table

SCAN_LIMIT = 256
CACHE_WORDS = 400_000
_NONE = 1 << 60
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_BLANKS = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordBpe:
    """A vocabulary with word ends (``</w>``): NFC, one blank for white space, lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = dict(spec["model"]["vocab"])
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), rank)
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, list[int]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > SCAN_LIMIT:
            return self._merge_long(parts)
        get, made = self.ranks.get, self.made
        ranks = [get(p, _NONE) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p, keep in zip(parts, alive) if keep]

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of a normalised run without blanks."""
        out: list[int] = []
        words = self.words
        for word in [chunk] if chunk.isalpha() else _PATTERN.findall(chunk):
            ids = words.get(word)
            if ids is None:
                data = word.encode()
                parts = [self.inner[b] for b in data]
                parts[-1] = self.last[data[-1]]
                ids = self.merge(parts)
                if len(word) <= 64:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = _BLANKS.sub(" ", text).replace("Σ", "σ")  # letter by letter: no final sigma
            chunks = text.lower().split(" ")
        else:
            chunks = text.lower().translate(_ASCII_BLANKS).split(" ")
        cache, out = self.cache, []
        for c in chunks:
            if c:
                x = cache.get(c)
                if x is None:
                    ids = self._chunk(c)
                    x = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))
                    if len(c) <= 64:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[c] = x
                out.append(x)
        return out

    def encode_parts(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, tokens as text) of each run of a text."""
        if self.split_special is None or "<" not in text:
            return self._plain(text)
        out = []
        for piece in self.split_special.split(text):
            out += [(1, str(self.special[piece]), piece)] if piece in self.special else self._plain(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_parts(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one blank, as a file without a decoder gives them; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_ASCII_BLANKS = {c: " " for c in range(9, 14)}


def load(path: str) -> WordBpe:
    return resident(f"word-bpe {path}", lambda: WordBpe(path))


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, ``decoded`` if asked).

    A null text is an empty one: 0 tokens and the digests of ''.  Whole texts of
    any length are read.  Repeated rows give repeated results, an empty table none;
    other columns are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(_, keys, texts):
        bpe = load(path)
        out = {"__key": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for t in texts:
            parts = bpe.encode_parts(t or "")
            ids, decoded = " ".join([p[1] for p in parts if p[0]]), " ".join([p[2] for p in parts if p[0]])
            out["n_tokens"].append(sum([p[0] for p in parts]))
            out["ids_sha256"].append(sha(ids))
            out["decoded_sha256"].append(sha(decoded))
            if with_ids:
                out["ids"].append([int(i) for i in ids.split()])
                out["decoded"].append(decoded)
        yield out

    more = ", ids array<int>, decoded string" if with_ids else ""
    return map_arrow(docs, [key, text], run, f"__key {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("__key", key)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
