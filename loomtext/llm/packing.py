"""Packing of tokenised documents into fixed-length training sequences.

First-fit decreasing, with a tournament tree over bin capacities to find the
first bin that fits in O(log bins), run on its own in each randomised group of pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.bpe import byte_symbols
from loomtext.llm.common import copies, map_arrow, resident, table

SEQUENCE = 2048
END_ID = 1
#: Expected pieces of a group: memory of a packing task, whatever the corpus.
GROUP_PIECES = 2048
CACHE_WORDS = 120_000
END_OF_TEXT = "<|endoftext|>"
_MARKS = ".,;:!?)"
#: The vocabulary's pattern (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = regex.compile(r"\s\s|^\s|\s$")


class ByteBpe:
    """Byte-level ids through a bounded cache of blank-led words.

    A blank before another character always starts a token of this pattern, so the
    runs between single blanks are encoded one by one; a text with longer white
    space goes to the encoder whole.

    The vocabulary is the tokenizers library's file and the ids are the library's; the merging is
    done by tiktoken, several times as fast as the library (figures in the README).
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if list(special) != [END_OF_TEXT]:
            raise ValueError(f"the vocabulary should have {END_OF_TEXT} as its one special token")
        self.end_of_text = special[END_OF_TEXT]
        # merges are numbered in the order in which they apply
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoder = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.marks = {m: self._raw(m) for m in _MARKS}

    def _raw(self, text: str) -> bytes:
        return array("H", self.encoder.encode_ordinary(text)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and a word; a closing mark after letters is a token run of its own."""
        cache = self.cache
        if word[-1] in _MARKS and word[:-1].isalpha():
            stem = word[:-1]
            x = (cache.get(stem) or self._word(stem)) + self.marks[word[-1]]
        else:
            x = self._raw(" " + word)
        if len(word) <= 48:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[word] = x
        return x

    def _plain(self, text: str) -> bytes:
        if not text or _UNSAFE.search(text):
            return self._raw(text)
        words = text.split(" ")
        out, cache = [self._raw(words[0])], self.cache
        for w in words[1:]:
            out.append(cache.get(w) or self._word(w))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """uint16 ids; the end-of-text mark inside a text is its own id."""
        if END_OF_TEXT in text:
            mark = np.array([self.end_of_text], np.uint16).tobytes()
            return np.frombuffer(mark.join(self._plain(p) for p in text.split(END_OF_TEXT)), np.uint16)
        return np.frombuffer(self._plain(text), np.uint16)


def load(path: str) -> ByteBpe:
    return resident(f"byte-bpe {path}", lambda: ByteBpe(path))


class Tournament:
    """Complete binary tree whose leaves are the free room of bins and whose nodes are maxima."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.tree = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin with that much room; -1 if there is none."""
        tree = self.tree
        if tree[1] < size:
            return -1
        i = 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        found = i - self.leaves
        tree[i] -= size
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a > b else b
            if tree[i] == best:
                break
            tree[i] = best
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, items already in decreasing order."""
    tree = Tournament(len(sizes), capacity)
    used: dict[int, int] = {}
    out = []
    for s in sizes:
        b = tree.first_fit(s)
        if b < 0:
            raise ValueError(f"an item of {s} is larger than a bin of {capacity}")
        at = used.get(b, 0)
        used[b] = at + s
        out.append((b, at))
    return out


def pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: key, start, length, ids_crc32, doc_tokens (and ``ids``).

    Only documents longer than a sequence are cut: full pieces first, then the rest.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(_, keys, texts):
        bpe = load(path)
        out = {n: [] for n in ("__key", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for k, t in zip(keys, texts):
            ids = np.append(bpe.encode(t or ""), np.uint16(END_ID)).astype("<u4")
            for at in range(0, len(ids), capacity):
                part = ids[at : at + capacity]
                out["__key"].append(k)
                out["start"].append(at)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(len(ids))
                if with_ids:
                    out["ids"].append(part.tolist())
        yield out

    more = ", ids array<int>" if with_ids else ""
    return map_arrow(docs, [key, text], run, f"__key {key_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{more}").withColumnRenamed("__key", key)


def pack(cut: DataFrame, rows: int, *, key: str = "doc_id", capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces.

    Pieces are dealt to ceil(rows / group_pieces) groups by a hash of key, start, content
    and, among equal rows, a number (so a row that is repeated at will fills no group), and
    each group is packed alone; ties go by key, start and crc, so a repeated task packs
    alike.  ``rows`` is the number of documents, of which each has one piece that is not full at most.
    """
    groups = max(1, -(-rows // group_pieces))
    counted = cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("__n"))
    group = F.pmod(F.xxhash64(key, "start", "ids_crc32", "__copy", F.lit(11)), F.lit(groups)).cast("int")
    dealt = copies(counted, "__n", "__copy").withColumn("__group", group).drop("__n", "__copy")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def one(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        table = table.drop(["__group"]).sort_by([("length", "descending"), (key, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        return table.append_column("sequence_id", pa.array([group << 32 | b for b, _ in placed], pa.int64())).append_column("offset", pa.array([at for _, at in placed], pa.int64()))

    return dealt.groupBy("__group").applyInArrow(one, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack a table.

    A null text is an empty one: its one id is the end id.  Every id of every row,
    repeated rows too, lies in one piece; a very long text is many pieces; pieces of one
    length are taken by key; an empty table gives no rows; other columns are not read.
    """
    return pack(pieces(docs, path, key=key, text=text, capacity=capacity, with_ids=with_ids), docs.count(), key=key, capacity=capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
