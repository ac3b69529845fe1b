"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1.  An n-gram is the product of
its letters' vectors, each rotated by its place; a text is the sum of its n-gram
vectors; a language is the sum over its training texts.  The language with the
largest cosine to the text wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import held_out, scored_rows, table, tidy

DIMENSION = 1024
NGRAM = 3
#: Expected training texts a language: a documented bound, not a share of the corpus.
TRAIN_PER_LANGUAGE = 1500
#: Values of the language column beyond this many, the rarest first, are not learned: the model is MOST_LANGUAGES x DIMENSION numbers at most.
MOST_LANGUAGES = 1000
UNDETERMINED = "und"
_GROUP_CHARS = 200_000
_CACHE_ROWS = 24_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 at the code points of letters, else 0."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = 1
    return out


class Encoder:
    """Bundles texts; n-gram vectors are kept in a bounded cache."""

    def __init__(self, dimension: int = DIMENSION, n: int = NGRAM):
        self.d, self.n = dimension, n
        self.letters: dict[int, np.ndarray] = {}
        self.letter_table = _letters()
        self._clear()

    def _clear(self):
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((0, self.d), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([code, self.d])).integers(0, 2, self.d, dtype=np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def grams(self, text: str) -> np.ndarray:
        """n-gram codes of a text: lower case, every run of other characters one blank; none without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter_table[codes].view(bool)
        if not is_letter.any():
            return np.zeros(0, np.uint64)
        codes = np.where(is_letter, codes, 32)
        codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
        blank = codes == 32
        codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
        out = codes[: len(codes) - self.n + 1].copy()
        for i in range(1, self.n):
            out = out << np.uint64(21) | codes[i : len(codes) - self.n + 1 + i]
        return out

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(grams) > _CACHE_ROWS:
            self._clear()
        keys = grams.tolist()
        new = [g for g in keys if g not in self.rows]
        if new:
            block = np.empty((len(new), self.d), np.int8)
            for j, g in enumerate(new):
                v = np.ones(self.d, np.int8)
                for place in range(self.n):
                    v *= np.roll(self.letter(g >> 21 * place & 0x1FFFFF), place)
                block[j] = v
                self.rows[g] = len(self.matrix) + j
            self.matrix = np.concatenate((self.matrix, block))
        return self.matrix[[self.rows[g] for g in keys]].astype(np.float32)

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(vector of each text, its number of n-grams)."""
        each = [self.grams(t) for t in texts]
        counts = np.array([len(g) for g in each])
        out = np.zeros((len(texts), self.d), np.float32)
        at = 0
        while at < len(texts):  # groups of about _GROUP_CHARS n-grams and at most 64 texts
            end, total = at + 1, counts[at]
            while end < len(texts) and end - at < 64 and total + counts[end] <= _GROUP_CHARS:
                total += counts[end]
                end += 1
            if total:
                unique, inverse = np.unique(np.concatenate(each[at:end]), return_inverse=True)
                who = np.repeat(np.arange(end - at), counts[at:end])
                for lo in range(0, len(unique), 8000):
                    part = unique[lo : lo + 8000]
                    inside = (inverse >= lo) & (inverse < lo + len(part)) if len(unique) > 8000 else slice(None)
                    sums = np.bincount(who[inside] * len(part) + inverse[inside] - lo, minlength=(end - at) * len(part))
                    out[at:end] += sums.reshape(end - at, len(part)).astype(np.float32) @ self.vectors(part)
            at = end
        return out, counts


def fit_prototypes(labelled: DataFrame, *, key: str, text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, dimension: int = DIMENSION) -> dict[str, list[float]]:
    """Language prototypes from about ``per_language`` whole texts of each language, chosen by a hash of the key.

    Rows without text or language are left out, and so are languages beyond the
    MOST_LANGUAGES commonest.  Repeated rows count each; an empty table gives no prototypes.  Each task sums its texts by
    language; Spark sums the tasks; the driver gets languages x dimension numbers.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES)
    drawn = F.xxhash64(F.col("k"), F.lit(3)).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))
    sample = rows.join(F.broadcast(sizes), "l").where(drawn * F.col("n") < per_language).select("l", "t")

    def sums(batches):
        import pyarrow as pa

        encoder, total = Encoder(dimension), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                vectors, _ = encoder.bundle(texts[at : at + 64])
                for l, v in zip(langs[at : at + 64], vectors):
                    total[l] = total.get(l, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"l": list(total), "v": [v.tolist() for v in total.values()]}, schema=pa.schema([("l", pa.string()), ("v", pa.list_(pa.float64()))]))

    parts = sample.mapInArrow(tidy(sums), "l string, v array<double>").select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("x"))
    out: dict[str, list[float]] = {}
    for r in parts.collect():
        out.setdefault(r["l"], [0.0] * dimension)[r["i"]] = r["x"]
    return {l: v for l, v in sorted(out.items()) if any(v)}


def predict_language(docs: DataFrame, prototypes: dict[str, list[float]], keep: list[str], *, text: str = "text", n_grams: bool = False) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` (the cosine, cut to 0..1); with ``n_grams`` also that number.

    A null text, one without a letter, or any text with no prototypes at all is
    ``und`` with score 0.  Whole texts are read.  Equal cosines go to the first
    language by name.  Other columns do not matter and may clash.
    """
    picked, split = scored_rows(docs, keep, text)
    names = sorted(prototypes)
    matrix = np.array([prototypes[l] for l in names], np.float64) if names else np.zeros((0, DIMENSION))
    if len(names):
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(matrix.shape[1])
        for batch in batches:
            kept, kept_names, texts = split(batch)
            texts = [t or "" for t in texts]
            langs, scores, grams = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
            for at in range(0, len(texts) if names else 0, 64):
                vectors, counts = encoder.bundle(texts[at : at + 64])
                cosines = vectors.astype(np.float64) @ matrix.T / np.maximum(np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True), 1e-300)
                best = cosines.argmax(axis=1)
                grams[at : at + 64] = counts.tolist()
                for i in np.flatnonzero(counts):
                    langs[at + i], scores[at + i] = names[best[i]], float(min(1.0, max(0.0, cosines[i, best[i]])))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(grams, pa.int64())] * n_grams],
                names=[*kept_names, "lang_pred", "score", *["n_grams"] * n_grams],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return picked.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double" + ", n_grams bigint" * n_grams)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_prototypes(docs.where(~held_out("doc_id", 4, 2)), key="doc_id")
    scored = predict_language(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
