"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by a hash of its code point. An n-gram of letters is bound into
one vector: its letters' vectors, each rotated by its place, are multiplied. A text is the sum (bundle) of its n-gram
vectors; a language's prototype is the sum of the scaled vectors of its training texts. A text gets the language
whose prototype is nearest by cosine.

Texts are lower-cased; runs of other characters become one space, so n-grams know where words begin and end. Training
reads a bounded sample: at most about ``per_language`` labelled texts of each language, chosen by a hash of the id
(all texts of a language that has fewer). Texts never leave their tasks: each task bundles its part of the
sample and only one vector per task and language is summed.

Defined cases: a text that is null or has no letter gets ``und`` and score 0, as does every text when nothing could be
learned; score is the cosine, cut to 0..1; ties go to the language that sorts first; repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import chunks, map_rows, pieces

UNDETERMINED = "und"
DIMENSIONS = 1024
GRAM = 3
PER_LANGUAGE = 3000
SEED = 7
#: Documents handled by one matrix product.
ROWS = 64


@lru_cache(maxsize=20_000)
def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point: its lower-case letter, or a space. One code point stays one."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(text: str | None) -> np.ndarray:
    """Code points of letters with single spaces around the words; empty without letters."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[32], letter_table()[codes], [32]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def text_vectors(texts: list[str | None], dimensions: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A bundle for each text, and whether it has letters."""
    found = [letters(t) for t in texts]
    has = np.array([len(f) > 0 for f in found], bool)
    out = np.zeros((len(texts), dimensions), np.float32)
    for lo in range(0, len(texts), ROWS):
        some = found[lo:lo + ROWS]
        codes = np.concatenate(some)
        if not len(codes):
            continue
        alphabet, small = np.unique(codes, return_inverse=True)
        ends = np.cumsum([len(f) for f in some])
        owner = np.repeat(np.arange(len(some)), [len(f) for f in some])
        key = np.zeros(max(0, len(codes) - gram + 1), np.int64)
        for i in range(gram):
            key = key * len(alphabet) + small[i:i + len(key)]
        inside = owner[:len(key)] == owner[len(codes) - len(key):]
        key, owner = key[inside], owner[:len(key)][inside]
        grams, at = np.unique(key, return_inverse=True)
        counts = np.bincount(owner * len(grams) + at, minlength=len(some) * len(grams)).reshape(len(some), len(grams))
        base = np.stack([letter_vector(int(c), dimensions, seed) for c in alphabet])
        for a in range(0, len(grams), 4096):
            left, bound = grams[a:a + 4096].copy(), None
            for i in range(gram):  # the last letter of the key is its lowest digit
                turned = np.roll(base, gram - 1 - i, axis=1)[left % len(alphabet)]
                bound = turned if bound is None else bound * turned
                left //= len(alphabet)
            out[lo:lo + len(some)] += counts[:, a:a + 4096].astype(np.float32) @ bound.astype(np.float32)
    return out, has


def scaled(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Prototypes of all languages in ``labelled``; rows with a null language are left out."""
    rows = labelled.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang")).where("_lang IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not counts:
        return {"names": [], "vectors": np.zeros((0, dimensions), np.float32), "gram": gram, "seed": seed, "dimensions": dimensions}
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col("_id").cast("string")), F.lit(1 << 30))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("_lang") == name, int(min(1, per_language / n) * (1 << 30))).otherwise(share)
    sample = rows.where(spread < share)

    def bundle(batches):
        import pandas as pd

        total: dict[str, np.ndarray] = {}
        for frame in batches:
            texts, names = frame["_text"].tolist(), frame["_lang"].tolist()
            for lo, hi in chunks([len(t) if t else 1 for t in texts]):
                made = scaled(text_vectors(texts[lo:hi], dimensions, gram, seed)[0])
                for name, v in zip(names[lo:hi], made, strict=True):
                    total[name] = total[name] + v if name in total else v.astype(np.float64)
        yield pd.DataFrame([(name, i, float(x)) for name, v in total.items() for i, x in enumerate(v)], columns=["name", "i", "x"])

    parts = sample.select("_text", "_lang").mapInPandas(bundle, "name string, i int, x double")
    vectors = {name: np.zeros(dimensions) for name in sorted(counts)}
    for name, i, x in parts.groupBy("name", "i").agg(F.sum("x")).collect():
        vectors[name][i] = round(x, 6)
    return {"names": list(vectors), "vectors": scaled(np.stack(list(vectors.values()))).astype(np.float32), "gram": gram, "seed": seed, "dimensions": dimensions}


def predict_texts(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    vectors, has = text_vectors(texts, model["dimensions"], model["gram"], model["seed"])
    if not model["names"]:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    cos = scaled(vectors) @ model["vectors"].T
    best = cos.argmax(1)
    return ([model["names"][b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)],
            [float(np.clip(c[b], 0, 1)) if h else 0.0 for c, b, h in zip(cos, best, has, strict=True)])


def predict(documents: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[doc_id].dataType.simpleString()
    return map_rows(documents, [doc_id, text], lambda ids, texts: (ids, *predict_texts(texts, shared.value)),
                    f"`{doc_id}` {kind}, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: dict, min_score: float = 0.0, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows whose language can be told, those with letters and a cosine of at least ``min_score``; ``lang`` becomes the language told."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = []
            for piece in pieces(batch, text):
                found += zip(*predict_texts(piece.column(piece.schema.names.index(text)).to_pylist(), shared.value), strict=True)
            if lang in batch.schema.names:
                at = batch.schema.names.index(lang)
                batch = batch.set_column(at, batch.schema.field(at), pa.array([name for name, _ in found], batch.schema.field(at).type))
            yield batch.filter(pa.array([name != UNDETERMINED and score >= min_score for name, score in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(parts))
