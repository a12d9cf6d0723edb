"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased runs of letters and digits) are hashed into ``2 ** bucket_bits`` buckets; buckets met in a few
training texts have a trained vector, others the zero vector. To a word's vector that of its first five bytes is added, hashed
likewise (of its first four if that is rare), so forms of one stem share what is learned. Filters of several widths run over the word vectors,
the largest value of each filter over the whole text is kept (max pooling, not below 0), and a logistic unit
weighs them. A filter's value is a sum of one number per word and place, so scoring reads tables of ``vectors x
filters`` and never multiplies matrices per document.

Training reads every labelled row. The rows lie in shards of about ``SHARD_ROWS``; in every epoch each shard goes on from the common weights over all its rows, and the shards' weights are averaged (a word's
vector by how often each shard moved it). Words with a vector are chosen by counts over all labelled texts. One part in five only
calibrates: for each language a threshold is chosen that separates the classes best over all of that part, and scores are
shifted so that it lies at 0.5. Whose language a text has is told by its words, from profiles of all labelled rows; a language
with too few examples takes the threshold of all. Only counts and weights, whose size the vocabulary bounds, reach the driver.

Defined cases: null is the empty text, one place without words, which every step and the threshold of all hold as clean; texts shorter than a filter are padded with the
zero vector; rows without label or with another label than 0 and 1 are not learned from; without both classes the
score is the share of label 1 (0 without labels); of repeated labels of one document the larger counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import ALNUM_TABLE, MIX, chunks, map_rows, pieces, to_bytes, word_hashes
from tabloom.sources.runtime import materialize

WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 16
BUCKET_BITS = 22
#: A bucket has a vector if so many labelled texts hold it, and this share of them, both classes counting alike.
MIN_TEXTS = 6
MIN_SHARE = 0.001
#: Labelled rows that train one copy of the weights in an epoch; words of them held at once.
SHARD_ROWS = 20_000
BLOCK_WORDS = 8_000_000
#: A step takes so many rows of each class.
HALF_BATCH = 32
#: Pieces in which weights are summed; logits are counted in steps of one part of this.
SLICES = 16
LOGIT_PARTS = 256
#: Bits of the map of labelled ids that keeps unlabelled texts from being shuffled: 8 MB at most.
ID_BITS = 1 << 26
#: A word is looked up whole, then by so many first bytes.
FORMS = (None, 5, 4)
EPOCHS = 6
CALIBRATION_PART = 5
#: A language has its own threshold if each class has so many examples among those that calibrate.
LEAST_EXAMPLES = 10
SEED = 11
THRESHOLD = 0.5


def word_buckets(texts: list[bytes], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of all texts (one row each: the word, its stems), and the number of words up to each text's end."""
    data = np.frombuffer(b" ".join(texts).translate(ALNUM_TABLE), np.uint8)
    blank = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    forms = [word_hashes(data, starts, ends if n is None else np.minimum(ends, starts + n)) ^ MIX[i] for i, n in enumerate(FORMS)]
    return np.stack([(h >> np.uint64(64 - bits)).astype(np.int32) for h in forms]), np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def rows_of(buckets: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Two rows for every word: its own and its stem's, 0 where there is none."""
    out = row_of[buckets]
    for shorter in out[2:]:
        out[1] = np.where(out[1] > 0, out[1], shorter)
    return out[:2]


def padded(words: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows with ``pad`` zeros behind each text; starts and lengths of the texts in them."""
    lengths = np.diff(np.concatenate([[0], ends]))
    starts = np.concatenate([[0], ends[:-1]]) + pad * np.arange(len(ends))
    n = words.shape[1]
    out = np.zeros((len(words), n + pad * len(ends)), words.dtype)
    out[:, np.arange(n) + pad * np.repeat(np.arange(len(ends)), lengths)] = words
    return out, starts, lengths


class Network:
    """Weights, the forward pass over tables, and one training step."""

    def __init__(self, rows: int, seed: int, widths=WIDTHS, filters: int = FILTERS, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.vectors = rng.normal(0, 0.05, (rows, dimensions)).astype(np.float32)
        self.vectors[0] = 0
        self.kernels = [rng.normal(0, 0.3, (w, dimensions, filters)).astype(np.float32) for w in widths]
        self.shift = np.zeros((len(widths), filters), np.float32)
        self.weights = rng.normal(0, 0.3, len(widths) * filters).astype(np.float32)
        self.bias = np.float32(0)
        self.memory: dict = {}
        self.moved = np.zeros(rows, np.float32)

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.vectors @ k[j] for j in range(len(k))] for k in self.kernels]

    def convolve(self, ids: np.ndarray, tables) -> np.ndarray:
        """Every filter at every place; the last places, which would reach beyond the end, stay at their shift."""
        n = ids.shape[1]
        out = np.empty((n, len(self.widths) * self.filters), np.float32)
        for i, parts in enumerate(tables):
            own = out[:, i * self.filters:(i + 1) * self.filters]
            own[:] = self.shift[i]
            for j, table in enumerate(parts):
                for part in ids:
                    own[:n - j] += table.take(part[j:], axis=0)
        return out

    def copy(self) -> Network:
        """Weights of its own, no moves yet."""
        out = Network.__new__(Network)
        out.widths, out.filters = self.widths, self.filters
        out.vectors, out.kernels, out.shift, out.weights, out.bias = self.vectors.copy(), [k.copy() for k in self.kernels], self.shift.copy(), self.weights.copy(), self.bias
        out.memory, out.moved = {k: np.array(v, np.float32) for k, v in self.memory.items()}, np.zeros(len(self.vectors), np.float32)
        return out

    def others(self) -> list[np.ndarray]:
        """All weights but the words' vectors, with Adagrad's memory of them."""
        held = [self.weights, np.atleast_1d(self.bias), self.shift, *self.kernels]
        names = ["weights", "bias", *[x for i in range(len(self.kernels)) for x in (f"shift{i}", f"kernel{i}")]]
        return held + [np.atleast_1d(self.memory[name]) for name in names]

    def flat(self, steps: int) -> np.ndarray:
        """What sums over shards: vectors and their memory times moves, moves, the rest times steps, steps."""
        parts = [self.vectors * self.moved[:, None], self.memory["vectors"] * self.moved, self.moved, *[steps * x for x in self.others()], np.array([steps])]
        return np.concatenate([np.ravel(p) for p in parts])

    def mean(self, flat: np.ndarray, rows: int) -> Network:
        """The network that such a sum describes; words that no shard moved stay as they are here."""
        out, wide = self.copy(), rows * self.vectors.shape[1]
        moved = flat[wide + rows:wide + 2 * rows]
        some = moved > 0
        out.vectors[some] = flat[:wide].reshape(rows, -1)[some] / moved[some, None]
        out.memory.setdefault("vectors", np.full(rows, 1e-6, np.float32))[some] = flat[wide:wide + rows][some] / moved[some]
        rest, at = flat[wide + 2 * rows:-1] / flat[-1], 0

        def take(like):
            nonlocal at
            at += np.size(like)
            return rest[at - np.size(like):at].reshape(np.shape(like)).astype(np.float32)

        out.weights, out.bias, out.shift, out.kernels = take(out.weights), take([0])[0], take(out.shift), [take(k) for k in out.kernels]
        out.memory["weights"], out.memory["bias"] = take(out.weights), take([0])
        for i, k in enumerate(out.kernels):
            out.memory[f"shift{i}"], out.memory[f"kernel{i}"] = take(out.shift[i]), take(k)
        return out

    def pooled(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tables) -> np.ndarray:
        out = np.tile(np.maximum(0, self.shift).ravel(), (len(starts), 1))
        some = np.flatnonzero(lengths)
        if len(some):
            cuts = np.stack([starts[some], starts[some] + lengths[some]], 1).ravel()
            out[some] = np.maximum(0, np.maximum.reduceat(self.convolve(ids, tables), cuts, axis=0)[0::2])
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias

    def step(self, texts: list[np.ndarray], labels: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        """One step of Adagrad on a few padded texts; only the places that won the pooling get a share."""
        n, ids = self.filters, np.concatenate(texts, axis=1)
        met = np.zeros(len(self.vectors), bool)
        met[ids] = True
        used = np.flatnonzero(met)
        met = np.zeros(len(self.vectors), np.int32)
        met[used] = np.arange(len(used))
        values = self.convolve(met[ids], [[self.vectors[used] @ k[j] for j in range(len(k))] for k in self.kernels])
        ends = np.cumsum([t.shape[1] for t in texts])
        starts, places = ends - [t.shape[1] for t in texts], [t.shape[1] - max(self.widths) + 1 for t in texts]
        at = np.stack([start + values[start:start + k].argmax(0) for start, k in zip(starts, places, strict=True)])
        pooled = np.take_along_axis(values, at, 0)
        active = pooled > 0
        pooled = np.where(active, pooled, 0)
        error = (1 / (1 + np.exp(-self.logits(pooled))) - labels).astype(np.float32) / len(texts)
        back = error[:, None] * self.weights * active
        grads = {"weights": pooled.T @ error + decay * self.weights, "bias": error.sum(keepdims=True)}
        rows, parts = [], []
        for i, k in enumerate(self.kernels):
            part = back[:, i * n:(i + 1) * n]
            grads[f"shift{i}"] = part.sum(0)
            gk = np.zeros_like(k)
            for j in range(len(k)):
                share = (part[:, :, None] * k[j].T[None]).reshape(-1, k.shape[1])
                for kind in (0, 1):
                    word = ids[kind, at[:, i * n:(i + 1) * n] + j]
                    rows.append(word.ravel())
                    parts.append(share)
                    gk[j] += np.einsum("bf,bfd->df", part, self.vectors[word])
            grads[f"kernel{i}"] = gk + decay * k
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        keep = rows > 0
        touched, which = np.unique(rows[keep], return_inverse=True)
        gv = np.zeros((len(touched), self.vectors.shape[1]), np.float32)
        np.add.at(gv, which, parts[keep])
        gv += decay * self.vectors[touched]
        memory = self.memory.setdefault("vectors", np.full(len(self.vectors), 1e-6, np.float32))
        memory[touched] += (gv * gv).mean(1)
        self.vectors[touched] -= rate * gv / np.sqrt(memory[touched])[:, None]
        self.moved[touched] += 1
        for name, g in grads.items():
            m = self.memory[name] = self.memory.get(name, np.float32(1e-6)) + g * g
            move = rate * g / np.sqrt(m)
            if name == "weights":
                self.weights -= move
            elif name == "bias":
                self.bias -= move[0]
            elif name.startswith("shift"):
                self.shift[int(name[5:])] -= move
            else:
                self.kernels[int(name[6:])] -= move


# ---- training ---------------------------------------------------------------------------------


def labelled_rows(documents: DataFrame, labels: DataFrame, seed: int, doc_id: str, text: str, lang: str, label: str) -> tuple[DataFrame, int]:
    """(fold, order, label, lang, text) of every document with a label, written once; the number of shards."""
    kind = documents.schema[doc_id].dataType
    known = (labels.select(F.col(f"`{doc_id}`").cast(kind).alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
             .groupBy("_id").agg(F.max("_label").alias("_label")).where("_id IS NOT NULL"))
    shards = max(1, -(-known.count() // SHARD_ROWS))
    # A map of fixed size of the labelled ids spares most other texts the shuffle; the join after it decides.
    spot = F.pmod(F.xxhash64("_id"), F.lit(ID_BITS))
    maps = known.groupBy(F.bitmap_bucket_number(spot).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_map"))
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").alias("_text"))
    rows = rows.where("_id IS NOT NULL").withColumn("_spot", spot).withColumn("_part", F.bitmap_bucket_number("_spot")).withColumn("_at", F.bitmap_bit_position("_spot"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = rows.join(F.broadcast(maps), "_part").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    # Merged at every size, so that what is shuffled grows with the texts and never jumps where the ids cease to be sent to the rows.
    dealt = likely.select("_id", "_lang", "_text").join(known.hint("merge"), "_id")
    order = F.xxhash64(F.lit(seed), F.col("_id").cast("string"), F.coalesce("_text", F.lit("")))
    out = dealt.select(F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(CALIBRATION_PART)).alias("_fold"), order.alias("_order"), "_label", "_lang", "_text")
    return materialize(out.sortWithinPartitions("_order"), "labelled"), shards


def column_task(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """``fn`` turns all Arrow batches of a task into lists of the output's columns, any number of them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for made in fn([c.to_pylist() for c in batch.columns] for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def text_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, clean, toxic): in how many texts of each class a bucket is met."""
    def work(batches):
        seen = np.zeros((2, 1 << bits), np.int32)
        for labels, texts in batches:
            for lo, hi in chunks([len(t) if t else 1 for t in texts]):
                words, ends = word_buckets([to_bytes(t) for t in texts[lo:hi]], bits)
                for y, part in zip(labels[lo:hi], np.split(words, ends[:-1], axis=1), strict=True):
                    seen[y][np.unique(part)] += 1
        some = np.flatnonzero(seen.any(0))
        yield some.astype(np.int32), seen[0][some].astype(np.int64), seen[1][some].astype(np.int64)

    return column_task(rows, ["_label", "_text"], work, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def encoded_rows(rows: DataFrame, row_of, kind: str, bits: int) -> DataFrame:
    """The rows with their words' rows in place of the text, padded behind, written once."""
    pad = max(WIDTHS) - 1

    def work(folds, labels, langs, texts):
        words, ends = word_buckets([to_bytes(t) for t in texts], bits)
        made = [np.concatenate([w, np.zeros((2, pad), w.dtype)], 1).astype(kind).tobytes() for w in np.split(rows_of(words, row_of.value), ends[:-1], axis=1)]
        return folds, labels, langs, made

    return materialize(map_rows(rows, ["_fold", "_label", "_lang", "_text"], work, "_fold int, _label int, _lang string, _words binary"), "words")


def language_counts(coded: DataFrame, n: int, kind: str) -> DataFrame:
    """(lang, at, n): in how many texts of a language a word's row is met."""
    def work(batches):
        seen: dict[str, np.ndarray] = {}
        for langs, words in batches:
            for name, w in zip(langs, words, strict=True):
                if name:
                    seen.setdefault(name, np.zeros(n, np.int64))[np.unique(np.frombuffer(w, kind).reshape(2, -1)[:, :1 - max(WIDTHS)])] += 1
        for name, found in seen.items():
            at = np.flatnonzero(found)
            yield [name] * len(at), at.astype(np.int32), found[at]

    return column_task(coded, ["_lang", "_words"], work, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))


def word_languages(counts: DataFrame, n: int) -> tuple[np.ndarray, list[str]]:
    """A log weight per word row and language; row 0 says nothing."""
    found = counts.collect()
    names = sorted({r["lang"] for r in found})
    number = {name: i for i, name in enumerate(names)}
    weight = np.full((n, max(1, len(names))), 0.5, np.float64)
    for r in found:
        weight[r["at"], number[r["lang"]]] += r["n"]
    weight = np.log(weight / weight.sum(0))
    weight -= weight.mean(1, keepdims=True)
    weight[0] = 0
    return weight.astype(np.float32), names


def word_blocks(batches, kind: str):
    """(labels, words) of a task's rows, cut where they are too large."""
    labels, texts, size = [], [], 0
    for columns in batches:
        for y, w in zip(*columns, strict=True):
            if size > BLOCK_WORDS:
                yield np.array(labels, np.float32), texts
                labels, texts, size = [], [], 0
            labels.append(y)
            words = np.frombuffer(w, kind).reshape(2, -1)
            texts.append(words if words.shape[1] >= max(WIDTHS) else np.zeros((2, max(WIDTHS)), kind))  # one place without words
            size += texts[-1].shape[1]
    if labels:
        yield np.array(labels, np.float32), texts


def one_epoch(coded: DataFrame, net: Network, kind: str, shards: int, epoch: int, seed: int) -> Network:
    """Every shard goes over all its rows from ``net``; the mean of their weights, a word's by its moves."""
    shared, rows = coded.sparkSession.sparkContext.broadcast(net), len(net.vectors)
    empty = [np.zeros((2, max(WIDTHS)), kind)]  # a text without words counts as clean in every step

    def work(batches):
        from pyspark import TaskContext

        mine, steps, shard = shared.value.copy(), 0, TaskContext.get().partitionId()
        for block, (y, texts) in enumerate(word_blocks(batches, kind)):
            rng = np.random.default_rng((seed, epoch, shard, block))
            order = [rng.permutation(c) for c in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(c)]
            for i in range(max(60 if shards == 1 and block == 0 else 1, -(-max(map(len, order)) // HALF_BATCH))):  # half of each class
                some = np.concatenate([np.take(o, np.arange(i * HALF_BATCH, (i + 1) * HALF_BATCH), mode="wrap") for o in order])
                mine.step([texts[k] for k in some] + empty, np.append(y[some], np.float32(0)), 0.1 / (1 + epoch))
                steps += 1
        if steps:
            for i, part in enumerate(np.array_split(mine.flat(steps), SLICES)):
                yield [i], [shard], [part.astype(np.float32).tobytes()]

    def add(frame):
        import pandas as pd

        total = 0
        for part in frame.sort_values("shard")["part"]:
            total = total + np.frombuffer(part, np.float32).astype(np.float64)
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "part": [total.tobytes()]})

    parts = column_task(coded.coalesce(shards), ["_label", "_words"], work, "slice int, shard int, part binary").groupBy("slice").applyInPandas(add, "slice int, part binary")
    flat = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(parts.collect(), key=lambda r: r["slice"])])
    return net.mean(flat, rows)


def logit_counts(coded: DataFrame, net: Network, language: np.ndarray, kind: str) -> DataFrame:
    """(level, bin, lo, hi, clean, toxic): rows by language told and logit in steps of 1 / LOGIT_PARTS."""
    shared, pad = coded.sparkSession.sparkContext.broadcast((net, net.tables(), language)), max(WIDTHS) - 1

    def work(batches):
        net, tables, language = shared.value
        for labels, words in batches:
            rows = [np.frombuffer(w, kind).reshape(2, -1) for w in words]
            yield ([told_language(r, language) for r in rows],
                   [float(net.logits(net.pooled(r, np.array([0]), np.array([r.shape[1] - pad]), tables))[0]) for r in rows], labels)

    made = column_task(coded, ["_label", "_words"], work, "level int, logit double, label int")
    return made.groupBy("level", F.floor(F.col("logit") * LOGIT_PARTS).alias("bin")).agg(
        F.min("logit").alias("lo"), F.max("logit").alias("hi"), F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))


def train(documents: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, epochs: int = EPOCHS, seed: int = SEED,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> dict:
    """A model from all labelled rows given; ``lang`` serves only to learn word profiles of languages."""
    return fit(*labelled_rows(documents, labels, seed, doc_id, text, lang, label), bits, epochs, seed)


def fit(rows: DataFrame, shards: int, bits: int = BUCKET_BITS, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    held = F.col("_fold") == CALIBRATION_PART - 1
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("_label", held).count().collect()}
    n = [sum(v for (y, _), v in sizes.items() if y == c) for c in (0, 1)]
    if not all(n):
        return {"bits": bits, "constant": n[1] / sum(n) if sum(n) else 0.0}
    share = F.col("clean") / (2.0 * n[0]) + F.col("toxic") / (2.0 * n[1])
    enough = (F.col("clean") + F.col("toxic") >= min(MIN_TEXTS, 2 + sum(n) // 200)) & (share >= MIN_SHARE)
    kept = np.array(sorted(r[0] for r in text_counts(rows, bits).where(enough).select("bucket").collect()), np.int64)
    row_of = np.zeros(1 << bits, np.int32)
    row_of[kept] = np.arange(1, len(kept) + 1)
    kind = np.dtype(np.uint16 if len(kept) < 1 << 16 else np.int32).str
    coded = encoded_rows(rows, rows.sparkSession.sparkContext.broadcast(row_of), kind, bits)
    language, names = word_languages(language_counts(coded, len(kept) + 1, kind), len(kept) + 1)
    whole = len(sizes) == 4
    net = Network(len(kept) + 1, seed)
    for epoch in range(epochs):
        net = one_epoch(coded.where(~held) if whole else coded, net, kind, shards, epoch, seed)
    found = logit_counts(coded.where(held) if whole else coded, net, language, kind).collect()
    nothing = float(net.logits(net.pooled(np.zeros((2, 0), np.int32), np.zeros(1, int), np.zeros(1, int), net.tables()))[0])
    rest = best_threshold([*found, {"bin": int(np.floor(nothing * LOGIT_PARTS)), "lo": nothing, "hi": nothing, "clean": 1, "toxic": 0}])
    levels = [best_threshold([r for r in found if r["level"] == i], rest, LEAST_EXAMPLES) for i in range(len(names))] + [rest]
    return {"bits": bits, "row_of": row_of, "tables": net.tables(), "shift": net.shift, "weights": net.weights, "bias": net.bias,
            "language": language, "names": names, "levels": np.array(levels, np.float32)}


def told_language(words: np.ndarray, language: np.ndarray) -> int:
    """The language's number; the last level (-1) when no word tells."""
    total = language[words[0]].sum(0)
    return int(total.argmax()) if total.any() else -1


def best_threshold(found: list, fallback: float = 0.0, least: int = 1) -> float:
    """The logit between two counted steps with the fewest errors on both sides; in the widest such gap."""
    steps: dict[int, list] = {}
    for r in found:
        old = steps.get(r["bin"], [r["lo"], r["hi"], 0, 0])
        steps[r["bin"]] = [min(old[0], r["lo"]), max(old[1], r["hi"]), old[2] + r["clean"], old[3] + r["toxic"]]
    lo, hi, clean, toxic = np.array([steps[b] for b in sorted(steps)], np.float64).reshape(-1, 4).T
    if min(clean.sum(), toxic.sum()) < least:
        return fallback
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    below, above = np.concatenate([[lo[0] - 2], hi]), np.concatenate([lo, [hi[-1] + 2]])
    at = int(np.where(errors <= errors.min() + 1e-9, above - below, -1).argmax())
    return float((below[at] + above[at]) / 2)


# ---- scoring ----------------------------------------------------------------------------------


def score_texts(texts: list[str | None], model: dict, langs: list[str | None] | None = None) -> np.ndarray:
    """Scores; with ``langs`` a language that the model knows decides the threshold, else the words tell it."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    net = Network.__new__(Network)
    net.widths, net.filters, net.shift, net.weights, net.bias = WIDTHS, model["shift"].shape[1], model["shift"], model["weights"], model["bias"]
    words, ends = word_buckets([to_bytes(t) for t in texts], model["bits"])
    ids, starts, lengths = padded(rows_of(words, model["row_of"]), ends, max(WIDTHS) - 1)
    logits = net.logits(net.pooled(ids, starts, lengths, model["tables"])).astype(np.float64)
    levels = np.full(len(texts), len(model["levels"]) - 1)
    if model["names"]:
        some = np.flatnonzero(lengths)
        told = np.add.reduceat(model["language"][ids[0]], starts[some], axis=0) if len(some) else np.zeros((0, 1))  # padding adds 0
        levels[some] = np.where(told.any(1), told.argmax(1), len(model["levels"]) - 1)
    if langs is not None:
        number = {name: i for i, name in enumerate(model["names"])}
        levels = np.array([number.get(name, told) for name, told in zip(langs, levels, strict=True)], np.int64)
    return 1 / (1 + np.exp(np.clip(model["levels"][levels] - logits, -60, 60)))


def score(documents: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row, from the text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[doc_id].dataType.simpleString()

    def work(ids, texts):
        made = score_texts(texts, shared.value)
        return ids, made, (made >= THRESHOLD).astype(np.int32)

    return map_rows(documents, [doc_id, text], work, f"`{doc_id}` {kind}, score double, predicted int")


def keep_harmless(documents: DataFrame, model: dict, text: str = "text", lang: str | None = None) -> DataFrame:
    """Rows, all columns, whose score is below the threshold; ``lang`` may name the column of a language told before."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            mask = []
            for piece in pieces(batch, text):
                texts, langs = (piece.column(piece.schema.names.index(c)).to_pylist() if c else None for c in (text, lang))
                mask += (score_texts(texts, shared.value, langs) < THRESHOLD).tolist()
            yield batch.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
