"""Byte-level BPE by merge replay over the distinct pre-tokens of the corpus.

Documents are cut into pre-tokens where they lie, and each distinct pre-token of the corpus comes to one bucket
(``vocabulary``). The pre-tokens of a bucket are laid out as one long list of byte symbols. An inverted index
leads from the rank of a pair of neighbours to all places where that pair stands, in all pre-tokens. Merges are
replayed in rank order: all places of the lowest rank are merged, left to right, and only the pairs with the touched
neighbours enter the index. The ids of the distinct pre-tokens are joined back to the documents, whose ids are these in
order; they are decoded by joining the bytes of the ids.

Defined cases: null is the empty text, with no ids; a single long pre-token is one more stretch of symbols; repeated
rows are encoded one by one; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame

from tabloom.llm.common import map_rows, to_bytes
from tabloom.llm.pretokens import Remembered, per_worker, pretoken_pattern, units
from tabloom.llm.vocabulary import BUCKET_CHARS, CHUNK_CHARS, through_vocabulary

#: Pairs whose ranks a worker keeps between replays; beyond them it looks them up anew.
PAIRS = 1_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Merges:
    """Ranks, the pair table that is filled as pairs are met, and the way back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pretoken_pattern(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # left << 32 | right -> rank of the merged token, -1 if there is none

    def pair_rank(self, key: int) -> int:
        rank = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        self.pairs[key] = rank
        return rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word, as little-endian 32-bit numbers."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)  # one place between words belongs to none
        bounds = np.cumsum(lengths + 1)
        gaps = bounds - 1
        symbols = self.byte_ids[data]
        symbols[gaps] = -1
        size = len(symbols)
        left, right = symbols[:-1], symbols[1:]
        inside = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[inside] << 32 | right[inside]
        distinct, which = np.unique(keys, return_inverse=True)
        known, ask = self.pairs, self.pair_rank
        rank_of = np.array([known[k] if k in known else ask(k) for k in distinct.tolist()], np.int64)
        ranks = rank_of[which] if len(distinct) else np.zeros(0, np.int64)
        inside, ranks = inside[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        inside, ranks = inside[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        places: dict[int, list[int]] = {}
        if len(ranks):
            for part, r in zip(np.split(inside, cuts), ranks[np.concatenate([[0], cuts])].tolist(), strict=True):
                places[r] = part.tolist()
        heap = list(places)
        heapq.heapify(heap)
        sym = symbols.tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            r = heapq.heappop(heap)
            spots = places.pop(r, None)
            if spots is None:
                continue
            spots.sort()
            for i in spots:
                a = sym[i]
                if a < 0:
                    continue
                j = after[i]
                b = sym[j]
                if b < 0 or known.get(a << 32 | b) != r:
                    continue
                sym[i], sym[j] = r, -2
                k = after[j]
                after[i] = k
                before[k] = i
                c = sym[k]
                if c >= 0:
                    key = r << 32 | c
                    rank = known[key] if key in known else ask(key)
                    if rank >= 0:
                        if rank in places:
                            places[rank].append(i)
                        else:
                            places[rank] = [i]
                            heapq.heappush(heap, rank)
                h = before[i]
                if h >= 0 and (c := sym[h]) >= 0:
                    key = c << 32 | r
                    rank = known[key] if key in known else ask(key)
                    if rank >= 0:
                        if rank in places:
                            places[rank].append(h)
                        else:
                            places[rank] = [h]
                            heapq.heappush(heap, rank)
        ids = np.array(sym, np.int64)
        alive = ids >= 0
        counts = np.cumsum(alive)
        flat = ids[alive].astype("<u4").tobytes()
        ends = (4 * counts[gaps]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_units(self, new: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian 32-bit numbers; each distinct pre-token is replayed once."""
        cut = [self.pattern.findall(u) for u in new]
        distinct = list({p for c in cut for p in c})
        ids = dict(zip(distinct, self.replay([to_bytes(p) for p in distinct]), strict=True)) if distinct else {}
        return [b"".join([ids[p] for p in c]) if len(c) != 1 else ids[c[0]] for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def encode_texts(texts: list[str | None], known: Remembered) -> list[bytes]:
    """Ids of every text as little-endian unsigned 32-bit numbers."""
    found = [units(t or "") for t in texts]
    known.learn(found)
    get = known.__getitem__
    return [b"".join(map(get, f)) for f in found]


def worker_merges(documents: DataFrame, ranks: bytes, pattern: str):
    """A function for tasks that gives this worker's merges."""
    import uuid

    shared, name = documents.sparkSession.sparkContext.broadcast((ranks, pattern)), uuid.uuid4().hex
    return lambda: per_worker(f"bpe:{name}", lambda: Merges(read_ranks(shared.value[0]), shared.value[1]))


def through_merges(documents: DataFrame, merges, describe: str, tell_of, make, schema: str, doc_id: str, text: str, chunk_chars: int, bucket_chars: int) -> DataFrame:
    """One row per document; ``make(packed, told)`` gives its columns from its ids, little-endian 32-bit numbers.

    ``tell_of(text)`` gives the columns named by ``describe`` that ``make`` needs of the text.
    """

    def cut(t):
        return merges().pattern.findall(t), tell_of(t)

    def tell():
        return lambda new: merges().replay([to_bytes(p) for p in new]) if new else []

    def use(answers, numbers, told):
        get = answers.__getitem__
        made = [make(b"".join(map(get, n.tolist())), cells) for n, *cells in zip(numbers, *told, strict=True)]
        return list(zip(*made, strict=True))

    return through_vocabulary(documents, cut, describe, tell, use, schema, doc_id, text, chunk_chars, bucket_chars)


def encode(documents: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text",
           chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, ids (array of int) of every row; ``ranks`` is the content of the vocabulary file."""
    return encode_checked(documents, ranks, pattern, doc_id, text, chunk_chars, bucket_chars).select(f"`{doc_id}`", "ids")


def decode(encoded: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; bytes that are no UTF-8 are replaced. Null ids give the empty text."""
    merges = worker_merges(encoded, ranks, pattern)
    kind = encoded.schema[doc_id].dataType.simpleString()

    def work(keys, rows):
        return keys, [merges().decode(np.array(r or [], np.int64)).decode("utf-8", "replace") for r in rows]

    return map_rows(encoded, [doc_id, ids], work, f"`{doc_id}` {kind}, text string")


def digests(documents: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text",
            chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text is encoded, and its ids are decoded again."""
    merges = worker_merges(documents, ranks, pattern)

    def make(packed, _):
        back = merges().decode(np.frombuffer(packed, "<u4"))
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()

    return through_merges(documents, merges, "n_bytes bigint", lambda t: (len(to_bytes(t)),), make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                          doc_id, text, chunk_chars, bucket_chars)


def encode_checked(documents: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text",
                   chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids, decodes (whether decoding the ids gives the text's bytes, by SHA-256) of every row."""
    merges = worker_merges(documents, ranks, pattern)

    def make(packed, told):
        ids = np.frombuffer(packed, "<u4")
        return len(ids), ids.astype(np.int32), hashlib.sha256(merges().decode(ids)).digest() == told[0]

    return through_merges(documents, merges, "digest binary", lambda t: (hashlib.sha256(to_bytes(t)).digest(),), make, "n_tokens bigint, ids array<int>, decodes boolean",
                          doc_id, text, chunk_chars, bucket_chars)
