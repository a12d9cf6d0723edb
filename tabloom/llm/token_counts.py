"""Token counts without token ids, through the corpus's table of distinct units.

A document is a list of units parted by blanks, kept as the frequencies of its distinct units. Every distinct unit of
the corpus is counted in pieces by the tokenizers library once (``vocabulary``); the numbers of pieces are joined to the
documents' frequencies, and their products are summed. No document's ids are made.

Special tokens inside a text are one token each, as the library counts them by default. A definition whose added tokens
do not part texts cleanly has no such units: its texts are counted whole, where they lie. Defined cases: null is
the empty text, with no byte and no token; repeated rows are counted one by one; other columns are not read; an empty
table gives no row.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import map_rows, to_bytes
from tabloom.llm.pretokens import Library, per_worker, units
from tabloom.llm.vocabulary import BUCKET_CHARS, CHUNK_CHARS, through_vocabulary

LIMIT = 1024


def cut_at_specials(text: str, specials) -> tuple[list[str], int]:
    """Units between special strings, and how many of these there are; ``specials`` is a pattern or None."""
    if specials is not None and (cut := specials.split(text))[1:]:
        return [*chain.from_iterable(map(units, cut))], len(cut) - 1
    return units(text), 0


def token_counts(documents: DataFrame, definition: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
                 chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``definition`` is the tokenizer's JSON."""
    import uuid

    shared, name = documents.sparkSession.sparkContext.broadcast(definition), uuid.uuid4().hex
    here = Library(definition)

    def library():
        return per_worker(f"counts:{name}", lambda: Library(shared.value))

    if here.mark is None:
        kind = documents.schema[doc_id].dataType.simpleString()

        def work(ids, texts):
            whole = library().tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return ids, [len(to_bytes(t)) for t in texts], [len(e) for e in whole]

        counted = map_rows(documents, [doc_id, text], work, f"`{doc_id}` {kind}, n_bytes bigint, n_tokens bigint")
        return counted.withColumn("over_limit", F.col("n_tokens") > limit)
    specials = re.compile("|".join(map(re.escape, sorted(here.specials, key=len, reverse=True)))) if here.specials else None

    def cut(t):
        found, extra = cut_at_specials(t, specials)
        return found, (len(to_bytes(t)), extra)

    def tell():
        return lambda new: [len(x).to_bytes(4, "little") for x in library().encode(new)]

    def use(answers, numbers, told):
        pieces = np.frombuffer(b"".join(answers), "<u4").astype(np.int64)
        n_bytes, extra = told
        return n_bytes, [int(pieces[distinct] @ often) + more for (distinct, often), more in zip(numbers, extra, strict=True)]

    counted = through_vocabulary(documents, cut, "n_bytes bigint, extra bigint", tell, use, "n_bytes bigint, n_tokens bigint", doc_id, text, chunk_chars, bucket_chars, counted=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
