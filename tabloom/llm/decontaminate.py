"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items (words as letters) is streamed over every document: after each word it holds the longest
suffix of the document so far that occurs in some item. Where that length reaches the window, the last ``window``
words are a run of consecutive item words, so they are hit; an item shorter than the window counts when the whole
item has just been read. Spans of hit words that reach the length limit, in documents over the coverage limit, are
removed, or the documents are.

The items are a query set: they go through the driver in blocks of ``block_words`` words, each block becomes one
broadcast and one pass in the same task chain, so memory is bounded by the block and no row is shuffled.

Defined cases: a null or empty text has no words and no hit; repeated rows are judged one by one; an empty benchmark
hits nothing; items without words are ignored; a null item id is listed as ``null``; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import alnum_words, keep_rows, map_rows, to_bytes

WINDOW = 13
#: A document is contaminated when hit words are at least one in so many.
COVERAGE_PART = 20
BLOCK_WORDS = 100_000


class Automaton:
    """Generalised suffix automaton over lists of words, with the items behind every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            state = 0
            for w in words:
                state = self._extend(state, w)
        self.least = min([window, *(len(words) for _, words in items if words)])
        self._places(items)

    def _places(self, items) -> None:
        """Items of every state that stands for a window; short items of every state and its suffixes."""
        length, link = self.length, self.link
        own: list[set | None] = [None] * len(length)
        for ident, words in items:  # states are split while items are added, so each item is read again
            if len(words) < self.window:
                continue
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= self.window:
                    if own[state] is None:
                        own[state] = set()
                    own[state].add(ident)
        order = sorted(range(1, len(length)), key=length.__getitem__, reverse=True)
        for s in order:
            up = link[s]
            if own[s] and length[up] >= self.window:
                own[up] = (own[up] or set()) | own[s]
        self.place = [-1] * len(length)
        self.short: list[tuple | None] = [None] * len(length)
        marks = {}
        for ident, words in items:
            if words and len(words) < self.window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                marks.setdefault(state, []).append((len(words), ident))
        for s in reversed(order):
            up = link[s]
            if length[s] >= self.window:
                self.place[s] = self.place[up] if length[up] >= self.window else s
            above = self.short[up] if up > 0 else None
            self.short[s] = (tuple(marks[s]), above) if s in marks else above
        self.items = own

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, w)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], int]:
        """Hit spans as a flat list of (from, to) word places, the items that occur, the longest match."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        root = nxt[0]
        state, run, longest = 0, 0, 0
        found: set[str] = set()
        seen: set[int] = set()
        spans: list[int] = []
        for i, w in enumerate(words):
            if state:
                to = nxt[state].get(w)
                if to is None:
                    state = link[state]
                    while state and w not in nxt[state]:
                        state = link[state]
                    to = nxt[state].get(w)
                    run = length[state] if to is not None else -1
                run += 1
                state = to or 0
            else:
                state = root.get(w, 0)
                run = 1 if state else 0
            if run < least:
                continue
            longest = run if run > longest else longest
            reach = 0
            if run >= window:
                place = self.place[state]
                if place not in seen:
                    seen.add(place)
                    found |= self.items[place]
                reach = window
            above = self.short[state]
            while above:
                for n, ident in above[0]:
                    if n <= run:
                        found.add(ident)
                        reach = n if n > reach else reach
                above = above[1]
            if reach:
                start = i + 1 - reach
                while spans and start <= spans[-1]:
                    start = min(start, spans[-2])
                    del spans[-2:]
                spans += (start, i + 1)
        return spans, found, longest


def item_blocks(benchmark: DataFrame, window: int, block_words: int, item_id: str, text: str) -> Iterator[list]:
    """Items as word lists, in blocks; an item longer than a block goes on in the next with ``window - 1`` words."""
    block, size = [], 0
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        words = alnum_words(row[1])
        step = max(block_words, window) - window + 1
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at:at + step + window - 1]
            if size and size + len(part) > block_words:
                yield block
                block, size = [], 0
            if part:
                block.append(("null" if row[0] is None else row[0], part))
                size += len(part)
    if block:
        yield block


_automata: dict[str, Automaton] = {}


def automaton_of(name: str, shared, window: int) -> Automaton:
    """Built once in each Python worker for each broadcast block; few are kept."""
    if name not in _automata:
        while len(_automata) >= 3:
            _automata.pop(next(iter(_automata)))
        _automata[name] = Automaton(shared.value, window)
    return _automata[name]


def shared_blocks(documents: DataFrame, benchmark: DataFrame, window: int, block_words: int, item_id: str, text: str) -> Iterator:
    for block in item_blocks(benchmark, window, block_words, item_id, text):
        yield uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(block)


def merge_spans(a: list[int], b: list[int]) -> list[int]:
    pairs = sorted(zip([*a[0::2], *b[0::2]], [*a[1::2], *b[1::2]], strict=True))
    out: list[int] = []
    for lo, hi in pairs:
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += (lo, hi)
    return out


def match_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text, n_words, spans (flat word places), items (sorted, as strings), longest_match: one row per row."""
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"`_id` {kind}, n_words bigint, longest_match bigint, spans array<int>, items array<string>, `_text` string"
    df = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.lit(None).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("longest_match"),
                          F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"), F.col(f"`{text}`").alias("_text"))

    def count(ids, counts, longest, spans, items, texts):
        return ids, [len(alnum_words(t)) for t in texts], longest, spans, items, texts

    blocks = [*shared_blocks(documents, benchmark, window, block_words, item_id, item_text)]
    if not blocks:
        return map_rows(df, df.columns, count, schema)
    for name, shared in blocks:

        def step(ids, counts, longest, spans, items, texts, name=name, shared=shared):
            auto = automaton_of(name, shared, window)
            for i, t in enumerate(texts):
                words = alnum_words(t)
                counts[i] = len(words)
                got, found, most = auto.scan(words)
                if got:
                    spans[i] = merge_spans(spans[i], got) if spans[i] else got
                    items[i] = sorted(found.union(items[i]))
                longest[i] = max(longest[i], most)
            return ids, counts, longest, spans, items, texts

        df = map_rows(df, df.columns, step, schema)
    return df


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = COVERAGE_PART,
                  block_words: int = BLOCK_WORDS, **names) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = match_spans(documents, benchmark, window, block_words, **names)
    n_hit = F.expr("aggregate(spans, struct(0L AS n, -1L AS sign), (a, x) -> struct(a.n + a.sign * x AS n, -a.sign AS sign)).n")
    return found.select(
        F.col("_id").alias(names.get("doc_id", "doc_id")), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (part * n_hit >= F.col("n_words"))).alias("contaminated"), "longest_match")


_word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = to_bytes(text)
    bounds = [m.span() for m in _word.finditer(data)]
    out, at = [], 0
    for lo, hi in zip(spans[0::2], spans[1::2], strict=True):
        out.append(data[at:bounds[lo][0]])
        at = bounds[hi - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove_spans(documents: DataFrame, benchmark: DataFrame, min_words: int = 1, part: int = COVERAGE_PART, window: int = WINDOW,
                 **names) -> DataFrame:
    """doc_id, text, n_removed: in contaminated documents, hit spans of at least ``min_words`` words are cut out."""
    found = match_spans(documents, benchmark, window, **names)
    kind = dict(found.dtypes)["_id"]

    def cut(ids, counts, spans, texts):
        out, removed = [], []
        for n, flat, t in zip(counts, spans, texts, strict=True):
            hit = sum(flat[1::2]) - sum(flat[0::2])
            go = [x for lo, hi in zip(flat[0::2], flat[1::2], strict=True) if hi - lo >= min_words for x in (lo, hi)]
            go = go if hit and part * hit >= n else []
            out.append(cut_spans(t, go) if go else t)
            removed.append(sum(go[1::2]) - sum(go[0::2]))
        return ids, out, removed

    return map_rows(found, ["_id", "n_words", "spans", "_text"], cut,
                    f"`{names.get('doc_id', 'doc_id')}` {kind}, `{names.get('text', 'text')}` string, n_removed bigint")


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = COVERAGE_PART,
                    block_words: int = BLOCK_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``documents``, all columns, that are not contaminated; with several blocks hits are joined over them."""
    blocks = [*shared_blocks(documents, benchmark, window, block_words, item_id, item_text)]

    def decide(texts):
        words = [alnum_words(t) for t in texts]
        spans: list[list[int]] = [[] for _ in texts]
        for name, shared in blocks:
            auto = automaton_of(name, shared, window)
            for i, w in enumerate(words):
                got = auto.scan(w)[0]
                spans[i] = merge_spans(spans[i], got) if got and spans[i] else got or spans[i]
        hits = [sum(s[1::2]) - sum(s[0::2]) for s in spans]
        return [not (h and part * h >= len(w)) for h, w in zip(hits, words, strict=True)]

    return keep_rows(documents, text, decide)
