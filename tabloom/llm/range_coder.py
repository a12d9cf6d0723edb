"""Adaptive context-mixing range coder for token ids, over many independent blocks at once.

A block starts from nothing and is coded alone. For each id two predictions are looked up, the id that last followed the
same two ids (order 2) and the one that last followed the same id (order 1), each with how often it was right. Those
two counts choose one of four contexts. The coded symbol says "as order 2", "as order 1", or the high byte of
another id; a low byte follows only then, from order-0 frequencies. Frequencies adapt: they are counted as symbols are
coded and made anew after 32, 128, 512, ... ids, where a context's counts are mixed with those of all contexts.

All blocks of a file advance in step, as lanes of numpy arrays, so the sequential work is done for thousands of
blocks at a time. A block may be decoded without any other. The range coder has 32-bit state, writes 16-bit words and
settles carries at the end.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block.
BLOCK_IDS = 4096
#: Slots of the order-2 and order-1 predictions of a block; 2 ** SLOT_BITS.
SLOT_BITS = 9
#: Frequencies of a distribution add up to 2 ** TOTAL_BITS.
TOTAL_BITS = 11
FIRST_UPDATE, NEXT_UPDATE = 32, 4
#: Blocks coded in step: enough to outweigh the cost of a numpy call, few enough for about 200 MB.
LANES = 2048
CONTEXTS = 4
SYMBOLS = 258  # 0: order 2 was right, 1: order 1 was right, 2 + high byte otherwise
MAX_ID = 0xFFFF
TOP = np.uint64(1 << 16)
LOW = np.uint64(0xFFFFFFFF)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies of at least 1 that add up to 2 ** TOTAL_BITS along the last axis."""
    total = 1 << TOTAL_BITS
    n = counts.shape[-1]
    f = counts.astype(np.float32)
    f = 1 + (f * (np.float32(total - n) / np.maximum(1, f.sum(-1, keepdims=True)))).astype(np.int32)
    top = counts.argmax(-1)[..., None]
    np.put_along_axis(f, top, np.take_along_axis(f, top, -1) + total - f.sum(-1, keepdims=True), -1)
    return f


class Table:
    """Adaptive distributions of all lanes: counts, frequencies, sums and, for decoding, the symbol of every point."""

    def __init__(self, lanes: int, contexts: int, symbols: int, decoding: bool, weight: int = 32):
        self.lanes, self.contexts, self.symbols, self.decoding, self.weight = lanes, contexts, symbols, decoding, weight
        self.counts = np.zeros(lanes * contexts * symbols, np.uint32)
        self.renew()

    def renew(self) -> None:
        c = self.counts.reshape(self.lanes, self.contexts, self.symbols)
        if self.contexts > 1:
            c = c * 4 + c.sum(1, keepdims=True, dtype=c.dtype)
        f = frequencies(c)
        ends = np.cumsum(f, -1)
        self.freq, self.cum = f.astype(np.uint16).ravel(), (ends - f).astype(np.uint16).ravel()
        if self.decoding:
            self.point = np.repeat(np.tile(np.arange(self.symbols, dtype=np.uint16), self.lanes * self.contexts), f.ravel())


class Encoder:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, LOW, np.uint64)
        self.out, self.at, self.width = np.zeros(lanes * words, np.uint32), np.arange(lanes) * words, words
        self.first = self.at.copy()

    def put(self, lane, row: np.ndarray, symbol: np.ndarray, table: Table) -> None:
        """One symbol for the lanes chosen by ``lane``; ``row`` numbers their distributions."""
        place = row * table.symbols + symbol
        r = self.range[lane] >> np.uint64(TOTAL_BITS)
        low = self.low[lane] + r * table.cum.take(place)
        wide = r * table.freq.take(place)
        at = self.at[lane]
        over = np.flatnonzero(low > LOW)
        if len(over):
            self.out[at[over] - 1] += np.uint32(1)
            low &= LOW
        small = np.flatnonzero(wide < TOP)
        if len(small):
            some = low[small]
            self.out[at[small]] = (some >> np.uint64(16)).astype(np.uint32)
            low[small] = (some & np.uint64(0xFFFF)) << np.uint64(16)
            wide[small] <<= np.uint64(16)
            at[small] += 1
            self.at[lane] = at
        self.low[lane], self.range[lane] = low, wide
        table.counts[place] += np.uint32(table.weight)

    def finish(self) -> list[bytes]:
        for shift in (16, 0):
            self.out[self.at] = ((self.low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint32)
            self.at += 1
        words = self.out.reshape(len(self.first), self.width)
        carry = np.zeros(len(words), np.uint32)
        for i in range(int((self.at - self.first).max()) - 1, -1, -1):
            column = words[:, i] + carry
            words[:, i], carry = column & np.uint32(0xFFFF), column >> np.uint32(16)
        packed = words.astype("<u2")
        return [packed[i, :n].tobytes() for i, n in enumerate((self.at - self.first).tolist())]


class Decoder:
    def __init__(self, blocks: list[bytes]):
        lengths = [len(b) // 2 for b in blocks]
        self.words = np.frombuffer(b"".join(blocks) + b"\0\0", "<u2").astype(np.uint64)
        self.at = np.cumsum([0, *lengths[:-1]])
        self.code = self.words[self.at] << np.uint64(16) | self.words[self.at + 1]
        self.at += 2
        self.range = np.full(len(blocks), LOW, np.uint64)

    def get(self, lane, row: np.ndarray, table: Table) -> np.ndarray:
        r = self.range[lane] >> np.uint64(TOTAL_BITS)
        code = self.code[lane]
        point = np.minimum(code // r, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
        symbol = table.point.take((row << TOTAL_BITS) + point)
        place = row * table.symbols + symbol
        code -= r * table.cum.take(place)
        wide = r * table.freq.take(place)
        small = np.flatnonzero(wide < TOP)
        if len(small):
            at = self.at[lane]
            # a damaged block may ask for words beyond the end; its checksum tells
            code[small] = code[small] << np.uint64(16) | self.words[np.minimum(at[small], len(self.words) - 1)]
            wide[small] <<= np.uint64(16)
            at[small] += 1
            self.at[lane] = at
        self.code[lane], self.range[lane] = code, wide
        table.counts[place] += np.uint32(table.weight)
        return symbol


class Predictor:
    """Order-2 and order-1 predictions of all lanes: the id in the high bits, how often it was right (0 to 2) below."""

    def __init__(self, lanes: int):
        self.two, self.one = np.zeros(lanes << SLOT_BITS, np.uint32), np.zeros(lanes << SLOT_BITS, np.uint32)
        self.base = np.arange(lanes) << SLOT_BITS
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def ask(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the first ``n`` lanes: both predictions and the context."""
        last, shift = self.last[:n] * np.uint32(0x9E3779B1), np.uint32(32 - SLOT_BITS)
        self.at_one = self.base[:n] + (last >> shift)
        self.at_two = self.base[:n] + ((last ^ self.before[:n] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> shift)
        self.got_one, self.got_two = self.one.take(self.at_one), self.two.take(self.at_two)
        return self.got_two >> 2, self.got_one >> 2, ((self.got_two & 3) > 0) * np.uint32(2) + ((self.got_one & 3) > 0)

    def tell(self, n: int, ids: np.ndarray) -> None:
        for table, at, got in ((self.two, self.at_two, self.got_two), (self.one, self.at_one, self.got_one)):
            table[at] = np.where(got >> 2 == ids, got + ((got & 3) < 2), ids << 2)
        self.before[:n], self.last[:n] = self.last[:n], ids


def lengths_of(n: int, block: int) -> list[int]:
    return [min(block, n - i) for i in range(0, n, block)]


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> list[bytes]:
    """One packed block for every ``block`` ids; the last may be shorter."""
    return [b for i in range(0, len(ids), block * LANES) for b in encode_lanes(ids[i:i + block * LANES], block)]


def decode(blocks: list[bytes], n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ``n`` ids behind the packed blocks."""
    if len(blocks) != -(-n // block):
        raise ValueError(f"{len(blocks)} blocks for {n} ids")
    parts = [decode_lanes(blocks[i:i + LANES], min(n - i * block, LANES * block), block) for i in range(0, len(blocks), LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_lanes(ids: np.ndarray, block: int) -> list[bytes]:
    if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
        raise ValueError(f"ids must lie in 0..{MAX_ID}")
    lengths = lengths_of(len(ids), block)
    lanes = len(lengths)
    grid = np.zeros((lanes, block), np.uint32)
    grid.ravel()[:len(ids)] = ids
    grid = np.ascontiguousarray(grid[:, :max(lengths)].T)
    coder, guess = Encoder(lanes, 2 * max(lengths) + 4), Predictor(lanes)
    main, tail = Table(lanes, CONTEXTS, SYMBOLS, False), Table(lanes, 1, 256, False)
    renew, n, every = FIRST_UPDATE, lanes, np.arange(lanes)
    for i in range(max(lengths)):
        n = lanes if i < lengths[-1] else lanes - 1
        want = grid[i, :n]
        two, one, context = guess.ask(n)
        symbol = np.where(want == two, 0, np.where(want == one, 1, (want >> 8) + 2))
        coder.put(slice(0, n), every[:n] * CONTEXTS + context, symbol, main)
        other = np.flatnonzero(symbol > 1)
        if len(other):
            coder.put(other, other, want[other] & 255, tail)
        guess.tell(n, want)
        if i + 1 == renew:
            main.renew()
            tail.renew()
            renew *= NEXT_UPDATE
    return coder.finish()


def decode_lanes(blocks: list[bytes], n: int, block: int) -> np.ndarray:
    lengths = lengths_of(n, block)
    lanes = len(lengths)
    grid = np.zeros((max(lengths), lanes), np.uint32)
    coder, guess = Decoder(blocks), Predictor(lanes)
    main, tail = Table(lanes, CONTEXTS, SYMBOLS, True), Table(lanes, 1, 256, True)
    renew, every = FIRST_UPDATE, np.arange(lanes)
    for i in range(max(lengths)):
        n = lanes if i < lengths[-1] else lanes - 1
        two, one, context = guess.ask(n)
        symbol = coder.get(slice(0, n), every[:n] * CONTEXTS + context, main)
        ids = np.where(symbol == 0, two, one).astype(np.uint32)
        other = np.flatnonzero(symbol > 1)
        if len(other):
            low = coder.get(other, other, tail)
            ids[other] = (symbol[other].astype(np.uint32) - 2) << 8 | low
        grid[i, :n] = ids
        guess.tell(n, ids)
        if i + 1 == renew:
            main.renew()
            tail.renew()
            renew *= NEXT_UPDATE
    return grid.T.ravel()[:sum(lengths)] if lengths[-1] == max(lengths) or lanes == 1 else np.concatenate([grid.T[:-1].ravel(), grid[:lengths[-1], -1]])
