"""Cutting texts into units that tokenize independently, and a bounded store of what is known about them.

A unit is a run of non-blank characters with at most one space before it, or a stretch of blanks as the pre-token
pattern cuts them; every pre-token lies inside one unit. Texts repeat units, so work is done once for each distinct
unit of a task (and, as Python workers are reused, mostly once per worker) and looked up for the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed value: the characters of ``\\s`` in the tokenizers' patterns (Unicode white space).
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_unit = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
units = _unit.findall

#: Distinct units that one Python worker remembers; beyond them it begins anew.
REMEMBERED = 400_000
#: Characters of remembered units for each of them, so that long stretches without a blank do not pile up.
CHARS_EACH = 64


def pretoken_pattern(pattern: str):
    """The pattern for the ``regex`` library, with white space spelled out as above."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{BLANKS}").replace(r"(?!\S)", f"(?![^{BLANKS}])").replace(r"\s+", f"[{BLANKS}]+"))


class Remembered(dict):
    """What ``work(list of new units)`` said about each unit."""

    def __init__(self, work: Callable, most: int = REMEMBERED):
        super().__init__()
        self.work, self.most, self.chars = work, most, 0

    def learn(self, found: list[list[str]]) -> None:
        new = set().union(*found).difference(self)
        if len(self) + len(new) > self.most or self.chars + sum(map(len, new)) > CHARS_EACH * self.most:
            self.clear()
            self.chars, new = 0, set().union(*found)
        if new:
            new = list(new)
            self.chars += sum(map(len, new))
            self.update(zip(new, self.work(new), strict=True))


_kept: dict = {}


def per_worker(name: str, make: Callable):
    """One object per Python worker and name; another name of the same kind replaces it."""
    kind = name.split(":")[0]
    if _kept.get(kind, ("",))[0] != name:
        _kept[kind] = (name, make())
    return _kept[kind][1]


class Library:
    """The ``tokenizers`` library over many short strings in few calls.

    Strings are joined by a special token of the file and the ids are cut at its id, so each string is encoded alone.
    """

    def __init__(self, definition: str, joined: int = 400):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the one to use
        from tokenizers import Tokenizer

        self.tokenizer, self.joined = Tokenizer.from_str(definition), joined
        added = json.loads(definition)["added_tokens"]
        self.specials = {a["content"]: a["id"] for a in added}
        plain = [a for a in added if a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])]
        # texts with any other added token, or without such a separator, are encoded whole
        self.mark, self.mark_id = (plain[0]["content"], plain[0]["id"]) if len(plain) == len(added) and added else (None, None)

    def encode(self, strings: list[str]) -> list[list[int]]:
        if self.mark is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        lumps = [self.mark.join(strings[i:i + self.joined]) for i in range(0, len(strings), self.joined)]
        out: list[list[int]] = []
        for lump in self.tokenizer.encode_batch_fast(lumps, add_special_tokens=False):
            ids, at, mark = lump.ids, 0, self.mark_id
            try:
                while True:
                    to = ids.index(mark, at)
                    out.append(ids[at:to])
                    at = to + 1
            except ValueError:
                out.append(ids[at:])
        return out
