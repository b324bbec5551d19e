"""Exact BPE encoding and decoding for vocabularies of the tokenizers library with word ends.

Frequent words are looked up in a minimal acyclic automaton (a DAFSA: shared prefixes and shared suffixes) that numbers
its words; the number leads to the word's ids. The automaton is one flat file that every worker maps into memory. Words
that it lacks are merged exactly, rank by rank, so the lexicon never changes a result.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import unicodedata
from array import array
from functools import cached_property

#: Characters for which this module normalizes and splits by itself; texts with others go through the library's own steps.
_PLAIN = {*range(0x1C), *range(0x20, 0x0250), *range(0x2010, 0x2028), 0x20AC}
_PLAIN = sorted(c for c in _PLAIN if {*map(ord, chr(c).lower())} <= _PLAIN)
_SPACE = set(map(chr, (*range(9, 14), 32, 0x85, 0xA0)))
MAGIC = b"LEXA"
#: Leading bytes of a word that are looked up at once.
HEAD = 4


def _classes() -> tuple[str, str, str]:
    letters, numbers, rest = [], [], []
    for c in map(chr, _PLAIN):
        kind = unicodedata.category(c)[0]
        if c not in _SPACE:
            (letters if kind == "L" else numbers if kind == "N" else rest).append(re.escape(c))
    return "".join(letters), "".join(numbers), "".join(rest)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Vocabulary:
    """A word-end BPE model read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only byte-level BPE models without unknown token are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_chars()
        letters, numbers, rest = _classes()
        plain = re.compile(f"[{letters}{numbers}{rest}{''.join(map(re.escape, sorted(_SPACE)))}]*")
        self.plain = plain.fullmatch  # whether this module handles a text; str.split() then splits where the model does
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{rest}]+").findall
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def symbols(self) -> tuple[dict[str, int], list[int], list[int], list[int | None], list[dict[int, int]]]:
        """Numbers of the parts of words; those of each byte within a word and at its end; per part its id, if any, and its merges
        with what may follow: rank << 32 | the whole's number. Characters that are no part have the number after the last."""
        ends = [c + self.end for c in self.bytes]
        names = list(dict.fromkeys([*self.bytes, *ends, *self.vocab, *(x for a, b in self.pairs for x in (a, b, a + b))]))
        number, none = {x: i for i, x in enumerate(names)}, {}
        after: list[dict[int, int]] = [none] * (len(names) + 1)
        for rank, (a, b) in enumerate(self.pairs):
            left = number[a]
            if after[left] is none:
                after[left] = {}
            after[left][number[b]] = rank << 32 | number[a + b]
        return number, [number[c] for c in self.bytes], [number[c] for c in ends], [*map(self.vocab.get, names), None], after

    def merge(self, word: str) -> list[int]:
        """Ids of one byte-level word: always the pair of least rank, leftmost first."""
        if not word:
            return []
        number, other = self.symbols[0].get, len(self.symbols[0])
        return self._merged([*[number(c, other) for c in word[:-1]], number(word[-1] + self.end, other)])

    def merge_bytes(self, word: bytes) -> list[int]:
        """merge() of the word that stands for these bytes."""
        if not word:
            return []
        _, inner, last, _, _ = self.symbols
        parts = [inner[b] for b in word]
        parts[-1] = last[word[-1]]
        return self._merged(parts)

    def _merged(self, parts: list[int]) -> list[int]:
        _, _, _, ids, after = self.symbols
        none = 1 << 62
        ranks = [after[a].get(b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] = whole = best & 0xFFFFFFFF
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = after[parts[at - 1]].get(whole, none)
            if at < len(ranks):
                ranks[at] = after[whole].get(parts[at + 1], none)
        return [i for p in parts if (i := ids[p]) is not None]

    def level(self, word: str) -> str:
        return "".join([self.bytes[b] for b in word.encode("utf-8")])

    def words(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, normalized, before the byte level."""
        if self.plain(text):
            return self.split(text.lower())
        lib = self.library
        back = {c: b for b, c in enumerate(self.bytes)}
        pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Plain stretches and special tokens in order: (text, None) or (token, its id)."""
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]


class Lexicon:
    """The mapped automaton. Built by compile_lexicon; find() gives a word's ids or None."""

    def __init__(self, data):
        head = struct.unpack_from("<4s5I", data, 0)
        if head[0] != MAGIC:
            raise ValueError("not a lexicon")
        _, states, arcs, words, ids, _ = head
        view, at = memoryview(data), 24
        self.first = view[at : at + 4 * (states + 1)].cast("I")
        at += 4 * (states + 1)
        self.target = view[at : at + 4 * arcs].cast("I")
        at += 4 * arcs
        self.skip = view[at : at + 4 * arcs].cast("I")
        at += 4 * arcs
        self.offset = view[at : at + 4 * (words + 1)].cast("I")
        at += 4 * (words + 1)
        self.ids = view[at : at + 4 * ids]
        at += 4 * ids
        self.final = view[at : at + states]
        self.labels_at, self.data = at + states, data
        self.heads: dict[bytes, tuple[int, int]] = {}  # where HEAD bytes lead; only those with which some word begins

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, word: bytes) -> bytes | None:
        """The ids as little-endian unsigned 32-bit integers."""
        first, target, skip, base, find = self.first, self.target, self.skip, self.labels_at, self.data.find
        known = self.heads.get(head := word[:HEAD])
        state, number = known or (0, 0)
        for i in range(HEAD if known else 0, len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            number += skip[arc]
            state = target[arc]
            if i == HEAD - 1:
                self.heads[head] = state, number
        if not self.final[state]:
            return None
        return bytes(self.ids[4 * self.offset[number] : 4 * self.offset[number + 1]])


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the keys (incremental construction from sorted words) with the ids as outputs.

    Equal right languages are one state, so suffixes are shared; the path's skips add up to the word's rank in order.
    """
    children: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) from the root to the last word's end
    last = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            state, label = path.pop()
            child = children[state][label]
            key = (final[child], tuple(children[child].items()))
            children[state][label] = register.setdefault(key, child)

    ordered = sorted(entries)
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = children[path[-1][0]][path[-1][1]] if path else 0
        for b in word[common:]:
            children.append({})
            final.append(False)
            children[state][b] = len(children) - 1
            path.append((state, b))
            state = len(children) - 1
        final[state] = True
        last = word
    settle(0)
    number, order, count = {0: 0}, [0], {}
    for s in order:  # breadth first: the states that are still in use
        for c in children[s].values():
            if c not in number:
                number[c] = len(order)
                order.append(c)
    stack = [0]
    while stack:  # words below each state, children first
        s = stack[-1]
        todo = [c for c in children[s].values() if c not in count]
        if todo:
            stack += todo
        else:
            stack.pop()
            count[s] = final[s] + sum(count[c] for c in children[s].values())
    first, target, skip, labels, ends = array("I", [0]), array("I"), array("I"), bytearray(), bytearray()
    for s in order:
        before = int(final[s])
        for b, c in sorted(children[s].items()):
            labels.append(b)
            target.append(number[c])
            skip.append(before)
            before += count[c]
        ends.append(final[s])
        first.append(len(labels))
    offset, ids = array("I", [0]), array("I")
    for word in ordered:
        ids.extend(entries[word])
        offset.append(len(ids))
    head = struct.pack("<4s5I", MAGIC, len(order), len(labels), len(ordered), len(ids), 0)
    return head + b"".join(x.tobytes() for x in (first, target, skip, offset, ids)) + bytes(ends) + bytes(labels)


class Known(dict):
    """What was made of a key before. Two generations of `half` entries each: memory stays bounded, frequent keys stay known."""

    def __init__(self, make, half: int = 250_000):
        super().__init__()
        self.make, self.half, self.old = make, half, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Recurring(dict):
    """Known for streams in which most keys come once: a new key waits, and is stored when it comes again.

    Two generations of `half` entries each and one of `waiting` that is emptied when full.
    """

    def __init__(self, make, half: int, waiting: int):
        super().__init__()
        self.make, self.half, self.most_waiting, self.old, self.waiting = make, half, waiting, {}, {}

    def __missing__(self, key: str):
        out = self.waiting.pop(key, None)
        if out is None and (out := self.old.get(key)) is None:
            out = self.make(key)
            if len(self.waiting) >= self.most_waiting:
                self.waiting.clear()
            self.waiting[key] = out
            return out
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """Encodes and decodes as the tokenizers library does with add_special_tokens=False."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known = Known(self.chunk, 350_000)  # of words too, so that those that also stand alone are held once

    def word(self, word: str) -> tuple[bytes, str]:
        v = self.vocabulary
        raw = word.encode("utf-8", "surrogateescape")
        ids = self.lexicon.find(raw) if self.lexicon else None
        ids = array("I", v.merge_bytes(raw) if ids is None else ids)
        return ids.tobytes(), " ".join([v.tokens[i] for i in ids])

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same for what stands between white space: its pieces depend on nothing around it."""
        if chunk.isalpha():  # one piece
            return self.word(chunk)
        pieces = self.vocabulary.split(chunk)
        if len(pieces) == 1:
            return self.word(chunk)
        found = [self.known[w] for w in pieces]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text (no decoder: tokens joined by spaces)."""
        if not text:
            return b"", ""
        found: list[tuple[bytes, str]] = []
        for part, special in self.vocabulary.segments(text) if "<|" in text else [(text, None)]:
            if special is not None:
                found.append((struct.pack("<I", special), part))
            elif self.vocabulary.plain(part):
                found += map(self.known.__getitem__, part.lower().split())
            else:
                found += [self.word(w) for w in self.vocabulary.words(part)]
        if not found:
            return b"", ""
        ids, tokens = zip(*found, strict=True)
        return b"".join(ids), " ".join(tokens if all(ids) else [x for i, x in found if i])
