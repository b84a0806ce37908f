"""BPE encoding and decoding with a memory-mapped lexicon of frequent words.

The frequent words of the corpus, counted over all documents, are compiled into a minimal acyclic transducer: an
automaton over the words' bytes whose equal suffixes are one state, with numbers on its arcs that add up to a word's
place in a table of token ids. The automaton is a flat block of bytes which every worker maps into memory. A word that
is not in it is merged exactly, by the vocabulary's merge ranks.

The vocabulary is a file of the tokenizers library with: special tokens found in the raw text, NFC, lower case, words
by a fixed pattern, bytes as visible characters, an end-of-word suffix and no decoder (decoding joins tokens by a
space). Its path is a parameter.

White space, letters and digits are those of Unicode 16, lower case is that of Unicode 17, and NFC that of the running Python.

Defined results: a null text is empty; an empty text has no tokens, and its ids and decoded text are empty strings; very
long words merge in n log n; repeated rows give repeated results; an empty table gives an empty result; null ids stay
null; clashing columns are not read.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import hashlib
import heapq
import itertools
import json
import mmap
import operator
import os
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import in_small_batches, staged, tidy

#: Words in the lexicon at most, and bytes of a word in it at most: they bound what is broadcast to about 4 MB.
LEXICON_WORDS = 50_000
LEXICON_BYTES = 40
#: Distinct chunks between spaces that a task counts before it passes the counts on, and that it keeps the tokens of.
COUNTED_CHUNKS = 250_000
KNOWN_CHUNKS = 200_000
#: Letters of a word from which on merging uses a heap.
LONG_WORD = 48
#: Rows of a batch that are worked on at once.
SLICE = 512

# Fixed values of the tokenizer: its word pattern and Unicode's white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^%s\p{L}\p{N}]+" % _SPACE
# The letters and digits that Unicode 16 added, which is the tokenizer's version. Of any later version's it knows none.
_UNICODE_16 = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 "
    "113d3 116d0-116e3 11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"
)
# The capitals that Unicode 16 and 17 added, and how far off the small letter is.
_LATE_CAPITALS = {0x1C89: 1, 0xA7CB: 0x264 - 0xA7CB, 0xA7CC: 1, 0xA7CE: 1, 0xA7D2: 1, 0xA7D4: 1, 0xA7DA: 1, 0xA7DC: 0x19B - 0xA7DC}
_LATE_CAPITALS |= dict.fromkeys(range(0x10D50, 0x10D66), 0x20) | dict.fromkeys(range(0x16EA0, 0x16EB9), 0x1B)
_LATE = regex.compile("[" + "".join(map(chr, _LATE_CAPITALS)) + "]")
#: Below this code point all Unicode versions agree.
_AGREED = "\u0557"


@functools.cache
def _patterns():
    """The word pattern; a search for characters on which Unicode versions may differ; the word pattern without later letters."""
    known = set()
    for part in _UNICODE_16.split():
        lo, _, hi = part.partition("-")
        known.update(range(int(lo, 16), int(hi or lo, 16) + 1))
    everything = "".join(chr(c) for c in range(ord(_AGREED), 0x110000) if not 0xD800 <= c < 0xE000)
    later = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    # as ranges: a set of thousands of single characters takes 30 times as long to match
    runs = [[c for _, c in run] for _, run in itertools.groupby(enumerate(later), lambda x: x[1] - x[0])]
    later = "".join(f"{chr(run[0])}-{chr(run[-1])}" for run in runs)
    less = f"--[{later}]]"
    careful = _PATTERN.replace(r"[\p{L}]", r"[\p{L}" + less).replace(r"[\p{N}]", r"[\p{N}" + less).replace(r"\p{L}\p{N}]+", r"[\p{L}\p{N}" + less + "]+") if later else _PATTERN
    return regex.compile(_PATTERN), regex.compile(f"[^\x00-{_AGREED}]"), regex.compile(careful, regex.V1)


#: What str.split takes for space and the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _split_words(text: str) -> list[str]:
    plain, rare, careful = _patterns()
    return (careful if not text.isascii() and rare.search(text) else plain).findall(text)


def byte_letters() -> list[str]:
    """The visible character of each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Vocabulary:
    """Token ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model = raw["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks: dict[int, int] = {}  # of the pair with ids a and b, under a << 32 | b
        self.merged: list[int] = []  # the id that the pair of a rank becomes
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault(self.ids[a] << 32 | self.ids[b], rank)
            self.merged.append(self.ids[a + b])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = [self.ids[c] for c in byte_letters()]
        self.endings = [self.ids[c + self.suffix] for c in byte_letters()]
        self.lead = os.path.commonprefix([*self.special])
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def chunks(self, text: str | None) -> list[str]:
        """A text after normalising, cut at spaces; a special token stands as itself. No word reaches over two chunks."""
        if not text:
            return []
        if self.splitter is None or self.lead not in text:
            return self._cut(text)
        out: list[str] = []
        for k, piece in enumerate(self.splitter.split(text)):
            out.extend((piece,) if k % 2 else self._cut(piece))
        return out

    def _cut(self, text: str) -> list[str]:
        text = _normal(text)
        return ([text] if _split_words(text) else []) if any(c in text for c in _ODD) else text.split()

    def words(self, text: str | None) -> list[str]:
        """The words of a text."""
        return [w for c in self.chunks(text) for w in self.words_of_chunk(c)]

    def words_of_chunk(self, chunk: str) -> list[str]:
        if chunk.isalpha():  # the common cases: letters only (what Python knows as such, later Unicode does too), or with one sign at the end
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return [chunk] if chunk in self.special else _split_words(chunk)

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by merging the pair of least rank, the leftmost first, until none is left."""
        if word in self.special:
            return [self.special[word]]
        raw = word.encode("utf-8", "replace")
        parts = [self.letters[b] for b in raw[:-1]]
        parts.append(self.endings[raw[-1]])
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, never = self.ranks.get, len(self.merged)
        ranks = [rank(a << 32 | b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            del ranks[i], parts[i]
            parts[i] = one = self.merged[least]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | one, never)
            if i < len(ranks):
                ranks[i] = rank(one << 32 | parts[i + 1], never)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, in n log n."""
        n, gone = len(parts), -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (r := self.ranks.get(parts[a] << 32 | parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.merged[least], gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p != gone]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space; an id that the vocabulary lacks is left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _normal(text: str) -> str:
    """NFC and lower case by single characters (a final sigma is no special case)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = _LATE.sub(lambda found: chr(ord(found[0]) + _LATE_CAPITALS[ord(found[0])]), text)
    return text.lower()


class _Table:
    """A map from non-negative numbers to small ones, for many keys at a time: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int):
        self.none, self.bits = np.int32(none), max(8, int(len(keys) * 8).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, none, np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.setdiff1d(np.arange(len(keys)), won)
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        found = self.keys[at]
        same = found == keys
        out = np.where(same, self.values[at], self.none)
        todo = np.flatnonzero(~same & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


#: Widest words, in bytes, of the matrices that words are sorted into.
WIDTHS = (6, 8, 10, 12, 16, 24, LONG_WORD)
_WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(LONG_WORD + 1)]


def _matrices(raw: list[bytes], places: Iterable[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The words at places, none longer than LONG_WORD, as rows of bytes by width: their places, lengths and bytes."""
    by_width: dict[int, list[int]] = {w: [] for w in WIDTHS}
    for n in places:
        by_width[_WIDTH_OF[len(raw[n])]].append(n)
    for width, own in by_width.items():
        if own:
            lengths = np.fromiter((len(raw[n]) for n in own), np.int64, len(own))
            rows = np.zeros((len(own), width), np.uint8)
            rows[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join([raw[n] for n in own]), np.uint8)
            yield own, lengths, rows


class Merger:
    """Merges many words at once: their symbols are rows of a matrix, and each step merges one pair of every row."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.never = vocab, len(vocab.merged)
        self.none = np.int32(max(vocab.tokens) + 1)  # a symbol that makes no pair
        self.merged = np.array([*vocab.merged, self.none], np.int32)
        self.letters, self.endings = np.array(vocab.letters, np.int32), np.array(vocab.endings, np.int32)
        n = len(vocab.ranks)
        self.ranks = _Table(np.fromiter(vocab.ranks, np.int64, n), np.fromiter(vocab.ranks.values(), np.int32, n), self.never)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or never."""
        return self.ranks.get((left.astype(np.int64) << 32) | right)

    def merge(self, words: list[str]) -> list[list[int]]:
        """What Vocabulary.merge gives of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[list[int]] = [[]] * len(words)
        short = []
        for n, b in enumerate(raw):
            if len(b) > LONG_WORD or words[n] in self.vocab.special:
                out[n] = self.vocab.merge(words[n])
            else:
                short.append(n)
        for places, lengths, rows in _matrices(raw, short):
            k, width = np.arange(len(places)), rows.shape[1]
            symbols = np.full((len(places), width + 1), self.none, np.int32)  # the last column stays free
            symbols[:, :width] = np.where(np.arange(width) < lengths[:, None], self.letters[rows], self.none)
            symbols[k, lengths - 1] = self.endings[rows[k, lengths - 1]]
            for n, row in self._merged_rows(symbols):
                out[places[n]] = row
        return out

    def _merged_rows(self, symbols: np.ndarray):
        """(row, ids) of each row of symbols, as it is done."""
        n, width = symbols.shape
        ranks = self.rank_of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        places, rows = np.arange(width), np.arange(n)
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == self.never
            if done.any():
                lengths = (symbols[done] != self.none).sum(axis=1).tolist()
                yield from ((k, row[:length]) for k, row, length in zip(rows[done].tolist(), symbols[done].tolist(), lengths, strict=True))
                rows, symbols, ranks, at, least = rows[~done], symbols[~done], ranks[~done], at[~done], least[~done]
                if not len(rows):
                    return
            k, moved = np.arange(len(rows)), places >= at[:, None] + 1
            # what stands behind the pair moves up by one
            symbols[:, :-1] = np.where(moved[:, :-1], symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(moved[:, 1:-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.never
            symbols[k, at] = self.merged[least]
            ranks[k, at] = self.rank_of(symbols[k, at], symbols[k, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.rank_of(symbols[before, at[before] - 1], symbols[before, at[before]])


class Lexicon:
    """A minimal acyclic transducer from words to ids, read from a block of bytes."""

    _HEAD = struct.Struct("<4I")

    def __init__(self, block):
        states, arcs, words, ids = self._HEAD.unpack_from(block, 0)
        at = self._HEAD.size

        def column(kind: str, n: int) -> memoryview:
            nonlocal at
            view = memoryview(block)[at : at + n * struct.calcsize(kind)].cast(kind)
            at += -(-len(view) * view.itemsize // 4) * 4
            return view

        self.first, self.skip, self.target = column("I", states + 1), column("I", arcs), column("I", arcs)
        self.start, self.out = column("I", words + 1), column("I", ids)
        self.label, self.final = column("B", arcs), column("B", states)
        states_of = np.repeat(np.arange(states, dtype=np.int64), np.diff(np.asarray(self.first).astype(np.int64)))
        self.arcs = _Table(states_of << 8 | np.asarray(self.label), np.arange(arcs, dtype=np.int32), -1)

    @classmethod
    def mapped(cls, block: bytes) -> Lexicon:
        """The lexicon over a memory map of an anonymous file: nothing is left in any folder."""
        if not hasattr(os, "memfd_create"):
            return cls(block)
        handle = os.memfd_create("lexicon")
        with os.fdopen(handle, "wb") as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ))

    def find_all(self, words: list[str]) -> list[list[int] | None]:
        """The ids of each word; None of words that the lexicon lacks. All words walk the automaton side by side."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[list[int] | None] = [None] * len(words)
        skip, target, final = (np.asarray(x).astype(np.int64) for x in (self.skip, self.target, self.final))
        for places, lengths, rows in _matrices(raw, [n for n, b in enumerate(raw) if 0 < len(b) <= LEXICON_BYTES]):
            state, place, on = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), np.arange(len(places))
            for k in range(rows.shape[1] + 1):
                ends = on[lengths[on] == k]
                for n in ends[final[state[ends]] == 1].tolist():
                    at = int(place[n])
                    out[places[n]] = list(self.out[self.start[at] : self.start[at + 1]])
                on = on[lengths[on] > k]
                if not len(on):
                    break
                arc = self.arcs.get(state[on] << 8 | rows[on, k])
                on, arc = on[arc >= 0], arc[arc >= 0]
                place[on] += skip[arc]
                state[on] = target[arc]
        return out

    def find(self, word: str) -> list[int] | None:
        """The ids of one word."""
        return self.find_all([word])[0]

    @classmethod
    def compile(cls, words: dict[str, list[int]]) -> bytes:
        """The block of a lexicon. Words are added in byte order; a state is settled, and shared with an equal one, as soon as no later word can change it."""
        settled: dict[tuple, int] = {}
        kinds: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in settled:
                settled[key] = len(kinds)
                kinds.append(key)
            return settled[key]

        by_bytes = sorted((w.encode("utf-8", "replace"), ids) for w, ids in words.items() if w)
        path: list[list] = [[False, []]]  # open states along the last word: final, arcs
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))

        for word, _ in by_bytes:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        root = settle(path[0])
        below: list[int] = []  # words from a state on; targets are settled before it
        for final, arcs in kinds:
            below.append(final + sum(below[t] for _, t in arcs))
        number = {root: 0} | {k: k + 1 for k in range(root)}  # the root, settled last, is state 0
        first, skip, target, label, finals = [0], [], [], [], []
        for k in [root, *range(root)]:
            final, arcs = kinds[k]
            ahead = int(final)
            for b, t in arcs:
                label.append(b)
                target.append(number[t])
                skip.append(ahead)
                ahead += below[t]
            first.append(len(label))
            finals.append(int(final))
        start = np.cumsum([0, *(len(ids) for _, ids in by_bytes)])
        out = [i for _, ids in by_bytes for i in ids]
        blocks = [np.array(x, dtype="<u4").tobytes() for x in (first, skip, target, start, out)]
        blocks += [np.array(x, dtype="u1").tobytes() for x in (label, finals)]
        pad = lambda b: b + bytes(-len(b) % 4)
        return cls._HEAD.pack(len(finals), len(label), len(by_bytes), len(out)) + b"".join(map(pad, blocks))


class _Known(dict):
    """(ids, tokens, both joined by spaces) of chunks. It takes new ones until it is full: the frequent ones come early."""

    def __init__(self, vocab: Vocabulary, block: bytes, room: int | None = None):
        super().__init__()
        self.room = KNOWN_CHUNKS if room is None else room
        self.vocab, self.lexicon, self.merger = vocab, Lexicon.mapped(block), Merger(vocab)
        most = max(vocab.tokens) + 1
        self.numbers, self.tokens = list(map(str, range(most))), [vocab.tokens.get(i, "") for i in range(most)]

    def of(self, texts: list[str | None]) -> list[list[tuple[str, str]]]:
        """What belongs to each text's chunks, in order."""
        chunks = [self.vocab.chunks(t) for t in texts]
        here, new = {}, []
        for c in set().union(*chunks):
            found = self.get(c)
            if found is None:
                new.append(c)
            else:
                here[c] = found
        if new:
            self._work_out(new, here)
        return [list(map(here.__getitem__, cs)) for cs in chunks]

    def _work_out(self, new: list[str], here: dict[str, tuple[str, str]]) -> None:
        """Put into here what belongs to chunks that are not known: words from the lexicon, or else merged, all at once."""
        number, token, words_of = self.numbers.__getitem__, self.tokens.__getitem__, self.vocab.words_of_chunk
        split = {c: words_of(c) for c in new}
        fresh = {w for ws in split.values() for w in ws if w not in here}
        for w in [w for w in fresh if w in self]:
            here[w] = self[w]
            fresh.remove(w)
        words = list(fresh)
        found = self.lexicon.find_all(words)
        unseen = [n for n, ids in enumerate(found) if ids is None]
        for n, ids in zip(unseen, self.merger.merge([words[n] for n in unseen]), strict=True):
            found[n] = ids
        for w, ids in zip(words, found, strict=True):
            here[w] = (number(ids[0]), token(ids[0])) if len(ids) == 1 else (" ".join(map(number, ids)), " ".join(map(token, ids)))
        for c, ws in split.items():
            if len(ws) == 2:
                (a, b), (x, y) = here[ws[0]], here[ws[1]]
                here[c] = f"{a} {x}", f"{b} {y}"
            elif len(ws) != 1 or ws[0] != c:
                parts = [here[w] for w in ws]
                here[c] = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
        room = self.room - len(self)
        if room > 0:
            self.update((c, here[c]) for c in itertools.islice(itertools.chain(words, new), room))


@contextlib.contextmanager
def _table(vocab: Vocabulary, block: bytes, room: int | None = None) -> Iterator[_Known]:
    """The table of one task. It holds strings only, in which the collector would look for cycles again and again; and it
    goes with the task, as the worker lives on."""
    known, collects = _Known(vocab, block, room), gc.isenabled()
    gc.disable()
    try:
        yield known
    finally:
        known.clear()
        if collects:
            gc.enable()


def _slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frequent_words(texts: DataFrame, vocab, n: int = LEXICON_WORDS, counted: int = COUNTED_CHUNKS) -> DataFrame:
    """The words that are most frequent in all texts, n at most, with their counts.

    Tasks count first, and words are shuffled once each. Words of about the same count come or stay away together.
    """

    def count(batches):
        v, seen = vocab.value, Counter()

        def counts():
            words: Counter[str] = Counter()
            for chunk, n in seen.items():
                for word in v.words_of_chunk(chunk):
                    words[word] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=out)

        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(v.chunks(text))
            if len(seen) >= counted:
                yield counts()
        if seen:
            yield counts()

    out = pa.schema([("word", pa.string()), ("n", pa.int64())])
    counts = staged(texts.mapInArrow(tidy(count), "word string, n long").where(F.octet_length("word") <= LEXICON_BYTES).groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least count, in steps of a sixteenth of an octave, down to which there are no more than n words
    step = F.floor(F.log2("n") * 16).cast("int")
    least, words = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):  # some hundred rows
        words += r["words"]
        if words > n:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


def lexicon_for(texts: DataFrame, vocab: Vocabulary, shared, counted: int = COUNTED_CHUNKS) -> bytes:
    """The lexicon of the frequent words of texts. LEXICON_WORDS rows reach the driver at most."""
    return Lexicon.compile({r["word"]: vocab.merge(r["word"]) for r in frequent_words(texts, shared, counted=counted).collect()})


def encode(docs: DataFrame, vocab_path: str, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, with ids array<int> of every whole text."""
    spark, keep = in_small_batches(docs).sparkSession, list(keep)
    vocab = Vocabulary(vocab_path)
    shared = spark.sparkContext.broadcast(vocab)
    block = spark.sparkContext.broadcast(lexicon_for(docs.select(text), vocab, shared))

    def run(batches):
        v = shared.value
        with _table(v, block.value) as known:
            for batch in _slices(batches):
                rows = [np.array(" ".join([x[0] for x in found]).split(), dtype=np.int32) for found in known.of(batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.int32()))], names=[*keep, "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(tidy(run), f"{kinds}, ids array<int>")


def decode(rows: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """rows with a column decoded: the text that the tokens of ids give. Null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(lambda x: None if x is None else shared.value.decode(map(int, x)))

    return rows.withColumn("decoded", text_of(F.col(ids)))


def digest(docs: DataFrame, vocab_path: str, keep: Iterable[str] = (), with_ids: bool = False, chunks: int | None = None, rows: int = SLICE) -> DataFrame:
    """doc_id, n_tokens, and the hashes of ids and of the decoded text, of every whole text; after them the columns keep and, if asked for, ids.

    chunks: distinct ones that a task keeps at once, and rows: texts that it works on at once. Fewer take less memory and
    more time, and give the same.
    """
    spark, keep = in_small_batches(docs).sparkSession, list(keep)
    vocab = Vocabulary(vocab_path)
    shared = spark.sparkContext.broadcast(vocab)
    block = spark.sparkContext.broadcast(lexicon_for(docs.select("text"), vocab, shared, chunks or COUNTED_CHUNKS))

    def run(batches):
        v, first, second = shared.value, operator.itemgetter(0), operator.itemgetter(1)
        with _table(v, block.value, chunks) as known:
            for batch in _slices(batches, rows):
                n, of_ids, of_text, all_ids = [], [], [], []
                for found in known.of(batch.column(0).to_pylist()):
                    ids = " ".join(map(first, found))
                    n.append(ids.count(" ") + 1 if ids else 0)
                    of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                    of_text.append(hashlib.sha256(" ".join(map(second, found)).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids.split(), dtype=np.int32))
                made = [batch.column(1), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*made, pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else made, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep, *["ids"] * with_ids]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *keep).schema]
    schema = ", ".join([kinds[0], "n_tokens long, ids_sha256 string, decoded_sha256 string", *kinds[1:], *["ids array<int>"] * with_ids])
    return docs.select(F.col("text").alias("_text"), "doc_id", *keep).mapInArrow(tidy(run), schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
