"""Token counts from a compiled tokenizer (operator 2).

The tokenizer is compiled into a cascade of two deterministic transducers.

Scanner.  The pre-tokenizer's pattern is a transducer over character classes
(`compile_scanner`): each transition carries how many pretokens it emits and
where they start, with at most one character of delay.  A text is cut into
chunks; each chunk is summarised, for every state it might begin in, by the
state it ends in (`state_maps`); the maps compose by a parallel prefix scan
(`scan`), which fixes every chunk's first state, and then all chunks emit at
once.  All chunks of all texts of a slice advance in lock step, so nothing is
done character by character in Python.

Lexicon.  The vocabulary is a transducer over bytes (`Lexicon`): an automaton
that knows at every byte which tokens end there.  Of these exactly one is the
last token of the merged text so far, the one whose neighbour to the left stays
apart from it when the two are merged together (`apart`), so the transition on
a byte leads to that token and emits the change in the number of tokens.  A
pretoken begins in the lexicon's start state, as the scanner has found where it
starts, so pretokens run independently of each other and their emissions add
up.  New pretokens of a slice run through the automaton end to end; sums of
pretokens met lately are kept in a bounded table for the worker's life.  Each
worker holds its first text against the library.

Special strings are split off first, as the library does, and count one each.
Files that are not plain byte-level BPE are counted by the library itself.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.byte_bpe import ByteBpe, byte_bpe
from tessaline.llm.common import Memo, batch, bound_batches, code_points, slices

CHUNK = 64
MEMO = 1_000_000
PAIRS = 1 << 20  # neighbours whose judgement is kept
_PART = chr(256)  # stands between pretokens, in no byte

CLASSES = SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, S_END, R, V, L, E, BREAK = range(12)
STATES = START, IN_L, IN_N, IN_O, SP1, WS1, WSP, WSW, AP, AP_R, AP_V, AP_L = range(12)
HERE, BEFORE = 1, 2  # a pretoken starts at this character; one starts at the character before
LETTERS = {LETTER, S_END, R, V, L, E}


def compile_scanner() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) for [state, class] of the byte-level pre-tokenizer's pattern.

    BREAK is a virtual character between two texts.  States: START at a text's
    beginning or after a contraction; IN_* within a run; SP1, WS1 after one
    space or other blank; WSP, WSW after a longer run of blanks that ends in a
    space or another blank; AP* after an apostrophe that may begin a contraction.
    """
    step, emit = np.zeros((12, 12), np.int8), np.zeros((12, 12), np.int8)

    def fresh(c: int) -> int:
        """The state after c as a pretoken's first character."""
        if c in LETTERS:
            return IN_L
        return {SPACE: SP1, BLANK: WS1, NUMBER: IN_N, OTHER: IN_O, QUOTE: AP, BREAK: START}[c]

    for c in CLASSES:
        run = IN_L if c in LETTERS else {NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O}.get(c)
        for s in STATES:
            to, out = fresh(c), HERE
            if c != BREAK:
                if s in (IN_L, IN_N, IN_O) and run == s or s == SP1 and run is not None:
                    to, out = run, 0
                elif s in (SP1, WS1, WSP, WSW) and c in (SPACE, BLANK):
                    to, out = (WSP if c == SPACE else WSW), 0
                elif s == WSP:  # the last space goes with what follows
                    to, out = run, BEFORE
                elif s == WSW:  # the last blank stands alone
                    out = BEFORE | HERE
                elif s == AP and c in (QUOTE, OTHER):
                    to, out = IN_O, 0
                elif s == AP and c == S_END:
                    to, out = START, 0
                elif s == AP and c in (R, V, L):
                    to, out = {R: AP_R, V: AP_V, L: AP_L}[c], 0
                elif (s, c) in ((AP_R, E), (AP_V, E), (AP_L, L)):
                    to, out = START, 0
                elif s in (AP_R, AP_V, AP_L):  # no contraction: the letter after the apostrophe starts a run
                    to, out = (IN_L, BEFORE) if c in LETTERS else (fresh(c), BEFORE | HERE)
            elif s in (AP_R, AP_V, AP_L):
                out = BEFORE | HERE
            step[s, c], emit[s, c] = to, out
    return step, emit


STEP, EMIT = compile_scanner()
_ASCII = {" ": SPACE, "'": QUOTE, "s": S_END, "t": S_END, "m": S_END, "d": S_END, "r": R, "v": V, "l": L, "e": E}
_CLASS = np.full(0x110001, 255, np.uint8)
_CLASS[0x110000] = BREAK


def classes_of(points: np.ndarray, probe: ByteBpe) -> np.ndarray:
    """The class of each code point; a new one is tried on the library's own pre-tokenizer."""
    found = _CLASS[points]
    if (found == 255).any():
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for p in np.unique(points[found == 255]).tolist():
            c = chr(p)
            if c in _ASCII:
                kind = _ASCII[c]
            elif len(split(f"a{c}")) == 1:
                kind = LETTER
            elif len(split(f"1{c}")) == 1:
                kind = NUMBER
            else:
                kind = OTHER if len(split(f"!{c}")) == 1 else BLANK
            _CLASS[p] = kind
        found = _CLASS[points]
    return found


def state_maps(classes: np.ndarray) -> np.ndarray:
    """[chunk, state] -> state after the chunk; classes is [position, chunk]."""
    maps = np.tile(np.arange(12, dtype=np.int8), (classes.shape[1], 1))
    flat = STEP.ravel()
    for row in classes:
        maps = flat[maps.astype(np.int16) * 12 + row[:, None]]
    return maps


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in log2(chunks) doubling steps."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.int64), axis=1)
        reach *= 2
    return out


def pretoken_starts(classes: np.ndarray) -> np.ndarray:
    """Positions at which pretokens (and BREAKs) start, in order."""
    n = len(classes)
    width = -(-n // CHUNK)
    padded = np.full(width * CHUNK, BREAK, np.uint8)
    padded[:n] = classes
    lanes = np.ascontiguousarray(padded.reshape(width, CHUNK).T)
    ends = scan(state_maps(lanes))[:, START]
    state = np.concatenate([np.array([START], np.int8), ends[:-1]])
    step, emit = STEP.ravel(), EMIT.ravel()
    emitted = np.empty((CHUNK, width), np.int8)
    for i, row in enumerate(lanes):
        at = state.astype(np.int16) * 12 + row
        emitted[i], state = emit[at], step[at]
    flat = emitted.T.ravel()[:n]
    marks = (flat & HERE).astype(bool)
    marks[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(marks)


class Lexicon:
    """Emitted-token counts of pretokens, from the merges alone."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]]):
        import ahocorasick

        self.joined = {(a, b): c for a, b, c in merges}
        self.left, self.right = ({c: ab[k] for ab, c in self.joined.items()} for k in (0, 1))
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, t in ranks.items():
            if t not in self.left or self.apart(self.left[t], self.right[t], t):  # its own merges lead to it
                self.automaton.add_word(piece.decode("latin-1"), (t, len(piece)))
        self.automaton.make_automaton()

    def apart(self, x: int, y: int, limit: int = 1 << 62) -> bool:
        """Whether x and y, side by side, stay two tokens until the merge `limit`.

        Merges are taken back from the last one on, those of x to its right end and those of y to its left end.  While
        a pair of ends stood side by side no merge of the two may have been due: one earlier than the merge that was
        taken back; at the same merge the one further left goes first.
        """
        while True:
            if self.joined.get((x, y), limit) < limit:
                return False
            a, b = x if x in self.right else -1, y if y in self.left else -1
            if a > b:
                limit, x = a, self.right[x]
            elif b >= 0:
                limit, y = b + 1, self.left[y]
            else:
                return True

    def emissions(self, pretokens: list[str]) -> tuple[list[int], list[int]]:
        """Tokens after each byte of all pretokens, with a mark between them, and where each pretoken ends."""
        parts = [w.encode("utf-8", "surrogatepass").decode("latin-1") for w in pretokens]
        ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
        last, count = [-1] * (ends[-1] + 2 if ends else 1), [0] * (ends[-1] + 2 if ends else 1)
        known, apart = self.known, self.apart
        if len(known) > PAIRS:
            known.clear()
        for end, (t, n) in self.automaton.iter(_PART + _PART.join(parts) if parts else ""):
            before = end + 1 - n
            x = last[before]
            if x >= 0:
                ok = known.get((x, t))
                if ok is None:
                    ok = known[x, t] = apart(x, t)
                if not ok:
                    continue
            last[end + 1], count[end + 1] = t, count[before] + 1
        return count, ends

    def counts(self, pretokens: list[str]) -> list[int]:
        count, ends = self.emissions(pretokens)
        return [count[e] for e in ends]


class Counter:
    """Tokens of whole texts for one tokenizer file."""

    def __init__(self, path: str):
        self.bpe = byte_bpe(path)
        self.memo = Memo(MEMO)
        self.lexicon = Lexicon(self.bpe.ranks, self.bpe.merges) if self.bpe.fast is not None else None
        self.confirmed = False
        special = getattr(self.bpe, "special", {})
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings; texts are parted by a virtual BREAK."""
        points, offsets = code_points(texts)
        at = offsets[:-1] + np.arange(len(texts))  # where each text's BREAK stands
        classes = np.full(len(points) + len(texts), BREAK, np.uint8)
        own = np.ones(len(classes), bool)
        own[at] = False
        classes[own] = classes_of(points, self.bpe)
        starts = pretoken_starts(classes)
        joined = "\0" + "\0".join(texts)  # one character for each BREAK keeps positions
        words = [joined[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(joined)])]
        is_break = classes[starts] == BREAK
        for k in np.flatnonzero(is_break).tolist():
            words[k] = ""  # has no tokens
        known = self.memo.of(set(words), self.lexicon.counts)
        counts = [known[w] for w in words]
        total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        bounds = np.append(np.flatnonzero(is_break), len(words))
        return (total[bounds[1:]] - total[bounds[:-1]]).tolist()

    def count(self, texts: list[str]) -> list[int]:
        if self.bpe.fast is None:
            return [len(e.ids) for e in self.bpe.library.encode_batch(texts, add_special_tokens=False)]
        out, parts, owner = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if self.special and self.special.search(t):
                out[i] = sum(1 for _ in self.special.finditer(t))
                pieces = self.special.split(t)
            else:
                pieces = [t]
            parts += pieces
            owner += [i] * len(pieces)
        for i, n in zip(owner, self.plain(parts)):
            out[i] += n
        if not self.confirmed:
            for t, n in zip(texts, out):
                if 0 < len(t) < 20_000:
                    if len(self.bpe.slow(t)) != n:
                        raise ValueError("the lexicon and the tokenizer file disagree")
                    self.confirmed, self.bpe._library = True, None
                    break
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one narrow pass over (doc_id, text), no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for b in batches:
            sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0), np.int64)
            for first, texts in slices(b.column(1).to_pylist()):
                n = np.array(count(texts), np.int64)
                yield batch(COUNTS, [b.column(0).slice(first, len(texts)), sizes[first : first + len(texts)], n, n > limit])

    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
