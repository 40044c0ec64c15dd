"""SentencePiece encoding and decoding for merge-type vocabularies (operator 5).

Encoding is the score-ordered agenda: all adjacent symbol pairs whose join is a
vocabulary piece wait in a heap by score, then position; the best one merges,
its neighbours' pairs join the agenda, stale entries are skipped.  Pieces that
hold the word mark elsewhere than at the front are runs of marks, so the
agenda of a text falls apart before every mark that follows another symbol.
The agendas of all new words of one length in a slice run in lock step, one
merge each at a time (`agendas`); very long words keep a heap of their own
(`agenda`).  Words met lately are remembered in bounded tables.

Every Arrow batch is checked against the sentencepiece library: each word that
the batch brings for the first time, and every CHECK_EVERY-th whole text.  A
difference stops the job, so no id leaves unchecked.  Decoding is the
library's.

Defined results: null and empty texts are the lone end id and decode to the
empty text; repeated rows are encoded alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Memo, batch, bound_batches, slices
from tessaline.llm.ngrams import KeyIndex

MARK = "▁"
MEMO = 1_000_000
CHARS = 1 << 22  # of the texts that are split and looked up at once: the more, the fewer lookups of a word
CHECK_EVERY = 16
SHORT = 48  # code points of a word whose agenda is run with others of its length
LAST = np.int32(2**31 - 1)
FOREIGN = 1 << 20  # numbers of characters that are in no piece


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        normal = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in normal}
        self.scores = {self.sp.id_to_piece(i): self.sp.get_score(i) for i in normal}
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decimal = [str(i) for i in range(n)]
        self.words = Memo(MEMO)
        self.compile_pairs()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark inside a word: words can't be encoded apart")

    def spelled(self, symbols: list[str]) -> list[int]:
        """Ids of merged symbols; one that is no piece is spelt in bytes."""
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out += [i] if i is not None else [self.bytes[x] for x in s.encode("utf-8")]
        return out

    def agenda(self, word: str) -> list[int]:
        """Ids of one word by merging the best-scored adjacent pair (the first of equals) until none is a piece."""
        symbols: list[str] = list(word)
        left, right = [i - 1 for i in range(len(symbols))], [*range(1, len(symbols)), -1]
        waiting: list[tuple[float, int, int, str]] = []
        scores = self.scores

        def offer(a: int, b: int) -> None:
            joined = symbols[a] + symbols[b]
            if (score := scores.get(joined)) is not None:
                heapq.heappush(waiting, (-score, a, b, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while waiting:
            _, a, b, joined = heapq.heappop(waiting)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != joined or right[a] != b:
                continue
            symbols[a], symbols[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return self.spelled([s for s in symbols if s])

    def compile_pairs(self) -> None:
        """Number the symbols and index every pair whose join is a piece: its place in the order of scores, and the join."""
        symbols = list(self.ids) + sorted({c for p in self.ids for c in p} - self.ids.keys())
        number = {s: i for i, s in enumerate(symbols)}
        pairs = [(number[p[:k]], number[p[k:]], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, join = (np.array(x, np.uint64) for x in zip(*pairs))
        order = np.unique([-self.scores[s] for s in self.ids], return_inverse=True)[1].astype(np.int32)
        self.pairs, self.join = KeyIndex(left << np.uint64(32) | right), np.append(join.astype(np.int64), 0)
        self.order = np.append(order[join.astype(np.int64)], LAST)
        self.first = np.arange(0x110000, dtype=np.int64) + FOREIGN
        for c, i in number.items():
            if len(c) == 1:
                self.first[ord(c)] = i
        self.symbols, self.symbol_ids = symbols, np.array([self.ids.get(x, -1) for x in symbols])

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.find((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)).ravel()).reshape(a.shape)

    def agendas(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 4 bytes) of many words: the agendas of all words of one length advance together, one merge a step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = [b""] * len(words)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            if n > SHORT:
                for k in own.tolist():
                    out[k] = packed(self.agenda(words[k]))
                continue
            s = self.first[np.frombuffer("".join([words[k] for k in own]).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(len(own), n)
            left = np.full(len(own), n)
            place = self.look(s[:, :-1], s[:, 1:]) if n > 1 else np.zeros((len(own), 0), np.int32)
            live = np.arange(len(own))
            t, p = s.copy(), place
            while len(live) and p.shape[1]:
                waits = self.order[p]
                at = waits.argmin(axis=1)
                go = waits[np.arange(len(live)), at] < LAST
                if not go.all():
                    s[live[~go], : t.shape[1]] = t[~go]
                    live, t, p, at = live[go], t[go], p[go], at[go]
                    if not len(live):
                        break
                rows, columns = np.arange(len(live)), np.arange(t.shape[1] - 1)
                merged = self.join[p[rows, at]]
                t = np.where(columns > at[:, None], t[:, 1:], t[:, :-1])
                t[rows, at] = merged
                p = np.where(columns[:-1] >= at[:, None], p[:, 1:], p[:, :-1])
                left[live] -= 1
                for k, ok in ((at, at < p.shape[1]), (at - 1, at > 0)):
                    if ok.any():
                        p[rows[ok], k[ok]] = self.look(t[rows[ok], k[ok]], t[rows[ok], k[ok] + 1])
            s[live, : t.shape[1]] = t
            ids = np.where(s < FOREIGN, self.symbol_ids[np.minimum(s, len(self.symbols) - 1)], -1)
            odd = (ids < 0).any(axis=1)
            raw, m = ids.astype("<i4").tobytes(), (4 * left).tolist()
            for r, k in enumerate(own.tolist()):
                out[k] = raw[4 * n * r : 4 * n * r + m[r]]
            for r in np.flatnonzero(odd).tolist():
                out[own[r]] = packed(self.spelled([chr(v - FOREIGN) if v >= FOREIGN else self.symbols[v] for v in s[r, : left[r]].tolist()]))
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each whole text, without begin and end ids, as a list and as decimal text; checked."""
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh: list[tuple[str, bytes]] = []

        def encoded(new: list[str]) -> list[bytes]:
            ids = self.agendas(new)
            fresh.extend(zip(new, ids))
            return ids

        found = self.words.of(set(chain.from_iterable(split)), encoded)
        coded = [b"".join(map(found.__getitem__, ws)) for ws in split]
        checked = range(0, len(texts), CHECK_EVERY)
        # the library adds the first mark itself, but not to nothing
        asked = [(w.replace(MARK, " ")[1:], x) for w, x in fresh if w != MARK] + [(texts[i], coded[i]) for i in checked]
        theirs = self.sp.encode([w for w, _ in asked], num_threads=1)
        if [len(x) for x in theirs] != [len(x) // 4 for _, x in asked] or packed([*chain.from_iterable(theirs)]) != b"".join([x for _, x in asked]):
            raise ValueError("the agenda and the sentencepiece library disagree on " + repr(next((w, x) for (w, x), y in zip(asked, theirs) if x != packed(y)))[:200])
        ids_of = [np.frombuffer(x, "<i4").tolist() for x in coded]
        return [(x, " ".join(map(self.decimal.__getitem__, x))) for x in ids_of]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def coded(texts: list[str], path: str, end: bool) -> Iterator[tuple[list[int], str, str]]:
    """(ids, their decimal text, decoded text) of each text."""
    c = codec(path)
    tail = [c.sp.eos_id()] if end else []
    word = "".join(f" {i}" for i in tail)
    got = [(ids + tail, (said + word).lstrip()) for ids, said in c.encode(texts)]
    yield from ((ids, said, back) for (ids, said), back in zip(got, c.sp.decode([ids for ids, _ in got], num_threads=1)))


def encode_pieces(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """doc_id, ids, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column(1), CHARS):
                ids, _, decoded = zip(*coded(texts, model, end))
                yield batch(CODED, [b.column(0).slice(first, len(texts)), list(ids), list(decoded)])

    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests are taken where the ids are made."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column(1), CHARS):
                rows = [(len(i), sha(said), sha(back)) for i, said, back in coded(texts, model, True)]
                yield batch(DIGESTS, [b.column(0).slice(first, len(texts)), *map(list, zip(*rows))])

    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
