"""Byte-level BPE ids from a tokenizers JSON file, at the speed of its compiled rank table.

The JSON's vocabulary is turned into byte ranks for tiktoken when the file is a
plain byte-level BPE whose ids follow its merge order; any other file is run by
the tokenizers library itself.  Both give the ids that the library gives with
add_special_tokens=False: special strings inside a text become their ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_table(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(byte ranks, special ids) if the file is a byte-level BPE that ranks alone describe; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")
    added = spec.get("added_tokens", [])
    if not plain or odd or any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    symbols = byte_symbols()
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(symbols[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or len(ranks) != len(merged) + 256:
        return None
    return ranks, special


def merge_table(spec: dict) -> list[tuple[int, int, int]]:
    """(left, right, joined) ids of every merge, in order."""
    vocab, pairs = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.fast, self._library, self.confirmed = path, None, None, False
        if found := rank_table(spec):
            import tiktoken

            ranks, special = found
            self.ranks, self.merges = ranks, merge_table(spec)
            self.fast = tiktoken.Encoding("byte-level", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = special

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_padding()
            self._library.no_truncation()
        return self._library

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def confirm(self, text: str) -> None:
        """Hold the rank table against the library on a text, once for each worker; the library is let go again."""
        if not self.confirmed and self.fast is not None:
            if not np.array_equal(self.encode(text), self.slow(text)):
                raise ValueError("the compiled rank table and the tokenizer file disagree")
            self.confirmed, self._library = True, None

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text as uint32."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None:
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint32, copy=False)
        except BaseException as e:  # the compiled pattern gives up on extreme runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow(text)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One instance for each file and worker process."""
    return ByteBpe(path)
