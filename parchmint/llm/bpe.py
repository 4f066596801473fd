"""Whole-text token ids and spans of a byte-level BPE tokenizer file (JSON with vocabulary and merges).

The ids equal Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids. In such a file a token's id orders
the merges, so the vocabulary gives the ranks of a faster encoder, which returns the ids of a whole text as bytes. Its
pattern remembers every character of a run of white space, so that long runs are cut out first, as the pattern would.
"""

from __future__ import annotations

import json

import numpy as np
import regex

LONG_RUN = 10_000
LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}+")

# Fixed value: how byte-level BPE splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = byte_of_symbol()
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)._core_bpe
        self.n_bytes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, dtype=np.int64)
        for s, i in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.n_bytes[i] = len(s)

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids of the text."""
        if len(text) <= LONG_RUN:
            return self._short_runs(text)
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text):
            a, b = run.span()
            # one piece, but for a last character that belongs to the word behind it
            end = b if b == len(text) or text.startswith(tuple(self.special), b) else b - 1
            parts += [self._short_runs(text[at:a]), np.array(self.core.encode_single_piece(text[a:end].encode()), dtype="<u4")]
            at = end
        return np.concatenate([*parts, self._short_runs(text[at:])]) if parts else self._short_runs(text)

    def _short_runs(self, text: str) -> np.ndarray:
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set(self.special)), dtype="<u4")

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character that each token of the text has a byte of."""
        sizes = self.n_bytes[self.ids(text)]
        end = np.cumsum(sizes)
        starts_char = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        char = np.cumsum(starts_char) - 1
        return char[end - sizes], char[end - 1] + 1


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
