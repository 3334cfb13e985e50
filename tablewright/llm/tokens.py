"""Token ids of whole texts by a byte-level BPE vocabulary of the ``tokenizers`` library.

Pre-tokenization never looks across a single space between two visible characters, so texts are cut there. Of the words (each
with the space before it) of a few megabytes, every different one is encoded once, all of them in one call, and numpy puts the ids of
all words in order. Words are told apart by a 64-bit hash, and the bytes are compared afterwards.

Where the vocabulary file is of the plain byte-level kind, with ids in the order of the merges, the ranks of that file go to
``tiktoken``, which gives the same ids several times faster; any other file is left to ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np

#: Bytes of text whose words are collected at a time.
PORTION_BYTES = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to load for every task."""
    name = "_tablewright_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


#: Fixed: how byte-level vocabularies split texts before the merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _alphabet() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as visible characters: Latin-1 ones as themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes to ids, if merging by smallest id is what the file says."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if not plain:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = model["vocab"]
    ids = [vocabulary["".join(p)] for p in pairs]
    if ids != sorted(set(ids)):
        return None
    alphabet = _alphabet()
    spelled = [c for c in alphabet if c in vocabulary] + ["".join(p) for p in pairs]
    return {bytes(alphabet[c] for c in word): vocabulary[word] for word in spelled}


def _flags(*codes: int) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(codes)] = True
    return flags


_WHITE = _flags(*range(9, 14), *range(28, 33))
#: Two- and three-byte characters that begin so may be white space.
_MAYBE_WHITE_2, _MAYBE_WHITE_3 = 0xC2, _flags(0xE1, 0xE2, 0xE3)
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def safe_spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are single spaces between characters that are surely visible."""
    safe = data == 32
    if len(data) < 3:
        safe[:] = False
        return safe
    after = _WHITE | _MAYBE_WHITE_3 | _flags(_MAYBE_WHITE_2)
    safe[:-1] &= ~after[data[1:]]
    safe[1:] &= ~_WHITE[data[:-1]]
    safe[2:] &= data[:-2] != _MAYBE_WHITE_2
    safe[3:] &= ~_MAYBE_WHITE_3[data[:-3]]
    safe[[0, -1]] = False
    return safe


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text that spells a special token is ordinary text
        self.fast = None
        ranks = _ranks(path)
        if ranks is not None and all(bytes([b]) in ranks for b in range(256)):
            import tiktoken

            self.fast = tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            for word, rank in ranks.items():
                self.size[rank] = len(word)
            self.powers = np.ones(0, np.uint64)

    @classmethod
    def shared(cls, path: str) -> Encoder:
        store = _worker_store().setdefault("encoders", {})
        if path not in store:
            store[path] = cls(path)
        return store[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sections, out, held = [], [[] for _ in texts], 0
        for i, text in enumerate(texts):
            for section in self._sections(text.encode()):
                if held and held + len(section) > PORTION_BYTES:
                    self._encode_sections(sections, out)
                    sections, held = [], 0
                sections.append((i, section))
                held += len(section)
        self._encode_sections(sections, out)
        return [b"".join(parts) for parts in out]

    def _sections(self, text: bytes):
        """The text, cut at safe spaces if it is longer than a portion."""
        start = 0
        while len(text) - start > PORTION_BYTES:
            window = np.frombuffer(text, np.uint8, PORTION_BYTES, start)
            cuts = np.flatnonzero(safe_spaces(window))
            if not len(cuts):
                break
            yield text[start : start + int(cuts[-1])]
            start += int(cuts[-1])
        yield text[start:]

    def _encode_sections(self, sections: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        sections = [x for x in sections if x[1]]
        if not sections:
            return
        data = np.frombuffer(b"".join(x[1] for x in sections), np.uint8)
        lengths = np.array([len(x[1]) for x in sections])
        first = np.cumsum(lengths) - lengths
        inner = safe_spaces(data)
        begins = inner.copy()
        begins[first] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(data)))
        _, chosen, word = np.unique(self._hashes(data, starts, sizes), return_index=True, return_inverse=True)
        if not _same_bytes(data, starts, sizes, chosen, word):
            for i, section in sections:
                out[i].append(self.fast.encode_to_numpy(section.decode(), disallowed_special=()).astype("<u4").tobytes())
            return
        at, size = starts[chosen], sizes[chosen]
        # A word between two safe spaces can follow any other such word; the few others go alone.
        free = inner[at] & np.append(inner, False)[at + size]
        ids, counts = [], np.zeros(len(at), np.int64)
        joined = data[_spread(at[free], size[free])].tobytes()
        got = self.fast.encode_to_numpy(joined.decode(), disallowed_special=())
        ends = np.searchsorted(np.cumsum(self.size[got]), np.cumsum(size[free]), side="left") + 1
        counts[free] = np.diff(ends, prepend=0)
        ids.append(got)
        for k in np.flatnonzero(~free):
            alone = self.fast.encode_to_numpy(data[at[k] : at[k] + size[k]].tobytes().decode(), disallowed_special=())
            counts[k] = len(alone)
            ids.append(alone)
        ids = np.concatenate(ids)
        order = np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)])
        place = np.zeros(len(at), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        each = counts[word]
        flat = ids[_spread(place[word], each)].astype("<u4")
        ends = np.cumsum(each)
        cut = np.append((ends - each)[np.searchsorted(starts, first)], len(flat))
        for (i, _), low, high in zip(sections, cut[:-1], cut[1:], strict=True):
            out[i].append(flat[low:high].tobytes())

    def _hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A polynomial hash of each word: sums of bytes times powers, shifted to a common first power."""
        if len(self.powers) < len(data):
            steps = np.full(max(len(data), PORTION_BYTES), _MULTIPLIER, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = pow(_MULTIPLIER, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], starts)
        mixed = sums * self.inverse[starts]
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)


def _same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, word: np.ndarray) -> bool:
    """Whether every word has the bytes of the one chosen for it."""
    if not np.array_equal(sizes[chosen][word], sizes):
        return False
    return np.array_equal(data[_spread(starts[chosen][word], sizes)], data)
