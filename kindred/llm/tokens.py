"""Token ids of a public tokenizer, with a memory of words.

The default tokenizer's pre-tokenizer never joins characters across white space, so a text's ids are the ids of its words
in order. Each worker process keeps the ids of words it has met (a bounded number), and the library encodes the rest.
Texts are cut at ASCII white space only; a word that holds other white space is left to the library whole. That holds for
tokenizer files whose parts are those of PARTS; with any other, the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of these characters only are taken apart here: every Unicode version agrees on their classes, and NFC leaves them.
_PLAIN = re.compile("[\n!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0137\u0139-\u0148\u014a-\u0177\u017a-\u017e]*")
#: The pre-tokenizer's pattern for such words in lower case, one to a line.
_PIECE = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[^\na-z0-9\xdf-\xf6\xf8-\u017e]+")

#: Words and pieces of words that a worker remembers; beyond it, it starts anew.
WORDS, PIECES = 100_000, 250_000


#: The parts of a tokenizer file that words can be encoded one by one with.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False},
}
#: Characters that the library gets at a time.
PORTION = 1 << 20


class _Memory:
    """Numbers for strings, and where in a pool their ids are."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.used = 0

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.number), len(strings)
        while at + n > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        if len(ids) and ids.max() > np.iinfo(self.pool.dtype).max:
            self.pool = self.pool.astype(np.uint32)
        self.length[at : at + n] = sizes
        self.start[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(strings, range(at, at + n)))

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered strings in a row, and how many each has."""
        sizes = self.length[index].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) + np.repeat(self.start[index] - (ends - sizes), sizes)], sizes


class WordEncoder:
    """Encode texts as numpy arrays of ids, word by word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocab_size = self.full.get_vocab_size()
        self.ends = np.zeros(self.vocab_size, bool)
        for token, i in self.full.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.pieces = _Memory(), _Memory()

    def _encode_each(self, memory: _Memory, strings: list[str]) -> None:
        if strings:
            ids = [e.ids for e in self.full.encode_batch_fast(strings, add_special_tokens=False)]
            memory.add(strings, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _encode_pieces(self, new: list[str]) -> None:
        """Letters by the line, told apart by the tokens that end words; the rest one by one."""
        letters = [p for p in new if p.isalpha()]
        others = [p for p in new if not p.isalpha()]
        lines = [letters[i : i + 500] for i in range(0, len(letters), 500)]
        for some, e in zip(lines, self.bare.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self.pieces.add(some, ids, np.diff(stops, prepend=0))
            else:
                others += some
        self._encode_each(self.pieces, others)

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before."""
        lines = "\n".join(words)
        if not _PLAIN.fullmatch(lines):
            self._encode_each(self.words, [w for w in words if not _PLAIN.fullmatch(w)])
            words = [w for w in words if _PLAIN.fullmatch(w)]
            lines = "\n".join(words)
        if not words:
            return
        found = _PIECE.findall(lines.lower())
        known = self.pieces.number
        known.setdefault("\n", self._line())
        new = [p for p in dict.fromkeys(found) if p not in known]
        if new:
            self._encode_pieces(new)
        index = np.array(list(map(known.__getitem__, found)), np.int64)
        ids, sizes = self.pieces.gather(index)
        line = np.cumsum(index == known["\n"])
        self.words.add(words, ids, np.bincount(line, sizes, len(words)).astype(np.int64))

    def _line(self) -> int:
        """The number of the line break, which has no ids."""
        if "\n" not in self.pieces.number:
            self.pieces.add(["\n"], np.empty(0, np.uint32), np.zeros(1, np.int64))
        return self.pieces.number["\n"]

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, followed by end; a null text is an empty one."""
        if len(self.pieces.number) > PIECES:
            self.pieces = _Memory()
        if len(self.words.number) > WORDS:
            self.words = _Memory()
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        split = pc.ascii_split_whitespace(column.fill_null(""))
        words = split.values.dictionary_encode()  # the column is a whole array, so its values start at 0
        found = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = np.array(list(map(self.words.number.get, found, repeat(-1))), np.int64)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new = [found[i] for i in missing.tolist()]
            self._learn(new)
            index[missing] = list(map(self.words.number.__getitem__, new))
        ids, sizes = self.words.gather(index[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64))
        stops = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        tail = np.array([] if end is None else [end], ids.dtype if end is None or end <= np.iinfo(ids.dtype).max else np.uint32)
        return [np.concatenate([ids[i:j], tail]) for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]


class TextEncoder:
    """Encode texts as numpy arrays of ids with any tokenizer file, whole texts at a time."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.full.encode_special_tokens = True
        self.vocab_size = self.full.get_vocab_size()

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> list[np.ndarray]:
        """As WordEncoder.encode."""
        values = [x or "" for x in (texts if isinstance(texts, list) else texts.to_pylist())]
        tail = [] if end is None else [end]
        out: list[np.ndarray] = []
        while len(out) < len(values):
            stop, size = len(out) + 1, len(values[len(out)])
            while stop < len(values) and size + len(values[stop]) <= PORTION:
                size += len(values[stop])
                stop += 1
            out += [np.array([*e.ids, *tail], np.uint32) for e in self.full.encode_batch_fast(values[len(out) : stop], add_special_tokens=False)]
        return out


def by_words(path: str) -> bool:
    """True if a tokenizer file has the parts that words can be encoded one by one with."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    return all(own.get(k) == v for k, v in PARTS.items() if k != "model") and all(own["model"].get(k) == v for k, v in PARTS["model"].items())


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if by_words(path) else TextEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Let go of what this process's encoders remember; the tokenizers stay."""
    for e in _encoders.values():
        if isinstance(e, WordEncoder):
            e.words, e.pieces = _Memory(), _Memory()


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
