"""Exact token ids of texts from the ids of their words.

word_bpe_49k.json drops white space before it encodes, its rules never look across
white space, and its special strings hold none. ASCII white space is therefore a safe
boundary: the ids of a text are those of its words, one after another. Texts are split,
and the distinct words of a batch found, by Arrow.

Most words are of ASCII characters and Latin letters with one code point. Their units are
runs of letters, single digits and runs of marks, and the byte pairs of all units of a
batch are merged together in numpy: in each round every unit merges its leftmost pair of
least rank, as the library does one after another. All other words go to the library.
Files with other rules are encoded by the library as whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that went to the library and are kept by a worker, and their characters in all; beyond either it starts anew.
MOST_WORDS, MOST_CHARS = 50_000, 1 << 20
#: Bytes of a batch, and the length from which a text is split.
BATCH_BYTES, PIECE_CHARS = 8 << 20, 1 << 20
#: Bytes of units that are merged in numpy at most, in matrices of these widths.
WIDTHS = (1, 2, 4, 6, 8, 10, 12, 16, 24, 32, 64)
_SPACE = re.compile("[ \t\n\r\x0b\x0c]")
#: The rules of the files that can be encoded word by word.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Kinds of bytes: those of letters, digits and marks; 0 is for the library. A ' can begin a unit of its own.
LETTER, DIGIT, MARK = 1, 2, 3
C3, SHIFT, NONE = 0xC3, 17, np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as a visible character: itself, or the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    found = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [found[b] for b in range(256)]


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for b in range(33, 127):
        kinds[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    kinds[[ord("'"), ord("<")]] = 0
    kinds[128:192] = kinds[C3] = LETTER
    return kinds


_KINDS = _kinds()
_LOWER = np.array([b + 32 * (65 <= b <= 90) for b in range(256)], np.uint8)


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie in data one after another."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, one after another, and their ends."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at[1:] - at[0]


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after another."""
    end = np.cumsum(length)
    return np.repeat(first - (end - length), length) + np.arange(end[-1] if len(end) else 0)


class WordEncoder:
    """Ids of words by the tokenizer file at path; ``known``: whether it can be encoded word by word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.known = self._can_split(rules)
        self.words: dict[bytes, np.ndarray] = {}
        self.chars = 0
        if self.known:
            self._set_tables(rules["model"])

    @staticmethod
    def _can_split(rules: dict) -> bool:
        """Whether the file has the rules that this module knows."""
        model, pre = rules["model"], rules.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [{}, {}]
        return (
            (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": UNITS}
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == SUFFIX
            and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
            and len(model["vocab"]) < 1 << SHIFT
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"])
            and all(t["content"].startswith("<") for t in rules["added_tokens"])
        )

    def _set_tables(self, model: dict) -> None:
        """Ids of bytes inside a unit and at its end, and rank and id of each pair that merges."""
        vocab, letters = model["vocab"], _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + SUFFIX] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << SHIFT | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.sort(keys), np.argsort(keys, kind="stable").astype(np.int32)
        # Ranks of two bytes, the second inside a unit or at its end.
        self.of_bytes = np.concatenate([self._rank(self.inner[:, None], x).ravel() for x in (self.inner, self.last)])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE for those that don't merge; -1 stands for no id."""
        key = left.astype(np.int64) << SHIFT | (right & ((1 << SHIFT) - 1))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge(self, ids: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rows of ids, -1 behind their ends, with all their pairs merged; rank: of each pair."""
        out, rows, columns = ids.copy(), np.arange(len(ids)), np.arange(ids.shape[1] - 1)
        while len(rows) and rank.shape[1]:
            best = rank.argmin(axis=1)
            low = np.take_along_axis(rank, best[:, None], axis=1)[:, 0]
            go = low < NONE
            if not go.all():
                out[rows[~go]] = ids[~go]
                rows, ids, rank, best, low = rows[go], ids[go], rank[go], best[go], low[go]
                if not len(rows):
                    break
            here, new = np.arange(len(rows)), self.merged[low]
            after = columns > best[:, None]
            ids[here, best] = new
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[here, best] = self._rank(new, ids[here, best + 1])
            some = here[best > 0]
            rank[some, best[some] - 1] = self._rank(ids[some, best[some] - 1], new[some])
        out[rows] = ids
        return out

    def _units(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units, one after another, with the first and the number of each."""
        length = np.diff(ends, prepend=0)
        begin, count = ends - length, np.zeros(len(ends), np.int64)
        found, order = [], []
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = np.flatnonzero((length > low) & (length <= width))
            if not len(rows):
                continue
            place = np.arange(width)
            held = data[np.minimum(begin[rows, None] + place, len(data) - 1)]
            end = length[rows, None] - 1
            ids = np.where(place < end, self.inner[held], np.where(place == end, self.last[held], -1))
            pair = held[:, :-1] * np.int32(256) + held[:, 1:] + (place[1:] == end) * np.int32(1 << 16)
            ids = self._merge(ids, np.where(place[1:] <= end, self.of_bytes[pair], NONE))
            count[rows] = (ids >= 0).sum(axis=1)
            found.append(ids[ids >= 0])
            order.append(rows)
        for row in np.flatnonzero(length > WIDTHS[-1]):
            unit = "".join(map(_byte_letters().__getitem__, data[begin[row] : ends[row]].tolist()))
            found.append(np.array([t.id for t in self.tokenizer.model.tokenize(unit)], np.int32))
            count[row] = len(found[-1])
            order.append([row])
        first = np.zeros(len(ends), np.int64)
        placed = np.concatenate(order).astype(np.int64) if order else np.zeros(0, np.int64)
        first[placed] = np.cumsum(count[placed]) - count[placed]
        return np.concatenate(found) if found else np.zeros(0, np.int32), first, count

    def _by_library(self, words: list[bytes]) -> list[np.ndarray]:
        if self.chars > MOST_CHARS or len(self.words) + len(words) > MOST_WORDS:
            self.words, self.chars = {}, 0
        new = [w for w in words if w not in self.words]
        texts = [w.decode("utf-8", "surrogatepass") for w in new]
        for word, found in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.words[word] = np.array(found.ids, np.int32)
            self.chars += len(word)
        return [self.words[w] for w in words]

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, with the first and the number of each."""
        data, ends = _parts(words)
        length = np.diff(ends, prepend=0)
        word, kind = np.repeat(np.arange(len(ends)), length), _KINDS[data]
        before = np.concatenate([[0], data[:-1]])
        marked = (data >= 128) & (data < 192)  # the second byte of a letter
        odd = (kind == 0) | (marked & ((before != C3) | (data == 0x97) | (data == 0xB7)))
        by_library = np.bincount(word[odd], minlength=len(ends)) > 0
        lowered = np.where(marked & (data < 0x9F), data + 32, _LOWER[data]).astype(np.uint8)
        mine = ~by_library[word]
        word, kind, lowered = word[mine], kind[mine], lowered[mine]
        begins = np.flatnonzero(
            (kind == DIGIT) | np.diff(kind, prepend=0).astype(bool) | np.diff(word, prepend=-1).astype(bool)
        )
        coded = _strings(lowered, np.append(begins[1:], len(lowered)) if len(begins) else begins).dictionary_encode()
        unit = coded.indices.to_numpy()
        ids, first, count = self._units(*_parts(coded.dictionary))
        lengths = np.bincount(word[begins], count[unit], len(ends)).astype(np.int64)
        flat = [ids[_runs(first[unit], count[unit])]]
        rest = np.flatnonzero(by_library)
        if len(rest):
            starts = ends - length
            found = self._by_library([data[starts[i] : ends[i]].tobytes() for i in rest])
            lengths[rest] = [len(x) for x in found]
            flat += found
        order = np.concatenate([np.flatnonzero(~by_library), rest])
        places = np.zeros(len(ends), np.int64)
        places[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(flat), places, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """offsets, codes, ids, first, lengths: text i has the words codes[offsets[i]:offsets[i + 1]] of those found."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        kept = pc.list_flatten(split)
        coded = kept.dictionary_encode()
        return split.offsets.to_numpy(), coded.indices.to_numpy(), *self._encode(coded.dictionary)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not self.known:
            return np.array([len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], np.int64)
        offsets, codes, _, _, lengths = self.encode(texts)
        total = np.concatenate([[0], np.cumsum(lengths[codes])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.known:
            return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        offsets, codes, ids, first, lengths = self.encode(texts)
        each = lengths[codes]
        end = np.concatenate([[0], np.cumsum(each)])
        return np.split(ids[_runs(first[codes], each)], end[offsets[1:-1]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """text in pieces of about most characters, cut at white space only."""
    at = 0
    while len(text) - at > most:
        cut = _SPACE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def batches(
    texts: Iterable[str | None], most: int = BATCH_BYTES, split: bool = True
) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces, or whole texts, in batches of about most bytes; a null text is empty."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces(text or "") if split else [text or ""]:
            rows.append(row)
            parts.append(piece)
            size += len(piece.encode("utf-8", "surrogatepass")) if len(piece) > 1000 else 2 * len(piece)
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts
