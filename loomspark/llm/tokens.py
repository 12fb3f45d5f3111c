"""Token ids of whole texts by the tokenizers library, with a bounded cache of the parts that texts consist of.

Both kinds of tokenizer cut a text at white space and where letters, digits and signs meet, and encode each part by
itself. A batch of texts is cut by its bytes at once, its distinct parts are encoded by the library's model, and the
texts' ids are gathered from theirs. What lies between white space stays whole, and takes the library's full way, where
it has a character outside ASCII and Latin letters, an apostrophe, or more than one white space before it. Texts that
hold one of the tokenizer's added tokens, or white space of other kinds, go whole to the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import regex

#: Parts that each of two generations of the cache holds, and the longest that it takes, in bytes.
CACHE, LONGEST = 300_000, 256
#: Bytes of texts that are cut at a time. Longer texts are encoded piece by piece, which begin at white space.
SEGMENT = 4 << 20
#: White space other than blanks and line ends, in the widest sense of it.
_ODD_SPACE = re.compile(r"[^\S \n]")
#: Characters that no normalizer recomposes and whose lower case depends on nothing around them.
_LATIN = re.compile("[ \n]*[!-~¡-įı-ɏ]+").fullmatch
#: How the two tokenizer files split text.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_SPLIT = regex.compile(_CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_WORD_SPLIT = regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

#: Between the two a text can be cut.
_BREAK = re.compile(rb"[^\s][ \n]")

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _classes(words: bool) -> np.ndarray:
    """The class of each byte. A byte that continues a character counts as a letter; what matters is its first byte.
    Of characters beyond ASCII those of U+00C0 on are letters: up to U+00FF where case matters, up to U+017F else."""
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _SIGN
    out[ord("'")] = _ODD
    for first, last in ("az", "AZ"):
        out[ord(first) : ord(last) + 1] = _LETTER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[0x80:0xC0] = _LETTER
    out[0xC3 : 0xC4 if words else 0xC6] = _LETTER
    out[[*range(0x09, 0x0E), 0x20] if words else [0x0A, 0x20]] = _SPACE
    return out


def _byte_characters() -> dict[int, int]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: 0x100 + i for i, b in enumerate(rest)}


def _before(flags: np.ndarray) -> np.ndarray:
    """The flag of the byte before."""
    out = np.zeros_like(flags)
    out[1:] = flags[:-1]
    return out


def _pieces(raw: bytes):
    """Pieces of about SEGMENT bytes that begin with white space, but for the first."""
    at = 0
    while at < len(raw):
        found = _BREAK.search(raw, at + SEGMENT)
        end = found.start() + 1 if found else len(raw)
        yield raw[at:end]
        at = end


class Ids(dict):
    """encode(text) gives the ids as little-endian unsigned 32-bit numbers, as bytes; encode_all those of many texts.

    The dict is the younger of two generations of parts; when it is full it becomes the older one, so that what is in
    use stays.
    """

    def __init__(self, path: str, words: bool, added: bool = False):
        """words: the tokenizer lower-cases and drops white space. added: an added token in a text gets its one id, as by
        the library's default; else it is plain characters."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model = self.tokenizer.model
        self.words, self.older, self.split = words, {}, _WORD_SPLIT if words else _BYTE_SPLIT
        self.bytes, self.classes = _byte_characters(), _classes(words)
        self.blank, self.line = chr(self.bytes[0x20]), chr(self.bytes[0x0A])
        self.size = self.tokenizer.get_vocab_size()
        self.four = [i.to_bytes(4, "little") for i in range(self.size)]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: bytes) -> bytes:
        text = part.decode("ascii").replace(" ", self.blank).replace("\n", self.line) if part.isascii() else part.decode("latin-1").translate(self.bytes)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(text)])

    def _unit(self, raw: bytes) -> bytes:
        unit = raw.decode()
        if not _LATIN(unit):
            return self._library(unit)
        return b"".join([self._part(p.encode()) for p in self.split(unit.lower() if self.words else unit)])

    def _values(self, parts: list[bytes], whole: list[bool]) -> list[bytes]:
        values = list(map(self.get, parts))
        for i, value in enumerate(values):
            if value is not None:
                continue
            part = parts[i]
            value = self.older.get(part)
            if value is None:
                value = self._unit(part) if whole[i] else self._part(part)
            values[i] = value
            if len(part) <= LONGEST:
                if len(self) >= CACHE:
                    self.older = dict(self)
                    self.clear()
                self[part] = value
        return values

    def _cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, where parts begin among them, and whether each is a unit that stays whole. `begins` are
        the places where texts begin."""
        kind = self.classes[data]
        first = np.zeros(len(data), bool)
        first[begins] = True
        before = np.concatenate([data[:1], data[:-1]])
        kind[(before == 0xC3) & ((data == 0x97) | (data == 0xB7))] = _ODD  # the two signs among Latin letters
        space = kind == _SPACE
        after_space = _before(space) & ~first
        odd = kind == _ODD
        if self.words:
            unit = ~space & (first | after_space)
            part = unit | (kind == _DIGIT)
        else:
            unit = first | (space & ~after_space)
            odd |= space & after_space
            part = unit | (after_space & (before == 0x0A))
        number = np.cumsum(unit, dtype=np.int32)
        odd &= number > 0
        whole = np.zeros(int(number[-1]) + 1, bool)
        whole[number[odd]] = True
        whole[0] = False
        in_whole = whole[number]
        change = np.zeros(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        part |= change & ~after_space
        part &= unit | ~in_whole
        if not self.words:
            return data, part, in_whole
        upper = (data >= 0x41) & (data <= 0x5A) | (before == 0xC3) & (data >= 0x80) & (data <= 0x9E)
        lower = np.where(upper & ~in_whole, data + np.uint8(0x20), data)
        return lower[~space], (part & ~space)[~space], in_whole[~space]

    def encode_all(self, texts) -> list[bytes]:
        """The ids of each text; a null one is empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        place, raws, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            raw = t.encode()
            odd = not self.words and len(raw.translate(None, _PLAIN)) and _ODD_SPACE.search(t)
            if odd or any(x in t for x in self.added):
                out[i].append(self._library(t))
                continue
            for piece in [raw] if len(raw) <= SEGMENT else _pieces(raw):
                place.append(i)
                raws.append(piece)
                size += len(piece)
                if size >= SEGMENT:
                    self._add(raws, place, out)
                    place, raws, size = [], [], 0
        if place:
            self._add(raws, place, out)
        return [b"".join(x) for x in out]

    def _add(self, raws: list[bytes], place: list[int], out: list[list[bytes]]) -> None:
        """Appends the ids of each text of `raws`, none of which is empty, to the list at its place."""
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        begins = ends - [len(r) for r in raws]
        kept, part, whole = self._cut(data, begins)
        if len(kept) < len(data):  # places among the bytes without white space
            held = np.concatenate([[0], np.cumsum(self.classes[data] != _SPACE, dtype=np.int32)])
            begins, ends = held[begins], held[ends]
        at = np.flatnonzero(part)
        if not len(at):
            return
        offsets = np.append(at, len(kept)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        parts = parts.dictionary_encode()
        index = parts.indices.to_numpy()
        flags = np.zeros(len(parts.dictionary), bool)
        flags[index[whole[at]]] = True
        values = self._values(parts.dictionary.to_pylist(), flags.tolist())
        flat = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        start = np.cumsum(size) - size
        n = size[index]
        stop = np.cumsum(n)
        ids_ = flat[np.repeat(start[index] - (stop - n), n) + np.arange(stop[-1])]
        bounds = np.concatenate([[0], stop])
        low, high = bounds[np.searchsorted(at, begins)], bounds[np.searchsorted(at, ends)]
        for i, a, b in zip(place, low.tolist(), high.tolist(), strict=True):
            out[i].append(ids_[a:b].tobytes())

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: Bytes of texts that can't hold white space other than blanks and line ends.
_PLAIN = bytes([0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC6)])

_LOADED: dict[tuple[str, bool], Ids] = {}


def ids(path: str, words: bool) -> Ids:
    """One tokenizer for a worker process, loaded when first asked for."""
    if (path, words) not in _LOADED:
        _LOADED[path, words] = Ids(path, words, added=True)
    return _LOADED[path, words]
