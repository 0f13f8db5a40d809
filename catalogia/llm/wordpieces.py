"""Encoding of texts through the different pre-tokens of a group of them.

Pre-tokens repeat a lot. A group of texts is cut into pre-tokens with numpy, on their bytes; Arrow tells the different ones; and only
those that a worker doesn't remember (see Memory) go to the encoder. What is remembered changes the time, never the ids.
Texts with characters that the cutting doesn't know (beyond U+024F, rare controls) take the encoder's own way, with the same ids.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens of a generation, and the bytes of the longest that are remembered.
GENERATION = 100_000
LONGEST = 48
#: Bytes of texts that are cut at once (a longer text is a group of its own).
GROUP_BYTES = 8 << 20
#: The pattern that cut_points cuts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class isn't in the table below (RE2 syntax).
_UNKNOWN = "[\x1c-\x1f\x85\xa0]|[^\x00-ɏ]"
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE = range(5)


def _classes() -> np.ndarray:
    """The class of each character up to U+024F: a letter, a number, white space but the space, the space, or another."""
    out = np.full(0x250, _OTHER, np.uint8)
    for c in range(0x250):
        x = chr(c)
        if x.isalpha():
            out[c] = _LETTER
        elif x.isnumeric():
            out[c] = _NUMBER
    out[[9, 10, 11, 12, 13]] = _BLANK
    out[32] = _SPACE
    return out


_CLASS = _classes()


def cut_points(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start in the UTF-8 bytes of texts that follow one another and start at `texts`.

    A run of one class is a match; a space before it belongs to it. Of a run of white space, all but the last character is a match, and all of it
    at a text's end. An apostrophe that begins a match takes the letters of a contraction with it.
    """
    n = len(data)
    kind = _CLASS[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC2)
    kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    first = np.zeros(n + 1, bool)  # a text's first byte
    first[texts[texts < n]] = True
    first[n] = True
    white = kind >= _BLANK
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & ~white[1:]
    start[1:] |= white[1:] & ~white[:-1]
    last = white.copy()  # white space with a character after it that is none
    last[:-1] &= ~white[1:]
    last &= ~first[1:]
    start |= last
    start |= first[:-1]
    tick = np.flatnonzero(data == 0x27)
    tick = tick[start[tick] & ~first[tick + 1]]
    if len(tick):
        more = np.concatenate((data, np.zeros(3, np.uint8)))
        a, b = more[tick + 1], more[tick + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ~first[np.minimum(tick + 2, n)] & (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C))
        start[tick[one | two] + 1] = False
        for at in (tick[one] + 2, tick[two] + 3):
            start[at[at < n]] = True
    return np.flatnonzero(start)


class Memory:
    """Ids of pre-tokens. When the young generation is full it becomes the old one, which is forgotten but for what is met again."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of each of the words, all different; encode makes those that aren't known."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, words))
        lack = []
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                x = old.get(w)
                if x is None:
                    lack.append(i)
                else:
                    out[i] = young[w] = x
        for i, x in zip(lack, encode([words[i] for i in lack])):
            out[i] = x
            if len(words[i]) <= LONGEST:
                young[words[i]] = x
        return out


class WordEncoder:
    """encode: the ids of each text as little-endian unsigned 32-bit bytes.

    words gives the ids of pre-tokens, whole those of whole texts. Texts that hold one of `added` go to whole, too; so do all if not `cuts`.
    """

    def __init__(self, words: Callable[[list[bytes]], list[bytes]], whole: Callable[[list[str]], list[bytes]], added: tuple[str, ...] = (), cuts: bool = True):
        self.words, self.whole, self.added, self.cuts = words, whole, added, cuts
        self.memory = Memory(GENERATION)

    def remembered(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words, all different."""
        return self.memory.ids(words, self.words)

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """texts: no nulls."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP_BYTES, "right")))
            yield from self._group(column.slice(at, end - at))
            at = end

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        strange = pc.match_substring_regex(texts, _UNKNOWN) if self.cuts else pa.repeat(True, len(texts))
        for a in self.added:
            strange = pc.or_(strange, pc.match_substring(texts, a))
        flags = strange.to_numpy(zero_copy_only=False)
        known = self._cut(texts.filter(pc.invert(strange)))
        others = iter(self.whole(texts.filter(strange).to_pylist())) if flags.any() else iter(())
        for odd in flags.tolist():
            yield next(others) if odd else next(known)

    def _cut(self, texts: pa.Array) -> Iterator[bytes]:
        if not len(texts):
            return
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            yield from [b""] * len(texts)
            return
        starts = cut_points(data, bounds[:-1])
        offsets = np.append(starts, len(data)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        told = tokens.dictionary_encode()
        words = told.dictionary.to_pylist()
        ids = np.empty(len(words), object)
        ids[:] = self.remembered(words)
        token = told.indices.to_numpy()
        place = np.searchsorted(starts, bounds).tolist()
        for a, b in zip(place, place[1:]):
            yield b"".join(ids[token[a:b]].tolist())


def byte_characters() -> str:
    """The characters that byte-level vocabularies print the 256 bytes as: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(others)) for b in range(256))


_ENCODERS: dict[str, WordEncoder] = {}


def library_encoder(path: str) -> WordEncoder:
    """Of a byte-level tokenizer file, by the tokenizers library; one for each worker process. Pre-tokens go to the library's merges, whole texts through its whole encoder."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merges, printed = tokenizer.model.tokenize, byte_characters()
        space = printed[32]

        def words(found: list[bytes]) -> list[bytes]:
            out = []
            for w in found:
                # Most are letters after a space: only the space is printed as another character.
                shown = space + w[1:].decode() if w[0] == 32 and w[1:].isalpha() else w.decode("latin-1").translate(printed)
                out.append(array("I", [x.id for x in merges(shown)]).tobytes())
            return out

        def whole(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _ENCODERS[path] = WordEncoder(words, whole, added, public_tokenizers.PATTERN == PATTERN)
    return _ENCODERS[path]
