"""Cached word-wise use of the tokenizers library.

A tokenizer whose pre-tokenizer never matches white space gives, for a text, the ids of its white-space-separated
words one after the other. Encoding each distinct word once, in the library, and joining the cached ids is therefore
the same as encoding the text; only the ASCII white space that bytes.split() knows is cut at.
"""

from __future__ import annotations

import os
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Never part of a pre-token with letters, so an ending of these is encoded apart from the letters before it.
ENDING = b".,!*$#%&?;:"
#: Texts are taken until they have so many bytes.
TEXTS_AT_ONCE = 1_000_000
#: Lower-case letters that normalisation leaves alone; only words of these go straight to the merges.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Parts of special tokens, and the first bytes of accents that normalisation joins with the letter before (U+0300 to U+037F).
_NOT_LOWERED = (b"<|", b"\xcc", b"\xcd")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes UTF-8 texts with the library; keeps two generations of at most ``cache`` words each.

    Only for byte-level tokenizers that lower-case, normalise to NFC and split letters from punctuation. A word made of
    plain letters and an ending of ASCII punctuation is put together from the two; the letters' ids come from the
    library's merges. Every other word goes through the library whole.
    """

    def __init__(self, path: str, cache: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = str.maketrans(_byte_letters())
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.cache, self.new, self.old, self.cores, self.endings = cache, {}, {}, {}, {}

    def _library(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _core(self, core: bytes) -> bytes:
        four = self.four
        # ASCII letters stand for themselves
        letters = core.decode() if core.isascii() else core.decode("latin-1").translate(self.letters)
        return b"".join([four[t.id] for t in self.merges(letters)])

    def _learn(self, words: list[bytes]) -> None:
        new, cores, endings, rest = self.new, self.cores, self.endings, []
        if len(cores) > self.cache:
            cores.clear()
        if len(endings) > 10_000:
            endings.clear()
        for w in words:
            core = w.rstrip(ENDING)
            lower = core.lower()
            known = cores.get(lower)
            if known is None:
                if not (core and (core.isalpha() or _PLAIN.fullmatch(lower.decode("utf-8", "replace")))):
                    rest.append(w)
                    continue
                known = cores[lower] = self._core(lower)
            if len(core) == len(w):
                new[w] = known
            else:
                ending = w[len(core) :]
                if ending not in endings:
                    endings[ending] = self._library([ending])[0]
                new[w] = known + endings[ending]
        if rest:
            new.update(zip(rest, self._library(rest), strict=True))

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        ids = list(map(self.new.get, words))
        if missing := [w for w, known in zip(words, ids, strict=True) if known is None]:
            if len(self.new) + len(missing) > self.cache:
                self.old, self.new = self.new, {}
            old = self.old
            self.new.update([(w, old[w]) for w in missing if w in old])
            if unknown := [w for w in missing if w not in old]:
                self._learn(unknown)
            new = self.new
            ids = [new[w] if known is None else known for w, known in zip(words, ids, strict=True)]
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[bytes]) -> list[bytes]:
        """``ids`` of each text; words of several texts are looked up and learned together."""
        out, group, size = [], [], 0
        for text in texts:
            # as normalisation would do later; not before special tokens are found and capitals joined with their accents
            group.append(text if any(map(text.__contains__, _NOT_LOWERED)) else text.lower())
            size += len(text)
            if size > TEXTS_AT_ONCE:
                out += self._joined(group)
                group, size = [], 0
        return out + self._joined(group)

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        """Words are numbered in Arrow, so that only distinct ones are looked up one by one."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        numbered = split.values.view(pa.binary()).dictionary_encode()
        ids = self._known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the ids of word k are those from starts[k] on, lengths[k] of them
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        number = numbered.indices.to_numpy()
        each = lengths[number]
        ends = np.zeros(len(number) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        data = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[number] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [data[x:y] for x, y in pairwise(at)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file, so that the cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
