"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The library encodes each distinct word once for a worker; a text's ids are its words' ids in order. A batch of texts is cut into words,
counted and put together by Arrow in turns of a few megabytes, so that Python sees a turn's distinct words alone. That is
exact because neither vocabulary merges across the places where texts are cut here: the pre-tokenizers
split before a blank that a word follows and around other white space. Texts that hold what looks like a special token
or a control character on which Python and the library disagree are encoded in one piece, with the library's own ids: a special token's string in a text
gives that token's id, unless ``plain`` asks for it to be ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from brightloom.llm.shared import kept

#: Bytes that a worker's cache may hold before it starts anew: each entry counts as its word at four bytes a character, and what Python keeps beside it. Longer words are not kept.
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 200 << 20, 150, 1 << 10
#: Bytes of texts that make a turn, about; of those that go one by one, as Arrow's offsets might not hold their ids.
TURN_BYTES, LONG_TURN = 4 << 20, 128 << 20
#: Words that the library gets at once: what it returns for one is some hundred bytes.
LEARNT = 4096
_ODD = re.compile("[\x1c-\x1f]|<\\|")
#: White space on white space. Elsewhere texts may be cut before every blank and around every line feed.
_RUN = r"[\t-\r \x{85}\pZ]{2}"
_CUT = "\x1f"  # in no text but odd ones
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: ASCII signs that every pattern puts in one token run apart from letters; the apostrophe is not one of them.
_SIGNS = ".,;:!?*#$%&|()-\""
_PLAIN_BYTES = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: Byte-level vocabularies write each byte as one character: a printable one as itself, the others in order from U+0100.
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN_BYTES)}


class Encoder:
    """ids of texts as little-endian unsigned 16-bit (or 32-bit, for vocabularies over 65,536) bytes."""

    def __init__(self, file: str, blanks: bool, end_id: int, plain: bool = False):
        """blanks: whether the vocabulary keeps white space (byte-level) or drops it (word-level, lower case). plain: special tokens' strings are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = plain
        self.merges = Tokenizer(self.library.model)  # without normalizer and pre-tokenizer: for single words of Latin letters
        self.blanks = blanks
        self.width = 2 if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.end = self._pack([end_id])
        self._clear()

    def _clear(self) -> None:
        self.cache, self.held = {"": b""}, ENTRY_BYTES

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, words: set[str]) -> list[str]:
        """Put words, none of them in the cache, into it, and return what is new there."""
        cache, parts, plain, latin = self.cache, [], [], []
        wanted = set(words)
        for w in words:
            if w[-1].isalpha():
                continue
            core = w.rstrip(_SIGNS)
            if len(core) != len(w) and (core[core[:1] == " " :] if self.blanks else core.lower()).isalpha():  # lower case may bring in a mark
                parts.append((w, core, w[len(core) :]))
                wanted.discard(w)
                wanted.update(parts[-1][1:])
        fresh = wanted.difference(cache)
        for w in fresh:
            (latin if w[w[:1] == " " :].isalpha() and (w.isascii() or max(w) <= "\xff") else plain).append(w)
        spelt = latin if self.blanks else [w.lower() for w in latin]
        spelt = [w.replace(" ", _BYTE_CHARS[32]) if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in spelt]
        for some, library, texts in ((latin, self.merges, spelt), (plain, self.library, plain)):
            for k in range(0, len(some), LEARNT):
                found = [e.ids for e in library.encode_batch_fast(texts[k : k + LEARNT], add_special_tokens=False)]
                packed, at = self._pack([i for ids in found for i in ids]), 0
                for w, ids in zip(some[k : k + LEARNT], found, strict=True):
                    cache[w] = packed[at : (at := at + self.width * len(ids))]
        for w, core, signs in parts:
            cache[w] = cache[core] + cache[signs]
        return [*fresh, *(w for w, *_ in parts)]

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text and the end id; a null text counts as empty."""
        if not text:
            return self.end
        if _ODD.search(text):
            return self._pack(self.library.encode(text, add_special_tokens=False).ids) + self.end
        return b"".join(self._known(_CHUNK.findall(text) if self.blanks else text.split())) + self.end

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of the words; new ones are put into the cache."""
        found = [*map(self.cache.get, words)]
        if new := {w for w, ids in zip(words, found, strict=True) if ids is None}:
            if self.held > CACHE_BYTES:
                self._clear()
                new = set(words).difference(self.cache)
            learned = self._learn(new)
            found = [self.cache[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            for w in [w for w in learned if len(w) > LONG_WORD]:
                del self.cache[w]
                learned.remove(w)
            self.held += ENTRY_BYTES * len(learned) + sum(map(len, learned)) * 4
        return found

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """As ``encode``, for each of the texts in order."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes) // TURN_BYTES)) + 1
        for a, b in pairwise([0, *ends.tolist(), len(texts)] if len(texts) else []):
            turn = texts.slice(a, b - a)
            yield from self._turn(turn) if sizes[a:b].sum() <= LONG_TURN else (self.encode(t.as_py()) for t in turn)

    def _turn(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _ODD.pattern)
        plain = pc.if_else(odd, "", texts)
        if self.blanks:
            runs = pc.match_substring_regex(plain, _RUN)
            cut = pc.replace_substring(pc.replace_substring(plain, " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
            if pc.any(runs).as_py():
                found = [_CUT.join(_CHUNK.findall(t.as_py())) if run else None for t, run in zip(plain, runs.to_pylist(), strict=True)]
                cut = pc.if_else(runs, pa.array(found, texts.type), cut)
            words = pc.split_pattern(cut, _CUT)
        else:
            words = pc.utf8_split_whitespace(plain)
        each = words.flatten().dictionary_encode()
        ids = pa.array(self._known(each.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(each.indices)
        _, places, data = ids.buffers()
        at = np.frombuffer(places, np.int32)[words.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        for i, is_odd in enumerate(odd.to_pylist()):
            yield self.encode(texts[i].as_py()) if is_odd else bytes(data[at[i] : at[i + 1]]) + self.end


def encoder(file: str, blanks: bool, end_id: int, plain: bool = False) -> Encoder:
    """One encoder for a Python worker, so that tasks which follow find the cache filled."""
    key = (file, blanks, end_id, plain)
    return kept(key, lambda: Encoder(*key))
