"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once in a worker.

A text is cut before every space that follows a visible ASCII character or a Latin letter. The byte-level pre-tokenizer always
starts a new piece there: none of its alternatives holds a space but at its start or in a run of white space, and none looks
further ahead than that run or the two letters after an apostrophe. So the pieces' ids, concatenated, are the text's ids. A
text with a space elsewhere is cut by the same rule with a regular expression.

A special string of the file that stands in a text is what the library makes of it in a plain call: its own id. With
``special_as_text`` it is ordinary text, as the library's ``encode_special_tokens`` has it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = re.compile(r"(?<=[!-~À-ÖØ-öø-ɏ]) ")
_ELSEWHERE = r"(^|[^!-~À-ÖØ-öø-ɏ]) "
_MARKS = ".,;:!?"
#: Words whose ids a worker keeps at most; beyond it the memory starts anew.
MOST_WORDS = 400_000
#: Bytes of text handled at once; a longer text is alone.
LOT = 3_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordTokenizer:
    """Encodes texts to ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True  # words are cut off a text after its special strings
        added = {} if special_as_text else self.inner.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("special strings that reach into the words beside them are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.special_cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.vocabulary = self.inner.get_vocab_size()
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.first_slots: dict[str, int] = {}
        self.ids, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0

    def _keep(self, lists: list[list[int]]) -> range:
        own = np.fromiter(map(len, lists), np.int32, len(lists))
        return self._keep_flat(np.fromiter((i for x in lists for i in x), np.uint32, own.sum()), own)

    def _keep_flat(self, flat: np.ndarray, own: np.ndarray) -> range:
        size = len(flat)
        while self.filled + size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(own) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        new = slice(self.n, self.n + len(own))
        self.ids[self.filled : self.filled + size] = flat
        self.lengths[new] = own
        self.starts[new] = self.filled + np.cumsum(own) - own
        self.n, self.filled = self.n + len(own), self.filled + size
        return range(new.start, new.stop)

    def _ids_of(self, slot: np.ndarray) -> np.ndarray:
        """The ids of these slots, one after another."""
        length = self.lengths[slot].astype(np.int64)
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.starts[slot] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [e.ids for e in self.inner.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _of_words(self, words: list[str]) -> np.ndarray:
        """Slots of words that follow a space."""
        slots = self.slots
        new = [w for w in words if w not in slots]
        letters, other, marked, stems = [], [], [], []
        for w in new:
            if w.isalpha():
                letters.append(w)
            elif (stem := w.rstrip(_MARKS)).isalpha():  # the pre-tokenizer parts letters from marks
                marked.append(w)
                stems.append(stem)
            else:
                other.append(w)
        letters += set(stems).difference(slots, letters)
        merge = self.inner.model.tokenize  # a word of letters is one piece of the pre-tokenizer: its merges alone give its ids
        slots.update(zip(letters, self._keep([[k.id for k in merge((b" " + w.encode()).decode("latin-1").translate(_LETTERS))] for w in letters]), strict=True))
        slots.update(zip(other, self._keep(self._encode([" " + w for w in other])), strict=True))
        if marked:
            tails = self._of_firsts([w[len(k) :] for w, k in zip(marked, stems, strict=True)])
            parts = np.stack([np.fromiter(map(slots.__getitem__, stems), np.int64, len(stems)), tails], axis=1)
            slots.update(zip(marked, self._keep_flat(self._ids_of(parts.ravel()), self.lengths[parts].sum(1)), strict=True))
        return np.fromiter(map(slots.__getitem__, words), np.int64, len(words))

    def _of_firsts(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.first_slots})
        self.first_slots.update(zip(new, self._keep(self._encode(new)), strict=True))
        return np.fromiter(map(self.first_slots.__getitem__, words), np.int64, len(words))

    def _lot(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.slots) + len(self.first_slots) > MOST_WORDS:
            self._reset()
        odd = pc.match_substring_regex(texts, _ELSEWHERE).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        words, at = plain.flatten(), plain.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        if odd.any():
            cut = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            words = pa.concat_arrays([words, pa.array([w for c in cut for w in c], words.type)])
            at = np.concatenate([at, at[-1] + np.cumsum([len(c) for c in cut])])
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        firsts = codes[at[:-1]]
        later = np.ones(len(codes), bool)
        later[at[:-1]] = False
        used = np.zeros(len(distinct), bool)
        used[codes[later]] = True
        slot_of = np.zeros(len(distinct), np.int64)
        where = np.flatnonzero(used)
        slot_of[where] = self._of_words([distinct[k] for k in where.tolist()])
        slot = slot_of[codes]
        slot[at[:-1]] = self._of_firsts([distinct[k] for k in firsts.tolist()])
        flat, ends = self._ids_of(slot), np.cumsum(self.lengths[slot].astype(np.int64))
        bounds = np.concatenate([[0], ends])[at]
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        out: list = [None] * len(texts)
        for k, i, j in zip(order.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = flat[i:j]
        return out

    def _lots(self, texts: pa.Array) -> Iterator[np.ndarray]:
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(texts):
            j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), LOT, "right")))
            yield from self._lot(texts[i:j])
            i = j

    def _around_special(self, text: str) -> np.ndarray:
        parts = self.special_cut.split(text)
        between = list(self._lots(pa.array(parts[::2], pa.large_string())))
        marks = [np.array([self.special[m]], np.uint32) for m in parts[1::2]]
        return np.concatenate([x for pair in zip(between, [*marks, np.zeros(0, np.uint32)], strict=True) for x in pair])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a string column, in order, as unsigned 32-bit integers; a null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        held = np.zeros(len(texts), bool)
        for mark in self.special:
            held |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        i = 0
        for k in [*np.flatnonzero(held).tolist(), len(texts)]:
            yield from self._lots(texts[i:k])
            if k < len(texts):
                yield self._around_special(texts[k].as_py())
            i = k + 1


@cache
def word_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path, special_as_text)
