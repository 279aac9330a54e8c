"""SentencePiece encoding and decoding for vocabularies of merges, by an agenda of adjacent pairs ordered by score.

A text's spaces become U+2581, and one is put before it. Symbols are its characters at first; of all adjacent pairs whose
concatenation is a piece, the one of the best score, of equal ones the leftmost, is merged, until there is none. A symbol that is
no piece becomes its UTF-8 bytes. Two characters that are not side by side in any piece are never merged across, so a text may be
cut there: before each space that follows something else (if the vocabulary lets it) into words, and long words at all other such
places. The words of a batch, each once, have their agendas side by side as rows of arrays, long ones in a heap each. All are
checked against the sentencepiece library, batch by batch.

Only models whose text is not rewritten are taken: merges by score, no normalisation, no user-defined or unused pieces; others raise
ValueError on the driver, before any job.

Edge cases: a null text is empty and has no ids but the end id; null ids decode to null, an id outside the vocabulary fails; row ids may be null
or repeat, each row stands for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ship, table

#: What stands for a space in pieces.
SPACE = "▁"
#: Characters of a word that the rows of a batch have room for; a longer one has an agenda of its own.
ROOM = 40
#: Slots, as a power of two, of the table of pairs.
SLOTS = 20
#: Bytes of text handled at once; a longer text is alone.
LOT = 8_000_000
_NONE = np.iinfo(np.int32).max
_ODD = "^$|^ | $|  "
_SEGMENT = re.compile(" +[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCoder:
    """Encodes and decodes by one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        self.size, self.end, self.unknown = sp.get_piece_size(), sp.eos_id(), sp.unk_id()
        self.pieces = sp.id_to_piece(list(range(self.size)))
        kept = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in kept}
        self.score = {self.pieces[i]: -sp.get_score(i) for i in kept}  # the least comes first
        self.inside = {a + b for p in self.id for a, b in pairwise(p)}
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        #: May a text be cut before every space that follows something else?
        self.by_space = not any(p[1] == SPACE != p[0] for p in self.inside)
        surface = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.byte.items():
            surface[i] = bytes([b])
        surface[self.unknown] = sp.decode([self.unknown]).encode()
        self.surface_size = np.fromiter(map(len, surface), np.int64, self.size)
        self.surface_first, self.surface_bytes = np.cumsum(self.surface_size) - self.surface_size, np.frombuffer(b"".join(surface), np.uint8)
        self.controls = np.array([sp.is_control(i) for i in range(self.size)])
        self.starts_spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        self._tabulate()

    def _tabulate(self) -> None:
        """Symbols by number (pieces by their ids, then characters that are no piece) and the pairs of them that make a piece."""
        characters = {c for p in self.id for c in p} | {chr(b) for b in self.byte if b < 128}
        number = self.id | {c: self.size + k for k, c in enumerate(sorted(characters.difference(self.id)))}
        order = {s: k for k, s in enumerate(sorted(set(self.score.values())))}
        pairs = {(number[p[:k]], number[p[k:]]): (order[self.score[p]], self.id[p]) for p in self.id for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.symbols = self.size + len(characters)
        keys = np.array([a * self.symbols + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, found = keys[by], np.array(list(pairs.values()), np.int32).reshape(-1, 2)[by]
        self.pair_order, self.pair_piece = np.append(found[:, 0], _NONE), np.append(found[:, 1], 0)
        slot = _slot(self.pair_keys)
        self.at_slot = np.full(1 << SLOTS, len(self.pair_keys), np.int32)
        self.at_slot[slot] = np.arange(len(slot), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=1 << SLOTS) > 1
        self.pair_keys = np.append(self.pair_keys, -1)
        single = {ord(c): k for c, k in number.items() if len(c) == 1}
        self.points, self.point_symbol = np.array(sorted(single)), np.array([single[c] for c in sorted(single)], np.int32)
        #: The id of a symbol that is left; -1 if that is several bytes.
        self.left = np.arange(self.symbols, dtype=np.int32)
        for c, k in number.items():
            if k >= self.size:
                known = self._known(c)
                self.left[k] = known[0] if len(known) == 1 else -1

    def agenda(self, text: str) -> list[int]:
        """The ids of a text whose spaces are written as SPACE; no piece is longer than its surroundings let it grow."""
        symbol, score = list(text), self.score
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        todo = [(score[p], k, p) for k, p in enumerate(map("".join, pairwise(symbol))) if p in score]
        heapify(todo)
        end = len(symbol)
        while todo:
            _, left, merged = heappop(todo)
            right = after[left]
            if symbol[left] is None or right >= end or symbol[left] + symbol[right] != merged:
                continue  # one of the two has been merged with another since
            symbol[left], symbol[right] = merged, None
            after[left] = follows = after[right]
            if follows < end:
                before[follows] = left
                if (p := merged + symbol[follows]) in score:
                    heappush(todo, (score[p], left, p))
            if (k := before[left]) >= 0 and (p := symbol[k] + merged) in score:
                heappush(todo, (score[p], k, p))
        return list(chain.from_iterable(self._known(s) for s in symbol if s is not None))

    def _known(self, symbol: str) -> list[int]:
        if symbol in self.id:
            return [self.id[symbol]]
        return [self.byte[b] for b in symbol.encode()] if self.byte else [self.unknown]

    def _word(self, word: str) -> list[int]:
        """The ids of a segment that is written without its first space, by agendas of its own."""
        text = SPACE + word.replace(" ", SPACE)
        cuts = [0, *(k + 1 for k, p in enumerate(map("".join, pairwise(text))) if p not in self.inside), len(text)]
        return list(chain.from_iterable(self.agenda(text[i:j]) for i, j in pairwise(cuts)))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where these pairs of symbols stand among those that make a piece; the last place if nowhere."""
        key = left.astype(np.int64) * self.symbols + right
        key[(left < 0) | (right < 0)] = -2
        slot = _slot(key)
        at = self.at_slot[slot]
        miss = self.pair_keys[at] != key
        at[miss] = len(self.pair_keys) - 1
        if (unsure := miss & self.shared[slot]).any():  # another pair has the slot
            k = np.searchsorted(self.pair_keys[:-1], key[unsure])
            at[unsure] = np.where(self.pair_keys[k] == key[unsure], k, len(self.pair_keys) - 1)
        return at

    def _rows(self, words: list[str], room: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each of these words, at most ``room`` with the first space, and their number; -1 beyond it.

        Each row is an agenda: the pairs of a word with their scores. In each round every word that still has a pair merges its best.
        """
        point = np.frombuffer("".join([SPACE + w for w in words]).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = np.minimum(np.searchsorted(self.points, point), len(self.points) - 1)
        symbol = np.full((len(words), room), -1, np.int32)
        column = np.arange(room)
        symbol[column < size[:, None]] = np.where(self.points[at] == point, self.point_symbol[at], -2)  # -2: a character of several bytes
        out, rows = symbol.copy(), np.arange(len(words))
        place = self._pairs(symbol[:, :-1], symbol[:, 1:])
        count = size.copy()
        while len(rows):
            order = self.pair_order[place]
            best = order.argmin(1)  # the leftmost of equal ones
            each = np.arange(len(rows))
            more = order[each, best] < _NONE
            if not more.all():
                done = ~more
                out[rows[done]] = symbol[done]
                rows, symbol, place, best, each = rows[more], symbol[more], place[more], best[more], np.arange(int(more.sum()))
            merged = self.pair_piece[place[each, best]]
            count[rows] -= 1
            symbol = _closed(symbol, best, -1)
            place = _closed(place, best, len(self.pair_keys) - 1)
            symbol[each, best] = merged
            last = best < room - 1
            place[each[last], best[last]] = self._pairs(merged[last], symbol[each[last], best[last] + 1])
            some = best > 0
            place[each[some], best[some] - 1] = self._pairs(symbol[each[some], best[some] - 1], merged[some])
        return out, count

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these different words, one after another, and the number of each."""
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ids: list = [None] * len(words)
        flat, sizes, order = [], [], []
        short = np.flatnonzero(length <= ROOM)
        short = short[np.argsort(length[short], kind="stable")]
        for lot in np.array_split(short, max(1, -(-len(short) // 8192))):  # of about the same length
            if len(lot):
                symbol, count = self._rows([words[k] for k in lot.tolist()], int(length[lot[-1]]) + 1)
                held = np.arange(symbol.shape[1]) < count[:, None]
                plain = ((symbol >= 0) | ~held).all(1) & ((self.left[symbol] >= 0) | ~held).all(1)
                flat.append(self.left[symbol[held & plain[:, None]]])
                sizes.append(count[plain])
                order.append(lot[plain])
        own = np.ones(len(words), bool)
        own[np.concatenate([*order, np.zeros(0, np.int64)])] = False
        own = np.flatnonzero(own)
        lists = [self._word(words[k]) for k in own.tolist()]
        flat.append(np.fromiter(chain.from_iterable(lists), np.int32))
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        size, order = np.concatenate(sizes), np.concatenate([*order, own])
        first, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[order], count[order] = np.cumsum(size) - size, size
        return np.concatenate(flat)[_runs(first, count)], count

    def _checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``_words`` gives, checked against the library."""
        ids, size = self._words(words)
        library = self.library.encode(words, num_threads=1)
        if "" in words:  # the space at a text's end; to the library an empty text
            library[words.index("")] = self.agenda(SPACE)
        theirs = np.fromiter(map(len, library), np.int64, len(words))
        if (theirs != size).any() or (np.fromiter(chain.from_iterable(library), np.int32, theirs.sum()) != ids).any():
            raise RuntimeError("the agenda and the sentencepiece library differ")
        return ids, size

    def _segments(self, text: str) -> list[str]:
        """The segments of a text that has spaces side by side or at an end, without the first space of each."""
        if not self.by_space:
            return [text] if text else []
        return [s[1:] for s in _SEGMENT.findall(" " + text)] if text else []

    def _lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.by_space else np.ones(len(texts), bool)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        n = np.empty(len(texts), np.int64)
        n[~odd] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
        cut = [self._segments(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        n[odd] = [len(c) for c in cut]
        coded = pa.concat_arrays([plain.flatten(), pa.array([w for c in cut for w in c], pa.large_string())]).dictionary_encode()
        flat, size = self._checked(coded.dictionary.to_pylist())
        # The words of plain texts come first, then those of the others; back to the order of the texts.
        first = np.empty(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        first[order] = np.cumsum(n[order]) - n[order]
        code = coded.indices.to_numpy()[_runs(first, n)]
        ids = flat[_runs((np.cumsum(size) - size)[code], size[code])]
        return ids, np.concatenate([[0], np.cumsum(size[code])])[np.concatenate([[0], np.cumsum(n)])]

    def encode(self, texts: pa.Array, end: bool = True) -> pa.Array:
        """The ids of each row of a string column as lists of 32-bit integers; a null is an empty text."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")  # the model can't tell them apart
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        ids, bounds, i = [], [np.zeros(1, np.int64)], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + LOT, "right")))
            flat, at = self._lot(texts[i:j])
            if end:
                flat, at = np.insert(flat, at[1:], self.end), at + np.arange(len(at))
            ids.append(flat)
            bounds.append(bounds[-1][-1] + at[1:])
            i = j
        return pa.ListArray.from_arrays(pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(ids) if ids else [], pa.int32()))

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids, as the library gives it; null for null."""
        ids = lists.flatten().to_numpy()
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError(f"ids are from 0 to {self.size - 1}")
        n = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
        size = self.surface_size[ids]
        raw = self.surface_bytes[_runs(self.surface_first[ids], size)]
        at = np.concatenate([[0], np.cumsum(n)])
        bound = np.concatenate([[0], np.cumsum(size)])[at]
        # The first id that is no control: a space that it begins with stands for the beginning of the text.
        shown = np.flatnonzero(~self.controls[ids])
        first = np.append(shown, len(ids))[np.searchsorted(shown, at[:-1])]
        spaced = (first < at[1:]) & np.append(self.starts_spaced[ids], False)[first]
        whole = raw.tobytes()
        out = [whole[i:j] for i, j in zip((bound[:-1] + spaced).tolist(), bound[1:].tolist(), strict=True)]
        for k, text in enumerate(out):
            try:
                out[k] = text.decode()
            except UnicodeDecodeError:  # bytes that are no text: the library has its own way
                out[k] = self.library.decode(ids[at[k] : at[k + 1]].tolist())
        return pc.if_else(lists.is_valid(), pa.array(out, pa.string()), None)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... as many as size[0], then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _closed(rows: np.ndarray, gap: np.ndarray, last) -> np.ndarray:
    """The rows with the entry behind each one's ``gap`` taken out and ``last`` put at the end."""
    wide = np.concatenate([rows, np.full((len(rows), 1), last, rows.dtype)], 1)
    column = np.arange(rows.shape[1])
    return np.take_along_axis(wide, column + (column > gap[:, None]), 1)


@cache
def piece_coder(path: str) -> PieceCoder:
    """One for each Python worker."""
    return PieceCoder(path)


def check_model(path: str) -> None:
    """ValueError unless the model at ``path`` is one that this module encodes."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    kind, spec = type(model.SentencePiece()), model.normalizer_spec
    sound = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
    sound &= spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    if not sound or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError("only models of merges by score, without normalisation and user-defined or unused pieces, are supported")


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(id, ids) of every whole text, with the end id behind unless ``end`` is false."""
    ship(docs.sparkSession)
    path = path or model_path()
    check_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), piece_coder(path).encode(b.column(1), end)], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of every list of ids."""
    ship(coded.sparkSession)
    path = path or model_path()
    check_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, piece_coder(path).decode(b.column(1))], ["id", "ids", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnsRenamed({"id": id_col, "ids": ids_col})


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"))
