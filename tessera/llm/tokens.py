"""Fast bulk encoding with a public tokenizer file.

Both vocabularies cut a text into pieces that never cross a single space between two other characters, so a text is
split there, each distinct piece is encoded once by the tokenizers library, and the ids of a whole slice are gathered
from a table. ``WordTable`` keeps that table between slices, and starts anew beyond ``MAX_PIECES`` pieces.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task encodes at once.
SLICE = 2 << 20

#: Distinct pieces that a worker remembers between its tasks, where its operator doesn't say otherwise.
MAX_PIECES = 300_000

#: How byte-level vocabularies write a space.
_SPACE = "\u0120"

#: Stands between pieces that are encoded together.
_MARK = "\x01"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, wherever the package lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def gathered(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[p]:starts[p + 1]]`` of all picks one after another, and where each begins."""
    sizes = np.diff(starts)[picks]
    ends = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    places = np.repeat(starts[:-1][picks] - ends[:-1], sizes)
    places += np.arange(len(places))
    return values[places], ends


def _parts(texts: pa.Array, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings cut out of the buffer of ``texts``: ``sizes`` bytes from each of ``starts``."""
    places = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else starts, sizes)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places + np.arange(len(places))]
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


_tables: dict[tuple[str, bool, int], WordTable] = {}


def word_table(file: str, drops_space: bool, max_pieces: int = MAX_PIECES) -> WordTable:
    """This worker's table, kept between its tasks."""
    key = (file, drops_space, max_pieces)
    if key not in _tables:
        _tables[key] = WordTable(file, drops_space, max_pieces)
    return _tables[key]


class WordTable:
    """Encodes texts to ids; ``drops_space``: the tokenizer itself drops white space and never joins across it."""

    def __init__(self, file: str, drops_space: bool, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file if os.path.sep in file else vocabulary(file))
        self.tokenizer.encode_special_tokens = True
        self.drops_space, self.max_pieces = drops_space, max_pieces
        (self.mark,) = self._encode([_MARK])[0].ids
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Place of each unit in the table; those not in it yet are encoded and added."""
        if len(self.known) + len(units) > max(self.max_pieces, len(units)):
            self._clear()
        number = pc.index_in(units, value_set=self.known).to_numpy(zero_copy_only=False)
        missing = np.isnan(number) if number.dtype.kind == "f" else np.zeros(len(units), bool)
        unknown = units.filter(pa.array(missing)).dictionary_encode()
        new = unknown.dictionary.to_numpy(zero_copy_only=False).tolist()
        kind = np.fromiter(map(self._kind, new), np.int8, len(new))
        words, joined, alone = ([u for u, k in zip(new, kind) if k == way] for way in range(3))
        place = np.empty(len(new), np.int64)  # in the table: words first, then those encoded together
        place[np.argsort(kind, kind="stable")] = np.arange(len(self.known), len(self.known) + len(new))
        bpe, space = self.tokenizer.model.tokenize, "" if self.drops_space else _SPACE
        got = [[t.id for t in bpe(u.replace(" ", space))] for u in words]
        ids, sizes = self._encode_joined(joined)
        more = [e.ids for e in self._encode(alone)]
        ids = np.concatenate((np.fromiter(chain.from_iterable(got), np.uint32), ids,
                              np.fromiter(chain.from_iterable(more), np.uint32)))
        sizes = np.concatenate((np.fromiter(map(len, got), np.int64, len(got)), sizes,
                                np.fromiter(map(len, more), np.int64, len(more))))
        self.known = pa.concat_arrays([self.known, pa.array(words + joined + alone, pa.string())])
        self.ids = np.concatenate((self.ids, ids))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        out = np.where(missing, 0, number).astype(np.int64)
        out[missing] = place[unknown.indices.to_numpy(zero_copy_only=False)]
        return out

    def _pieces(self, pieces: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another and their starts; the last piece is the end of a text. A piece is
        looked up as its stem and the punctuation after a last letter (of ASCII; others are looked up whole): no
        unit of a tokenizer crosses that place."""
        stems = pc.utf8_rtrim(pieces, characters=".,;:!?")
        ends = np.frombuffer(stems.buffers()[1], np.int32)[stems.offset:stems.offset + len(stems) + 1]
        letters = np.frombuffer(stems.buffers()[2] or b" ", np.uint8)
        last = letters[np.maximum(ends[1:] - 1, 0)] | 32
        plain = (last >= ord("a")) & (last <= ord("z")) & (np.diff(ends) > 0)
        stems = pc.if_else(pa.array(plain), stems, pieces)
        size = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        whole = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
        tail_size = np.diff(whole) - size
        tailed = np.flatnonzero(tail_size)
        units = pa.concat_arrays([stems, _parts(pieces, whole[tailed] + size[tailed], tail_size[tailed])])
        number = self._numbers(units)
        picks = np.insert(number[:len(pieces)], tailed + 1, number[len(pieces):])
        ids, starts = gathered(self.ids, self.starts, picks)
        heads = np.arange(len(pieces)) + np.searchsorted(tailed, np.arange(len(pieces)))
        return np.append(ids, np.uint32(end_id)), np.append(starts[heads], (starts[-1], starts[-1] + 1))

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _kind(self, piece: str) -> int:
        """0: one word of ASCII letters, which is one unit that the model encodes by itself; 1: keeps its ids among
        others with ``_MARK`` between, as it doesn't hold the mark and is a word or begins with a space (else the mark
        and its first characters could form one unit); 2: neither."""
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            return 0 if word.isascii() else 1
        if _MARK in piece or self.drops_space:
            return 2 if _MARK in piece else 1
        return 1 if word is not piece and word != "" and word.isprintable() and " " not in word else 2

    def _encode_joined(self, pieces: list[str], together: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece; hundreds are encoded as one text with ``_MARK`` between, which is
        one token that no other token holds."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        between = f" {_MARK} " if self.drops_space else _MARK
        for e in self._encode([between.join([*pieces[i:i + together], ""])
                               for i in range(0, len(pieces), together)]):
            x = np.asarray(e.ids, np.uint32)
            marks = np.flatnonzero(x == self.mark)
            sizes.append(np.diff(marks, prepend=-1) - 1)
            ids.append(np.delete(x, marks))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null as empty), ``end_id`` after each text; offsets of the texts."""
        texts = pc.fill_null(texts, "")
        rows = len(texts)
        if self.drops_space:
            texts = pc.ascii_lower(texts)  # as the tokenizer does itself; fewer distinct pieces
        lists = pc.ascii_split_whitespace(texts) if self.drops_space else pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = lists.flatten().dictionary_encode()
        codes, vocab = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        pieces = vocab
        if not self.drops_space:
            codes, offsets, pieces = self._with_spaces(codes, offsets, vocab)
        ids, starts = self._pieces(pieces, end_id)
        codes = np.insert(codes, offsets[1:], len(pieces))  # the end of each text
        offsets = offsets + np.arange(rows + 1)
        out, ends = gathered(ids, starts, codes)
        return out, ends[offsets]

    @staticmethod
    def _with_spaces(codes: np.ndarray, offsets: np.ndarray, vocab: pa.Array):
        """Pieces as they stand in the text: each but a text's first with the space before it, and pieces whose
        edge is white space (or that are empty) joined with their neighbours."""
        n = len(codes)
        edge = (pc.not_equal(pc.utf8_trim_whitespace(vocab), vocab).to_numpy(zero_copy_only=False)
                | pc.equal(pc.binary_length(vocab), 0).to_numpy(zero_copy_only=False))
        first = offsets[:-1]  # split_pattern gives at least one piece a text
        out = codes.copy()
        out[first] = np.arange(len(vocab), len(vocab) + len(first))
        begins = vocab.take(pa.array(codes[first]))
        more: list[str] = []
        if edge.any():
            rough = edge[codes]
            glued = rough.copy()  # joined with the piece before
            glued[1:] |= rough[:-1]
            glued[first] = False
            heads = np.flatnonzero(~glued)
            run = np.diff(np.append(heads, n))
            is_first = np.zeros(n, bool)
            is_first[first] = True
            for k in np.flatnonzero(run > 1):
                h = heads[k]
                words = vocab.take(pa.array(codes[h:h + run[k]])).to_pylist()
                more.append(("" if is_first[h] else " ") + " ".join(words))
                out[h] = len(vocab) + len(first) + len(more) - 1
            offsets = np.append(np.searchsorted(heads, first), len(heads))
            out = out[heads]
        return out, offsets, pa.concat_arrays([pc.binary_join_element_wise("", vocab, " "), begins,
                                               pa.array(more, pa.string())])
