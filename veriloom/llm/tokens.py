"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

Both kinds of vocabulary here split words before a space or line end that
follows a character other than white space, and between a letter or digit and a
sign of MARKS.  A text is cut there; its ids are those of its pieces in a row, and
a piece that comes again is not encoded again.  New pieces are joined to one text,
which the library encodes in one call; where each piece's ids begin is read from
the ids where they tell (see ``Known.joined``), else from the library's offsets.
The ids are the library's either way.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut at once, and pieces that one call encodes.
STEP, CALL = 1 << 22, 4096
#: Pieces of a generation that are remembered.
HELD = 250_000
#: Signs that a piece begins with where they follow a letter or digit.
MARKS = b",.!?:;#$%&*"
#: Of each byte: 1 for those that a piece begins with anywhere, 2 for MARKS.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \n")], KINDS[list(MARKS)] = 1, 2


#: What is remembered of a piece that ends in white space, which the next may belong to.
OPEN = b"?"


class Known:
    """Ids of pieces.  Two generations are kept: a piece not met in the newer one is looked up in the older."""

    def __init__(self, tokenizer, held: int = HELD) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.held = tokenizer, held
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix, vocab = getattr(tokenizer.model, "end_of_word_suffix", None), tokenizer.get_vocab()
        #: Whether ids end words by their names; else they begin pieces.
        self.ending = bool(suffix)
        #: Ids that end a word, or begin with a space or line end in the byte-level alphabet.
        self.bound = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if not suffix or all(x + suffix in vocab for x in ByteLevel.alphabet()):  # else a word's end may be dropped
            self.bound[[k for x, k in vocab.items() if (x.endswith(suffix) if suffix else x[:1] in ("\u0120", "\u010a"))]] = True

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of ``pieces``, which differ from each other."""
        if len(self.newer) > self.held:
            self.newer, self.older = {}, self.newer
        newer = self.newer
        found = list(map(newer.get, pieces))
        fresh = [k for k, x in enumerate(found) if x is None]
        if not fresh:
            return found
        names = list(map(pieces.__getitem__, fresh))
        plain, other = [], []
        for k, piece, had in zip(fresh, names, map(self.older.get, names), strict=True):
            if had is not None:
                newer[piece] = found[k] = had
            elif piece[-1:].isspace():
                newer[piece] = found[k] = OPEN
            elif piece[:1] not in (" ", "\n"):
                newer[piece] = found[k] = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            elif self.ending and not piece[1:].isalpha():
                other.append(k)
            else:
                plain.append(k)
        for many, encode in ((plain, self.joined), (other, self.together)):
            for at in range(0, len(many), CALL):
                own = many[at : at + CALL]
                names = list(map(pieces.__getitem__, own))
                made = encode(names)
                newer.update(zip(names, made, strict=True))
                for k, x in zip(own, made, strict=True):
                    found[k] = x
        return found

    def joined(self, pieces: list[str]) -> list[bytes]:
        """As ``together``, for pieces of one word each if ids end words.

        A piece has its only space or line end at its start, so one of its ids, the
        first, begins with that.  Where ids end words, every piece has one that does,
        and if there are no more of them than pieces, it is its last.
        """
        made = array("I", self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids)
        at = np.flatnonzero(self.bound[np.frombuffer(made, np.uint32)]) if made else ()
        if len(at) != len(pieces):
            return self.together(pieces)
        ids, at = made.tobytes(), (4 * at).tolist()
        spans = map(slice, [0, *(x + 4 for x in at[:-1])], (x + 4 for x in at)) if self.ending else map(slice, at, [*at[1:], len(ids)])
        return list(map(ids.__getitem__, spans))

    def together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with white space and don't end in it, from one text made of them."""
        made = self.tokenizer.encode("".join(pieces), add_special_tokens=False)
        starts = np.cumsum([0, *map(len, pieces[:-1])])
        first = np.searchsorted(np.fromiter((x[0] for x in made.offsets), np.int64, len(made.ids)), starts) * 4
        ids, ends = array("I", made.ids).tobytes(), [*first[1:].tolist(), 4 * len(made.ids)]
        return list(map(ids.__getitem__, map(slice, first.tolist(), ends)))


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about STEP characters, cut where it may be."""
    at = 0
    while len(text) - at > 2 * STEP:
        end = text.find(" ", at + STEP)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def loose(raw: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the signs at ``marks`` follow neither a letter nor a digit; ``first`` is true where texts begin."""
    before, second = raw[np.maximum(marks - 1, 0)], raw[np.maximum(marks - 2, 0)]
    low = before | 0x20
    plain = (low >= 97) & (low <= 122) & (before < 128) | (before >= 48) & (before <= 57)
    accented = (second == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7)
    return ~(plain | accented) | first[marks]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, held: int = HELD) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer, held)

    def library(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """The ids of each text; null is an empty one."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes, out, first, held = pc.binary_length(texts).to_pylist(), [], 0, 0
        for k, size in enumerate([*sizes, STEP + 1]):  # the last one ends the last run
            if held + size > STEP and k > first:
                run = texts.slice(first, k - first)
                if held > 4 * STEP and k == first + 1 and (pieces := list(parts(run[0].as_py())))[1:]:
                    out.append(b"".join(x for part in pieces for x in self._encoded(pa.array([part], pa.string()))))
                else:
                    out += self._encoded(run)
                first, held = k, 0
            held += size
        return out

    def _encoded(self, texts: pa.Array) -> list[bytes]:
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        kind, first = KINDS[raw], np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        marks = np.flatnonzero(kind == 2)
        kind[marks[loose(raw, marks, first)]] = 0
        edges = np.append(np.flatnonzero((kind > 0) | first[:-1]), len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        ids = self.known.ids(pieces.dictionary.to_pylist())
        index = pieces.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        closes = size != len(OPEN)
        flat = np.frombuffer(b"".join(ids if closes.all() else [x for x, ok in zip(ids, closes, strict=True) if ok]), "<u4")
        count = size >> 2
        begin, own = (np.cumsum(count, dtype=np.int32) - count)[index], count[index]
        ends = np.cumsum(own, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        whole = flat[np.repeat(begin - (ends - own), own) + np.arange(total, dtype=np.int32)].tobytes()
        # where each text's pieces end among all pieces, and so its ids among all ids
        ends = np.append(0, ends).astype(np.int64)[np.searchsorted(edges, bounds)] * 4
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(bounds, edges[:-1][~closes[index]], side="right") - 1] = True
        out = list(map(whole.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist())))
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.library([texts[k].as_py()])[0]
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, held: int = HELD) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, held) not in _ENCODERS:
        _ENCODERS[path, held] = Encoder(path, held)
    return _ENCODERS[path, held]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, column: str = "text", rows: int = 256, size: int = 16 << 20) -> Iterator:
    """Slices of an Arrow batch with few rows and, but for single rows, few bytes."""
    at, n = 0, batch.num_rows
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    while at < n:
        end, held = at + 1, lengths[at]
        while end < min(n, at + rows) and held + lengths[end] <= size:
            held += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end
