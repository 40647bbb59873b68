"""Token ids of whole texts, by the tokenizers library with a bounded memo of pieces, batch by batch.

A piece is what lies between blanks or line feeds; punctuation that closes a word is a piece of its own. The pre-tokenizers
used here always cut at these points and no merge crosses a cut, so a text's ids are its pieces' ids in a row. Arrow splits
a batch and numbers its distinct pieces; only those that the memo lacks are encoded, many in one call with a separator
between them; NumPy gathers the ids. Texts where the cuts would depend on more (``_RARE``) are encoded as a whole.

Cases: null is empty and has no ids; special tokens in a text are read as the library reads them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; of a full memo stay those that several batches used, at most half.
MEMO = 300_000
#: Pieces that are encoded in one call.
CALL = 8_000
#: Texts that go to the tokenizer whole: other white space than blanks and line feeds, and runs of it but for two line feeds
#: (where white space is kept); the mark itself. A special token, in any case, makes a text rare as well.
_RARE_BLANKS = r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n\n|\n\n\z|\A\n|\A | \z|\x00"
_RARE_WORDS = r"\x00"
#: ASCII punctuation between a letter and a blank (letters whose normal forms are letters).
_CLOSING = r"([A-Za-z\x{df}-\x{f6}\x{f8}-\x{ff}])([!-/:-@\[-\x60{-~]+)( |\z)"
_loaded: dict[tuple[str, str], PieceEncoder] = {}


class PieceEncoder:
    """``keeps_blanks``: the tokenizer sees the blank before a piece (a piece without one begins with the mark ``\\0``);
    else white space only separates, and case does not matter."""

    def __init__(self, path: str, dtype: str, keeps_blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.keeps_blanks = np.dtype(dtype), keeps_blanks
        self.between = "\n" if keeps_blanks else " ~ "
        (self.cut,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rare = "|".join([_RARE_BLANKS if keeps_blanks else _RARE_WORDS, *("(?i:" + re.escape(t) + ")" for t in special)])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.start, self.size, self.used = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.pool = np.zeros(0, dtype=self.dtype)

    def _shrink(self) -> None:
        keep = np.argsort(-self.used, kind="stable")[: MEMO // 2]
        keep = np.sort(keep[self.used[keep] > 1])
        size = self.size[keep]
        ends = np.cumsum(size, dtype=np.int64)
        self.pool = self.pool[np.repeat(self.start[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        self.known = self.known.take(pa.array(keep))
        self.start, self.size, self.used = (ends - size).astype(np.int32), size, self.used[keep] // 2

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.Array, blank: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without the separator in them, ``blank`` before each, and the number of each piece's ids."""
        ids, size = [], []
        for lo in range(0, len(pieces), CALL):
            some = pieces.slice(lo, CALL)
            text = blank + pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), self.between + blank)[0].as_py() + self.between
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cut = np.flatnonzero(found == self.cut)
            size.append(np.diff(cut, prepend=-1) - 1)
            ids.append(found[found != self.cut])
        return np.concatenate(ids), np.concatenate(size)

    def _learn(self, pieces: pa.Array) -> None:
        odd = pc.match_substring(pieces, self.between.strip(" "))
        plain = pieces.filter(pc.invert(odd))
        if self.keeps_blanks:
            marked = pc.starts_with(plain, "\0")
            bare, rest = plain.filter(marked), plain.filter(pc.invert(marked))
            groups = [(bare, pc.utf8_slice_codeunits(bare, 1), ""), (rest, rest, " ")]
        else:
            groups = [(plain, plain, "")]
        parts = [(names, *self._joined(texts, blank)) for names, texts, blank in groups if len(names)]
        if (odd := pieces.filter(odd)) and len(odd):
            found = self.whole([x.removeprefix("\0") for x in odd.to_pylist()])
            parts.append((odd, np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)))
        for names, ids, size in parts:
            self.known = pa.concat_arrays([self.known, names])
            self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(size) - size).astype(np.int32)])
            self.size = np.concatenate([self.size, size.astype(np.int32)])
            self.used = np.concatenate([self.used, np.zeros(len(size), dtype=np.int32)])
            self.pool = np.concatenate([self.pool, ids])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Places of the distinct ``pieces`` in the memo; what it lacks is encoded."""
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            if len(self.known) + at.null_count > MEMO:
                self._shrink()
                at = pc.index_in(pieces, value_set=self.known)
            self._learn(pieces.filter(at.is_null()))
            at = pc.index_in(pieces, value_set=self.known)
        found = at.to_numpy(zero_copy_only=False)
        self.used[found] += 1
        return found

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without rare places, one after the other, and the number of each text's ids."""
        if self.keeps_blanks:
            texts = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \0\n \0"), "")
            texts = pc.replace_substring_regex(texts, _CLOSING, r"\1 %s\2\3" % "\0")
        else:
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\n\t\r]", " ")
            texts = pc.replace_substring_regex(texts, _CLOSING, r"\1 \2\3")
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        slot = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        size = self.size[slot]
        ends = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(size, dtype=np.int32)])
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat(self.start[slot] - ends[:-1], size)
        ids = self.pool[place]
        return ids, np.diff(ends[edges - edges[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        rare = pc.match_substring_regex(texts, self.rare).to_numpy(zero_copy_only=False)
        counts, odd = np.zeros(len(texts), dtype=np.int64), []
        if rare.any():
            odd = self.whole(texts.filter(pa.array(rare)).to_pylist())
            counts[rare] = [len(x) for x in odd]
        if rare.all():
            return np.concatenate([np.zeros(0, dtype=self.dtype), *odd]), counts
        ids, counts[~rare] = self._pieces(texts.filter(pa.array(~rare)) if odd else texts)
        if not odd:
            return ids, counts
        out, odd_place = np.empty(counts.sum(), dtype=self.dtype), np.repeat(rare, counts)
        out[~odd_place] = ids
        out[odd_place] = np.concatenate(odd)
        return out, counts

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after every text; the numbers count it."""
        ids, counts = self.encode(texts)
        out, ends = np.full(len(ids) + len(counts), end_id, dtype=self.dtype), np.cumsum(counts + 1) - 1
        own = np.ones(len(out), dtype=bool)
        own[ends] = False
        out[own] = ids
        return out, counts + 1

    def encode_list(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


def encoder(path: str, dtype: str, keeps_blanks: bool) -> PieceEncoder:
    """One per worker process."""
    key = (path, dtype)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[key] = PieceEncoder(path, dtype, keeps_blanks)
    return _loaded[key]


def binary_array(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``data``, ``counts`` elements each, as binary values."""
    offsets = np.concatenate([[0], np.cumsum(counts) * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


#: Bytes of text that are encoded at once.
SLICE = 2 << 20


def byte_batches(batches, text_column: int, most: int = 4 << 20):
    """Arrow batches cut so that each slice holds few MB of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield batch.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()  # idle workers should not hold on to a batch's buffers
