"""Token ids of many texts, through the tokenizers library.

A text is cut where no token can cross, and each distinct piece is encoded
once; a worker keeps the pieces it has seen, up to a bound.  The ids are those
of encoding each text alone.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import coded

#: Pieces that a worker keeps; beyond them, those stay that it has met in several batches.
KEPT = 600_000

#: A space beside other white space: byte-level pre-tokenizers join such runs, so these texts are encoded whole.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]"
#: Letters with signs after them: pre-tokenizers part these, so the letters and the signs are encoded by themselves.
_PLAIN = r"^(?P<word> ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
#: Stands between pieces that are encoded together, unless ids tell where they part; pieces of such a run.
_DIVIDER, _RUN_PIECES = "\x00", 1000


def spread(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """One tokenizer file. ``spaces``: its tokens begin at single spaces (byte-level); else white space only divides, and case is folded.

    Texts that hold the string of a special token are encoded whole, and it gives the token's id, as the library has it.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: The file's model alone, for lower-case ASCII words between spaces, if its other steps leave these as they are.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        if self.whole([ascii_lowercase]) != self.whole([ascii_lowercase], plain=True):
            self.model = self.tokenizer
        self.spaces = spaces
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that begin with a space (byte-level) or end a word, and the id that a divider alone gives.
        self.marks, self.divides = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        self.marks[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if spaces else t.endswith("</w>"))]] = True
        if len(divider := self.whole([_DIVIDER])[0]) == 1:
            self.divides[divider] = True
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, texts: list[str], plain: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.model if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece), each piece encoded by itself."""
        ids = self.whole(pieces)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _together(self, pieces: list[str], divided: bool, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same from runs of pieces, which costs less: ids tell where pieces part, or else they are encoded apart. ``plain``: by the model alone."""
        join = f" {_DIVIDER} ".join if divided else "".join if self.spaces else " ".join
        runs = [pieces[i : i + _RUN_PIECES] for i in range(0, len(pieces), _RUN_PIECES)]
        out = []
        for run, ids in zip(runs, self.whole([join(r) for r in runs], plain), strict=True):
            found = np.array(ids, np.uint32)
            at = np.flatnonzero((self.divides if divided else self.marks)[found])
            if len(at) != len(run) - divided:
                out.append(self._apart(run))
            elif divided:
                out.append((np.delete(found, at), np.diff(np.r_[-1, at, len(found)]) - 1))
            else:
                out.append((found, np.diff(np.r_[at, len(found)] if self.spaces else np.r_[-1, at])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _encoded(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in some order, their ids and numbers of ids."""
        if self.spaces:
            ways = [([p for p in pieces if p[:1] == " "], lambda p: self._together(p, False)), ([p for p in pieces if p[:1] != " "], self._apart)]
        else:
            plain, words, rest = [], [], []
            for p in pieces:
                (rest if not p.isalpha() else plain if p.isascii() and p.islower() else words).append(p)
            ways = [(plain, lambda p: self._together(p, False, plain=True)), (words, lambda p: self._together(p, False)), (rest, lambda p: self._together(p, True))]
        parts = [(p, *way(p)) for p, way in ways if p]
        return list(chain.from_iterable(p[0] for p in parts)), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))

    def _forget(self) -> None:
        """Keeps what several batches had."""
        stay = self.met > 1
        if stay.sum() > KEPT // 2:
            stay[:] = False
        counts = self.counts[stay]
        self.flat = self._ids(np.flatnonzero(stay))
        self.known = {p: i for i, p in enumerate(p for p, s in zip(self.known, stay.tolist(), strict=True) if s)}
        self.starts, self.counts, self.met = np.cumsum(counts) - counts, counts, np.ones(len(counts), np.int32)

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        """Ids of kept pieces, one after another."""
        return spread(self.flat, self.starts[slots], self.counts[slots])

    def _slots(self, pieces: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            wanted = [pieces[i] for i in missing.tolist()]
            new, ids, counts = self._encoded(wanted)
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
            self.counts, self.met = np.r_[self.counts, counts], np.r_[self.met, np.zeros(len(new), np.int32)]
            self.flat = np.r_[self.flat, ids]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            slots[missing] = np.fromiter(map(self.known.__getitem__, wanted), np.int64, len(wanted))
        self.met[slots] += 1
        return slots

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text; a null is empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        if len(self.known) > KEPT:
            self._forget()
        runs = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False) if self.spaces else np.zeros(len(texts), bool)
        if self.special:
            runs = runs | pc.match_substring_regex(texts, self.special, ignore_case=True).to_numpy(zero_copy_only=False)
        rows, codes, pieces = coded(pc.if_else(pa.array(runs), "", texts) if runs.any() else texts, whitespace=not self.spaces)
        if self.spaces:
            first = np.r_[True, rows[1:] != rows[:-1]]
            leads, at = np.unique(codes[first], return_inverse=True)
            codes[first] = len(pieces) + at
            pieces = pa.concat_arrays([pc.binary_join_element_wise(" ", pieces, ""), pieces.take(pa.array(leads))])
        plain = pc.extract_regex(pieces, _PLAIN)
        word, signs = pc.struct_field(plain, 0), pc.struct_field(plain, 1)
        word = pc.coalesce(word if self.spaces else pc.utf8_lower(word), pieces)
        parts = pa.concat_arrays([word, pc.fill_null(signs, "")]).dictionary_encode()
        # By way of numpy: to_pylist makes an Arrow scalar of each string.
        slots = self._slots(parts.dictionary.to_numpy(zero_copy_only=False).tolist())[parts.indices.to_numpy(zero_copy_only=False)]
        # A table of whole pieces first, then the texts from it.
        words, marks = slots[: len(pieces)], slots[len(pieces) :]
        table = self._ids(np.stack([words, marks], axis=1).reshape(-1))
        widths = self.counts[words] + self.counts[marks]
        counts = widths[codes]
        ids = spread(table, (np.cumsum(widths) - widths)[codes], counts)
        ends = np.r_[0, np.cumsum(counts)]
        out = np.split(ids, ends[np.searchsorted(rows, np.arange(1, len(texts)))])
        if runs.any():
            at = np.flatnonzero(runs)
            for i, found in zip(at.tolist(), self.whole(texts.take(pa.array(at)).to_pylist()), strict=True):
                out[i] = np.array(found, np.uint32)
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder for a file."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]
