"""Splitting and encoding for a lower-casing, word-wise BPE vocabulary of the tokenizers library.

The library gives every id.  What is done here is only the cut into *units* that it encodes
independently: white-space tokens of lower-cased text.  That holds for texts of common Latin
characters; any other text (unusual characters, special-token strings) is cut by the library's
own normaliser and pre-tokeniser, so the result is the library's in each case.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Characters beyond those for which lower().split() equals the library's normaliser and cut.
_ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-įı-ž‐-‧‰-›€]")
#: Fixed value: the pre-tokeniser's words, for texts without odd characters; ends of lines, which no unit holds, stay.
_WORD = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿā-ž]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿā-ž0-9²³¹¼½¾]+")
#: Fixed value: the pre-tokeniser that ``_WORD`` stands for.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks of units that the library cut (byte-level form) and of special tokens.
CUT, SPECIAL = "\x00", "\x01"
#: Units that the library gets at once.
UNITS = 20_000


def _byte_level() -> dict[int, int]:
    """Byte to character of the library's byte-level alphabet; blanks, which part words, stay."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return dict(zip(seen, seen, strict=True)) | {b: 256 + i for i, b in enumerate(rest) if b != 32}


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        # Of a vocabulary with these words only the byte-level form is left to do, so the model alone gives their ids.
        self.words, known = None, [{"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        if (json.loads(self.tok.to_str())["pre_tokenizer"] or {}).get("pretokenizers") == known:
            words, self.bytes = Tokenizer(self.tok.model), _byte_level()
            words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            ends = words.encode("\n".translate(self.bytes), add_special_tokens=False).ids
            if len(ends) == 1:
                self.words, self.end = words, ends[0]
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def units(self, text: str | None) -> list[str]:
        """The units of a text in order."""
        if not text:
            return []
        if not _ODD.search(text) and not any(s in text for s in self.special):
            return text.lower().split()
        out: list[str] = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.special:
                out.append(SPECIAL + part)
            elif part:
                out += [CUT + w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian uint32."""
        odd = [i for i, u in enumerate(units) if u[0] <= SPECIAL]
        if not odd:
            return self._encode_plain(units)
        out = [b""] * len(units)
        for i in odd:
            u = units[i]
            ids = [t.id for t in self.tok.model.tokenize(u[1:])] if u[0] == CUT else [self.special[u[1:]]]
            out[i] = np.array(ids, "<u4").tobytes()
        plain = sorted(set(range(len(units))).difference(odd))
        for i, raw in zip(plain, self._encode_plain([units[i] for i in plain]), strict=True):
            out[i] = raw
        return out

    def _encode_plain(self, units: list[str]) -> list[bytes]:
        """Plain units, some at a time as one text: their words and, between units, ends of lines, which have an id of their own."""
        if self.words is None:  # a vocabulary of other words
            return [np.array(self.tok.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in units]
        out: list[bytes] = []
        for k in range(0, len(units), UNITS):
            some = units[k : k + UNITS]
            text = " ".join(_WORD.findall("\n".join(some))).encode().decode("latin-1").translate(self.bytes)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), np.flatnonzero(ids == self.end) * 4
            out += [raw[a:b] for _, a, b in zip(some, [0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)], strict=True)]
        return out


class UnitCache(dict):
    """unit -> ids as little-endian bytes, filled on demand.

    Its memory is bounded: where it would hold more than ``most`` units, those go that were met in one lookup alone
    since it was last full, and if that is too little, all but the present lookup's.
    """

    def __init__(self, bpe: WordBpe, most: int = 300_000):
        super().__init__()
        self.bpe, self.most = bpe, most
        self.again: set[str] = set()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; the units that are new are encoded together."""
        cut = [self.bpe.units(t) for t in texts]
        here = set().union(*cut)
        new = list(here.difference(self))
        here.difference_update(new)
        self.again |= here
        if len(self) + len(new) > self.most:
            kept = self.again if len(self.again) + len(new) <= self.most else here
            kept = {u: self[u] for u in kept}
            self.clear()
            self.again.clear()
            self.update(kept)
        self.update(zip(new, self.bpe.encode_units(new), strict=True))
        return [b"".join(map(self.__getitem__, us)) for us in cut]


@functools.cache
def load(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


@functools.cache
def load_cache(path: str) -> UnitCache:
    return UnitCache(load(path))
