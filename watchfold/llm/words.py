"""Token ids by a file of the tokenizers library, each distinct piece encoded once.

A text is encoded as ``Tokenizer.encode(text, add_special_tokens=False)`` does.
Where the file's own steps are NFC, white space, lower case and a splitting
pattern, and a text has no character over U+00FF (NFC changes none there and
lower case is one to one) and no string of an added token, the text is split here
and the library encodes each new piece; all other texts go to the library whole.
Of the splitting patterns, ``PATTERN`` is known here; others send all texts there.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np
import regex

from watchfold.llm.pieces import LatinPieces, in_blocks

#: The file's steps and splitting pattern.
STEPS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPACE = regex.compile(r"\p{White_Space}")


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        pre, byte_level = [*(rules.get("pre_tokenizer") or {}).get("pretokenizers", []), {}, {}][:2]
        # The library takes added tokens out of a text before all other steps, unless they are "normalized".
        added = rules.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.split_here = ([s["type"] for s in steps] == STEPS and not any(t["normalized"] for t in added) and pre.get("behavior") == "Removed"
                           and pre.get("invert") and pre["pattern"].get("Regex") == PATTERN and byte_level == BYTE_LEVEL)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.table = LatinPieces(_kind, self._encode_pieces, self.dtype)
        if self.split_here:  # of a piece, the other steps change nothing
            from tokenizers import normalizers, pre_tokenizers

            self.model = Tokenizer.from_file(path)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Where a suffix marks the last token of a piece, many pieces can be encoded as one text and told apart after.
        suffix = rules["model"].get("end_of_word_suffix")
        self.last = np.zeros(size, bool)
        if suffix:
            self.last[[i for token, i in rules["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = [], []
        for at in range(0, len(pieces), 1000):
            own, n = self._encode_together(pieces[at:at + 1000])
            ids.append(own)
            count.append(n)
        return np.concatenate(ids), np.concatenate(count)

    def _encode_together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.model.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(pieces) and (not len(ends) or ends[-1] == len(ids)):
            return ids, np.diff(ends, prepend=0)
        each = [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for own in each for i in own], self.dtype), np.array([len(own) for own in each], np.int64)

    def encode(self, texts: list[str]):
        """Id arrays of whole texts, one for each; a missing text is empty."""
        for block in in_blocks(t or "" for t in texts):
            latin = {}
            for i, text in enumerate(block):
                try:
                    if not self.split_here or any(t in text for t in self.added):
                        raise UnicodeError
                    latin[i] = text.encode("latin-1")
                except UnicodeError:
                    pass
            ids, count = self.table.lookup(list(latin.values()))
            here = iter(np.split(ids, np.cumsum(count)[:-1]))
            for i, text in enumerate(block):
                yield next(here) if i in latin else np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)


def _kind(c: str) -> int:
    """The kind of a character in ``PATTERN``."""
    if _SPACE.fullmatch(c):
        return LatinPieces.SPACE
    category = unicodedata.category(c)[0]
    return {"L": LatinPieces.LETTER, "N": LatinPieces.NUMERAL}.get(category, LatinPieces.OTHER)


@cache
def load(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)
