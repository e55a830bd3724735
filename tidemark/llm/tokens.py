"""Token ids of texts by a public tokenizer file, with a memo of words."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Texts of these characters only can be cut into words here: the file's normaliser changes nothing
#: in them but case and white space. Others, and texts with the strings of special tokens, go whole to the tokenizer.
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Chunks and words remembered together; the memo is emptied when full. Some 180 bytes an entry.
MEMO = 900_000


class WordTokenizer:
    """Ids of the vocabulary word_bpe_49k, as the library gives them without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The same model for words that are cut and lower-cased already: no normaliser, white space only.
        plain = json.loads(self.library.to_str())
        plain["normalizer"] = None
        plain["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.bare = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks without white space: of one word, of a word and a mark, or of whatever the pattern finds.

        The pieces of a chunk are chunks too, and are remembered in the same memo.
        """
        memo = self.memo
        plain = [c for c in chunks if c.isalpha()]
        marked = [(c, c[:-1], c[-1]) for c in chunks if c[-1] in ",.:;!?" and c[:-1].isalpha()]
        rest = [(c, _WORDS.findall(c)) for c in chunks.difference(plain, [m[0] for m in marked])]
        unknown = set(plain)
        unknown.update([w for _, w, _ in marked], [m for _, _, m in marked], *[ws for _, ws in rest])
        unknown = unknown.difference(memo)  # in place, this would walk through the whole memo
        words = list(unknown)
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 2).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                memo.update(zip(some, [data[i:j] for i, j in zip([0, *ends], ends)]))
            else:
                memo.update((w, self._slow(w)) for w in some)
        memo.update([(c, memo[w] + memo[m]) for c, w, m in marked])
        memo.update([(c, b"".join(map(memo.__getitem__, ws))) for c, ws in rest])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 16-bit numbers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        cut = [t.lower().split() if "<|" not in t and _SIMPLE.fullmatch(t) else None for t in texts]
        new = set().union(*filter(None, cut)).difference(self.memo)
        if new:
            self._learn(new)
        get = self.memo.__getitem__
        return [self._slow(t) if chunks is None else b"".join(map(get, chunks)) for t, chunks in zip(texts, cut, strict=True)]


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each file and Python process, so that tasks of one worker share its memo."""
    from .common import memo

    return memo(f"tokens {path}", lambda: WordTokenizer(path))
