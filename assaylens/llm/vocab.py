"""Token ids of public tokenizers, from a cache of what lies between white space."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: White space as the tokenizers' patterns know it; Python's adds \x1c to \x1f.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")
CACHED = 800_000  # words in each of the two generations that a worker remembers
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def path(name: str) -> str:
    """Where a vocabulary file lies on this machine; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of words, for tokenizers that drop white space and never join what it parts.

    Remembers about twice *cached* words, with 200 bytes for each.
    """

    def __init__(self, name: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cached = cached
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, word: str) -> tuple[str, str]:
        """Lower-cased word and the marks at its end, which are a token or more of their own."""
        if "<|" in word:
            return word, ""  # perhaps a special token
        core = word.rstrip(_MARKS)
        if not core or not core[-1].lower().isalnum():
            core = word
        return (core.lower() if core.isascii() else core), word[len(core) :]

    def _learn(self, words: list[str]) -> None:
        plain = [self._plain(w) for w in words]
        wanted = {p for pair in plain for p in pair if p and p not in self.young}
        fresh = []
        for part in wanted:
            if part in self.old:
                self.young[part] = self.old[part]
            else:
                fresh.append(part)
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            for part, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.young[part] = array("I", got.ids).tobytes()
        for word, (core, marks) in zip(words, plain, strict=True):
            self.young[word] = self.young[core] + self.young[marks] if marks else self.young[core]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special tokens added."""
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        parts = [[w for w in _SPLIT.split(t) if w] if _ODD.search(t) else t.split() for t in texts]
        found = [list(map(self.young.get, words)) for words in parts]
        gaps = [[i for i, ids in enumerate(got) if ids is None] for got in found]
        missing = {words[i] for words, gap in zip(parts, gaps, strict=True) for i in gap}
        self.young.update((w, self.old[w]) for w in missing if w in self.old)
        self._learn([w for w in missing if w not in self.young])
        for words, got, gap in zip(parts, found, gaps, strict=True):
            for i in gap:
                got[i] = self.young[words[i]]
        return [b"".join(got) for got in found]


@lru_cache(maxsize=2)
def word_ids(name: str, cached: int = CACHED) -> WordIds:
    """One for each worker process."""
    return WordIds(name, cached)


def forget() -> None:
    """Let go of the words: workers go on with tasks of other stages, which don't need them."""
    word_ids.cache_clear()
