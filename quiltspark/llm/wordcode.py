"""Whole-text encoding with a public tokenizer, one cached call per distinct word.

Both tokenizers used here cut a text at every space before anything else, so a
text's ids are the joined ids of its space-separated words.  A worker keeps the
ids of the words it has met (at most ``CACHE_WORDS``, then it starts afresh), so
common words cost one dictionary lookup.  Texts in which a space stands beside
another white-space character are given to the tokenizer whole when the
tokenizer keeps white space, because there the cut would not be exact; so are
texts that hold the string of an added (special) token, which is that token.
A new word of letters and one closing sign is put together from both: no
pre-tokenizer used here leaves them in one piece.  New words go to the tokenizer
``JOINED`` at a time with a special token after each: it is taken out before
anything else, so every word is encoded as if alone, and its id shows the ends.
"""

from __future__ import annotations

import os
import re

import numpy as np

CACHE_WORDS, JOINED = 1_500_000, 32
_BESIDE = re.compile(r"\s | \s")
_CLOSING = ",.;:!?"
_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


class WordEncoder:
    """Ids of a text as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = plain[-1] if plain else None
        self.keeps_space = keeps_space
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.closing = dict(zip(_CLOSING, self.whole(list(_CLOSING)), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.array([i for some in ids for i in some], self.kind).tobytes()
        ends = (np.cumsum([len(some) for some in ids]) * self.width).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def words(self, texts: list[str]) -> list[bytes]:
        """As ``whole``, for texts that don't hold an added token's string."""
        if not self.mark:
            return self.whole(texts)
        own, mark = self.mark
        ids: list[int] = []
        for e in self.tokenizer.encode_batch_fast([mark.join([*texts[a : a + JOINED], ""]) for a in range(0, len(texts), JOINED)], add_special_tokens=False):
            ids += e.ids
        flat = np.array(ids, self.kind)
        ends = np.flatnonzero(flat == own)
        flat, ends = flat.tobytes(), (ends * self.width).tolist()
        return [flat[a:b] for a, b in zip([0, *(x + self.width for x in ends)], ends, strict=False)]

    def _learn(self, known: dict[str, bytes], words: set[str], mark: str) -> None:
        new = words.difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = words
        closed = [w for w in new if w[-1:] in self.closing and w[:-1].isalpha()]
        rest = new.difference(closed)
        rest.update({w[:-1] for w in closed}.difference(known))
        new = list(rest)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self.words([mark + w for w in part] if mark else part), strict=True))
        known.update((w, known[w[:-1]] + self.closing[w[-1]]) for w in closed)

    def _holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def encode(self, texts: list[str | None], per_call: int = 512) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), per_call):
            out.extend(self._some(texts[at : at + per_call]))
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if t and ((self.keeps_space and _BESIDE.search(t)) or self._holds_added(t))}
        split = [[""] if i in odd else (t or "").split(" ") if self.keeps_space else (t or "").replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        if self.keeps_space:
            self._learn(self.first, {words[0] for words in split}, "")
            self._learn(self.later, set().union(*(words[1:] for words in split)), " ")
            get = self.later.__getitem__
            out = [self.first[words[0]] + b"".join(map(get, words[1:])) for words in split]
        else:
            self._learn(self.first, set().union(*split), "")
            get = self.first.__getitem__
            out = [b"".join(map(get, words)) for words in split]
        for i in odd:
            out[i] = self.whole([texts[i]])[0]
        return out


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, keeps_space)
    return _ENCODERS[key]
