"""Token ids of whole texts by the 49k word BPE, word by word.

The vocabulary's pre-tokenizer cuts a text into words that are encoded apart, so a word's ids can
be remembered. Only texts of characters for which lower-casing and normal forms are plain take
that way; all others, and those that could hold a special token, go to the tokenizer whole."""

from __future__ import annotations

import re

import numpy as np

#: Characters whose lower case is one character and that no normal form changes.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]*")
#: Letters and digits among them, in lower case.
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The word pattern of the vocabulary file (a fixed value of its format) over these characters.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
#: Words remembered by one worker; beyond it, the memory starts again.
REMEMBERED = 600_000


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode new words in one call; each word's last id is the one that ends a word."""
        buffer = self.whole(" ".join(words))
        cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(buffer, dtype="<u4")]) + 1)).tolist()
        if len(cuts) == len(words):
            own = [buffer[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        else:
            own = [self.whole(w) for w in words]
        self.ids.update(zip(words, own, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        known = self.ids
        if len(known) > REMEMBERED:
            known.clear()
        words = [WORDS.findall(x.lower()) if "<|" not in x and PLAIN.fullmatch(x) else None for x in texts]
        new = [w for w in set().union(*filter(None, words)) if w not in known]
        if new:
            self.learn(new)
        return [self.whole(x) if ws is None else b"".join(map(known.__getitem__, ws)) for x, ws in zip(texts, words, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
