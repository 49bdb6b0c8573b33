"""Encoding with the tokenizers library, each distinct unit of text once.

A vocabulary's own rules tell which cuts in a text are free: no token, and no
decision about one, reaches over them. Texts are cut there, distinct units go
through the library, and a bounded cache keeps what came out. Where a text has
something that could reach over a cut, the library gets it whole.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Units that a worker's cache holds; beyond it a new one begins, which takes what
#: is still asked for from the old one.
CACHE_UNITS = 200_000
#: Longer units are encoded each time; they hardly recur.
UNIT_CHARS = 64

_KEPT: dict[tuple[str, str], "Encoder"] = {}
#: Letters whose class every Unicode version agrees on, and marks: a run of them
#: is a match of its own behind letters, and in no special token.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?$%&*#@+=-/()[]{}\""
_AT_ONCE = 500
#: Words that show whether a vocabulary's rules leave words of letters as they are.
_PROBE = ("a", "The", "Unbelievably", "xqzvk", "naïve", "Über", "straße", "ÀÉÿ", "of", "internationalisation")
#: Characters that Python, but not Unicode, counts as white space.
PYTHON_ONLY_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(x) if x in shown else chr(next(hidden)) for x in range(256)]


_SHOWN = {x: y for x, y in enumerate(byte_alphabet()) if x != 32}


def word_units(text: str) -> list[str]:
    """What stands between white space as Unicode defines it."""
    if any(x in text for x in PYTHON_ONLY_SPACE):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


class Encoder:
    """``ids(texts)``: each text's ids as little-endian unsigned 32-bit bytes."""

    #: Units of a cache; two of them may be held.
    most = CACHE_UNITS
    #: Where the first token of a word, or the last, can be told by its spelling.
    first_mark = last_mark = ""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.cache: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.runs: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith(self.first_mark) and token.endswith(self.last_mark)
        # the same model, to which words go that no other rule changes
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        given = [" " + x for x in _PROBE]
        self.is_plain = self.direct(given) == [array("I", self.bare.encode(self.shown(x), add_special_tokens=False).ids).tobytes() for x in given]

    def shown(self, text: str) -> str:
        """Words of ``_LETTERS``, a space before each, as the model itself spells them."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_SHOWN)
        return text.replace(" ", " " + self.first_mark)

    def direct(self, texts: Iterable[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def letters(self, words: list[str], plain: bool = False) -> list[bytes]:
        """Ids of words of letters only, many in one call.

        A word of letters is one match of the pattern, so its tokens are told
        from its neighbours' by the edge they show. Should the edges not add up,
        the words are encoded one by one. ``plain`` words, of ``_LETTERS`` only,
        are spelled here and go to the model past the library's other rules.
        """
        library, spell = (self.bare, self.shown) if plain else (self.library, str)
        out: list[bytes] = []
        for i in range(0, len(words), _AT_ONCE):
            own = words[i : i + _AT_ONCE]
            ids = library.encode_batch_fast([spell(" " + " ".join(own))], add_special_tokens=False)[0].ids
            raw = array("I", ids).tobytes()
            at = np.flatnonzero(self.edge[np.frombuffer(raw, np.uint32)])
            if len(at) != len(own):
                out += self.direct(" " + x for x in own)
                continue
            cuts = (4 * at).tolist() + [len(raw)] if self.first_mark else [0, *(4 * at + 4).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def cut(self, text: str) -> list[str]:
        """Keys of the text's units."""
        raise NotImplementedError

    def spelled(self, key: str) -> str | None:
        """What to encode for a key; None if its text has to stay whole."""
        raise NotImplementedError

    def learn(self, keys: set[str]) -> set[str]:
        """Have ids of all keys in the cache; returns those that were new."""
        cache, runs = self.cache, self.runs
        new = keys - cache.keys()
        known = new & self.old.keys()
        cache.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new -= known
        marked = [(x, y) for x in new if len(y := x.rstrip(_MARKS)) < len(x) <= UNIT_CHARS and (y.isalpha() if y.isascii() else _LETTERS.fullmatch(y))]
        unseen = {x[len(y) :] for x, y in marked} - runs.keys()
        runs.update(zip(unseen, self.direct(unseen), strict=True))
        need = new.difference([x for x, _ in marked])
        need.update({y for _, y in marked} - cache.keys())
        plain, accented, words, others = [], [], [], []
        for x in need:
            if x.isascii():
                (plain if x.isalpha() else others).append(x)
            elif _LETTERS.fullmatch(x):
                accented.append(x)
            else:
                (words if x.isalpha() else others).append(x)
        for own, bare in ((plain, self.is_plain), (accented, self.is_plain), (words, False)):
            cache.update(zip(own, self.letters(own, bare), strict=True))
        rest = {x: self.spelled(x) for x in others}
        own = [x for x, y in rest.items() if y is not None]
        cache.update(dict.fromkeys(rest))
        cache.update(zip(own, self.direct(rest[x] for x in own), strict=True))
        for x, y in marked:
            cache[x] = cache[y] + runs[x[len(y) :]]
        return new

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(x) for x in texts]
        if len(self.cache) > self.most:
            self.old, self.cache, self.runs = self.cache, {}, {}
        new = self.learn(set().union(*cut))
        get, out, whole = self.cache.__getitem__, [], []
        for i, x in enumerate(cut):
            try:
                out.append(b"".join(map(get, x)))
            except TypeError:  # a unit without ids of its own
                out.append(b"")
                whole.append(i)
        for i, found in zip(whole, self.direct(texts[i] for i in whole), strict=True):
            out[i] = found
        for x in new:
            if len(x) > UNIT_CHARS:
                self.cache.pop(x, None)
        return out


class WordEncoder(Encoder):
    """For vocabularies that drop white space and case: every word is a unit."""

    last_mark = "</w>"

    def shown(self, text: str) -> str:
        return super().shown(text.lower())

    def cut(self, text: str) -> list[str]:
        """Words, in lower case already where that can't change what else is done."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return word_units(text.lower())
            except UnicodeEncodeError:
                pass
        return word_units(text)

    def spelled(self, key: str) -> str:
        return key


class ByteEncoder(Encoder):
    """For byte-level vocabularies that attach one space to the next word.

    A single space, or a single line end, between two other characters that
    aren't white space is where a pattern match begins, whatever stands before.
    A unit is such a space (left out of its key) or line end with what follows
    it; the key of a text's first unit begins with a zero character. A text
    with other runs of white space, or with the start of a special token, stays
    whole.
    """

    #: Words with and without a space, a mark or a line end before them are apart
    #: here, so more of them recur.
    most = 700_000
    first_mark = "\u0120"

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts if text.find("\0") < 0 else [""]

    def spelled(self, key: str) -> str | None:
        if not key or key[-1].isspace() or "<|" in key or "\u180e" in key:
            return None
        if key[0] == "\0":
            return key[1:] if len(key) > 1 and not key[1].isspace() else None
        if key[0] == "\n":
            return None if key[1].isspace() else key
        return None if key[0].isspace() else " " + key


def collect_less() -> None:
    """Let a worker with large caches, which hold no cycles, look for cycles less often."""
    gc.set_threshold(200_000, 20, 100)


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """The worker process's encoder; it and its cache outlive a task."""
    key = (kind.__name__, path)
    if key not in _KEPT:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        collect_less()
        _KEPT[key] = kind(path)
    return _KEPT[key]
