"""Units of text for a lower-casing BPE vocabulary with word ends.

A text is cut into *units* whose encodings, one after another, are the text's:
the words of the vocabulary's own pre-tokenizer over normalised text, in every
script (for Latin text by a pattern, else by the library), and, marked by a
leading NUL, special strings and the stretches whose words would change if they
were normalised or cut once more.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import compress
from operator import is_

import numpy as np

from millrace.llm.token_counts import tokenizer

#: Characters whose normal form, case and class are beyond doubt: ASCII without
#: controls, Latin-1 without its spaces, general punctuation, the euro sign.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ‐-‧€]*")
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's pre-tokenizer, over lower-cased plain characters.
#: Letters come first here, as nothing else begins with one.
_WORD = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^ \t\n\r{_LETTER}{_DIGIT}]+")
_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Rules:
    """How a vocabulary cuts texts: its own special strings, normaliser and pre-tokenizer."""

    _kept: dict[str, Rules] = {}

    def __init__(self, path: str):
        t = tokenizer(path)
        self.normal = t.normalizer.normalize_str if t.normalizer else str
        self.words = t.pre_tokenizer.pre_tokenize_str
        #: Strings that are taken out of a text before all else, the longest first.
        self.special = tuple(sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Only strings that stand for themselves wherever they occur can be cut out here.
        self.simple = not any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in t.get_added_tokens_decoder().values())

    @classmethod
    def of(cls, path: str) -> Rules:
        """The worker's rules for a vocabulary."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def units(self, text: str) -> list[str]:
        """The units of a text, in order."""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return _WORD.findall(text.lower())
        out: list[str] = []
        for part in _CUT.split(text):
            if any(s in part for s in self.special):
                if not self.simple:
                    out.append("\0" + part)
                    continue
                for piece in self.cut.split(part):
                    out += ["\0" + piece] if piece in self.special else self._any(piece)
            else:
                out += self._any(part)
        return out

    def _any(self, text: str) -> list[str]:
        """Units by the library's own steps, whatever the script; a whole stretch where its words aren't stable under them."""
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        plain = self.normal(text)
        found = [plain[a:z] for _, (a, z) in self.words(plain)]
        distinct = list(dict.fromkeys(found))
        joined = " ".join(distinct)
        if "\0" in joined or self.normal(joined) != joined or [joined[a:z] for _, (a, z) in self.words(joined)] != distinct:
            return ["\0" + text]
        return found


_ends: dict[str, np.ndarray] = {}


def _word_ends(path: str) -> np.ndarray:
    """For each id, whether its piece ends a word."""
    if path not in _ends:
        t = tokenizer(path)
        _ends[path] = np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(t.get_vocab_size())])
    return _ends[path]


def encode_units(path: str, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units on end, and the number of ids of each.

    Plain words go through the library as one text, a space apart: each of them
    ends with the only piece that ends a word, which gives the bounds back.
    """
    tok, ids = tokenizer(path), []
    counts = np.zeros(len(found), np.int64)
    a = 0
    while a < len(found):
        if found[a][:1] == "\0":
            got = np.array(tok.encode(found[a][1:], add_special_tokens=False).ids, np.uint32)
            counts[a], z = len(got), a + 1
        else:
            z = a + 1
            while z < len(found) and z - a < 20_000 and found[z][:1] != "\0":
                z += 1
            got = np.array(tok.encode_batch_fast([" ".join(found[a:z])], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(_word_ends(path)[got]) + 1
            if len(last) != z - a:
                raise ValueError("a word of the vocabulary doesn't end with a word end")
            counts[a:z] = np.diff(last, prepend=0)
        ids.append(got)
        a = z
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts


#: ``x is None``, in C.
_NONE = partial(is_, None)


class CachedEncoder:
    """Text to ids with a bounded cache of units, one for each worker and vocabulary."""

    #: Units that the cache holds at most; beyond, it starts anew.
    MOST = 600_000
    _kept: dict[str, "CachedEncoder"] = {}

    def __init__(self, path: str):
        self.path, self.units, self.cache = path, Rules.of(path).units, {}
        self.kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"

    @classmethod
    def of(cls, path: str) -> "CachedEncoder":
        """The worker's encoder for a vocabulary."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, two bytes each where the vocabulary fits in that."""
        cache, kind = self.cache, self.kind
        found = [self.units(t) for t in texts]
        parts = [list(map(cache.get, f)) for f in found]
        holes = [list(compress(range(len(p)), map(_NONE, p))) for p in parts]
        missing = list({f[i] for f, own in zip(found, holes, strict=True) for i in own})
        if missing:
            ids, counts = encode_units(self.path, missing)
            raw, ends = ids.astype(kind).tobytes(), (int(kind[-1]) * np.cumsum(counts)).tolist()
            fresh = {u: raw[a:z] for u, a, z in zip(missing, [0, *ends], ends, strict=False)}
            for f, p, own in zip(found, parts, holes, strict=True):
                for i in own:
                    p[i] = fresh[f[i]]
            if len(cache) + len(fresh) > self.MOST:
                cache.clear()
            cache.update(fresh)
        return [np.frombuffer(b"".join(p), kind) for p in parts]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]
