"""Encoding texts with a public tokenizer, each distinct word only once per cache.

The two vocabularies cut a text at the spaces between words before anything else, so the
ids of a text are the ids of its space-separated units put together.  Units repeat far more
often than texts do; their ids are kept in a bounded cache and only new units reach the
library.  A text that cannot be cut so (odd white space, marker characters, special
strings) is encoded whole by the library.  Results equal the library's on whole texts.
"""

import json
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from foretally.llm.common import trim, worker_state

FIRST, LINE = "\x01", "\x00"  # mark a text's first unit, and a unit after a line break
CACHE_UNITS = 1_500_000  # about 250 MB in a Python worker


def units_of(text: str, spaced: bool) -> list[str]:
    """The units between spaces.  ``spaced``: the vocabulary tells a word after a space from
    one at the start of a line, so units say which they are."""
    if not text:
        return []
    if not spaced:
        return text.replace("\n", " ").split(" ")
    return (FIRST + text.replace("\n", " " + LINE)).split(" ")


def unit_text(unit: str) -> str:
    if unit[:1] == FIRST:
        return unit[1:]
    return "\n" + unit[1:] if unit[:1] == LINE else " " + unit


def is_clean(unit: str) -> bool:
    """The unit's neighbours in the text are single spaces or line breaks, nothing wider."""
    body = unit[1:] if unit[:1] in (FIRST, LINE) else unit
    return bool(body) and not (body[0].isspace() or body[-1].isspace())


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabulary files use for each byte: printable
    Latin-1 characters stand for themselves, the others for code points from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [x["content"] for x in kind.get("added_tokens", [])]
        before = kind.get("pre_tokenizer") or {}
        # white space inside the tokens: the byte-level form; dropped: the form that splits words off
        self.spaced = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = self.spaced or drops_space(before)
        self.stand_ins = byte_letters()
        self.space = self.stand_ins[ord(" ")]
        self.cache: dict[str, bytes | None] = {}
        self.tails = dict(zip("\n.,", self.whole(["\n", ".", ","])))

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def parts_of(self, unit: str) -> tuple[bool, str, str]:
        """(after a line break, stem, full stop or comma behind it): tokens never span them."""
        mark, body = (unit[:1], unit[1:]) if self.spaced and unit[:1] in (FIRST, LINE) else ("", unit)
        tail = body[-1:] if body[-1:] in (".", ",") and self.letters(body[:-1]) else ""
        stem = body[:-1] if tail else body
        return mark == LINE, FIRST + stem if mark else stem, tail

    def letters(self, body: str) -> bool:
        return body.isalpha() and (self.spaced or body.isascii() or unicodedata.normalize("NFC", body).lower().isalpha())

    def one_word(self, stem: str) -> str | None:
        """A stem of letters alone as the one pre-token it is, spelt for the library's merge
        model; the library's splitting and normalising steps would find nothing to do."""
        bare = stem[1:] if stem[:1] == FIRST else stem
        if not bare.isalpha():
            return None
        if self.spaced:
            text = bare if bare is not stem else " " + bare
        else:
            text = bare.lower()
            if not bare.isascii() and (max(bare) >= "\u0250" or len(text) != len(bare) or unicodedata.normalize("NFC", bare) != bare):
                return None
        return text.encode().decode("latin-1").translate(self.stand_ins)

    def learn(self, fresh: list[str]) -> None:
        """Ids of new units: plain words here, all others in ``learn_others``."""
        cache, tails, tokenize, others = self.cache, self.tails, self.library.model.tokenize, []
        for unit in fresh if self.cuts else ():
            stem = unit[:-1] if unit[-1:] in (".", ",") else unit
            if not stem.isalpha() or not (self.spaced or stem.isascii()):
                others.append(unit)
                continue
            ids = cache.get(stem)
            if ids is None:
                if not self.spaced:
                    word = stem.lower()
                elif stem.isascii():
                    word = self.space + stem
                else:
                    word = (" " + stem).encode().decode("latin-1").translate(self.stand_ins)
                ids = [t.id for t in tokenize(word)]
                ids = cache[stem] = struct.pack(f"<{len(ids)}I", *ids)
            if stem is not unit:
                cache[unit] = ids + tails[unit[-1]]
        others = others if self.cuts else fresh
        if others:
            self.learn_others(others)

    def learn_others(self, fresh: list[str]) -> None:
        """Ids of units that are no plain words, in one call; None if a unit cannot stand alone."""
        cut = {u: self.parts_of(u) for u in fresh if not self.spaced or is_clean(u)}
        stems = list({stem for _, stem, _ in cut.values() if stem not in self.cache})
        self.cache.update(dict.fromkeys(u for u in fresh if u not in cut))
        words = {s: self.one_word(s) for s in stems} if self.cuts else {}
        rest = [s for s in stems if not words.get(s)]
        tokenize = self.library.model.tokenize
        for stem, word in words.items():
            if word:
                ids = [t.id for t in tokenize(word)]
                self.cache[stem] = struct.pack(f"<{len(ids)}I", *ids)
        self.cache.update(zip(rest, self.whole([unit_text(s) if self.spaced else s for s in rest])))
        for unit, (broken, stem, tail) in cut.items():
            self.cache[unit] = (self.tails["\n"] if broken else b"") + self.cache[stem] + (self.tails[tail] if tail else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        trim(self.cache, CACHE_UNITS)
        cut, cache = [], self.cache
        for text in texts:
            plain = self.cuts and not any(s in text for s in self.specials) and FIRST not in text and LINE not in text
            cut.append(units_of(text, self.spaced) if plain else None)
        fresh = set(chain.from_iterable(units for units in cut if units)).difference(cache)
        if fresh:
            self.learn(list(fresh))
        out: list[bytes | None] = []
        for units in cut:
            try:
                out.append(None if units is None else b"".join(map(cache.__getitem__, units)))
            except TypeError:  # a unit that cannot stand alone
                out.append(None)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out


def drops_space(before: dict) -> bool:
    """The pre-tokenizer keeps only matches of a pattern that never holds white space."""
    steps = before.get("pretokenizers", [before])
    first = steps[0] if steps else {}
    return (first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed"
            and "[^\\s\\p{L}\\p{N}]+" in first.get("pattern", {}).get("Regex", "")
            and not any(s.get("add_prefix_space") for s in steps))


def quiet_library() -> None:
    """One core per task: the library must not start threads of its own."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encoded(path: str, texts: Iterator[list[str]]) -> Iterator[bytes]:
    quiet_library()
    encoder = worker_state(("encoder", path), lambda: Encoder(path))
    for part in texts:
        yield from encoder.encode(part)
