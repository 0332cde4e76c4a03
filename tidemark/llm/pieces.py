"""Encoding of whole texts through a cache of white-space-free chunks.

The BPE vocabularies used here never merge across pre-tokens, so the ids of a text are the ids of its pre-tokens one after
the other.  A text is cut at spaces and ahead of marks; most chunks are a pre-token then.  A worker keeps the ids of the
chunks that it has met; only pre-tokens that it has not met go to the tokenizers library.
Where the split by chunks is not provably the library's (characters from U+0180 on), a counting byte-level encoder cuts a text
at single spaces, where a pre-token always begins, and asks the library's own splitter for each stretch that it has not met;
pre-tokens are looked up all the same.  So a curly quote costs its own stretch, and Cyrillic or Greek words are met again like
others.  Texts with special strings, and such texts in other encoders, go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable

import numpy as np

#: Code points below this are split here; texts with others are encoded whole by the library.
SAFE_BELOW = 0x180
#: Entries of a generation of a worker's cache; two generations are alive at most.
CACHE_ENTRIES = 300_000

# White space below U+0180 as the vocabularies' patterns mean it, and their contractions.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _of_category(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SAFE_BELOW) if unicodedata.category(chr(c))[0] == first)


LETTERS, NUMBERS = _of_category("L"), _of_category("N")
WORD_PATTERN = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
BYTE_PATTERN = re.compile(
    f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The byte level's letter of each byte: itself where it is printed, else the next free one from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {c: 256 + i for i, c in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
#: Marks before which a pre-token ends where a letter or a number precedes them.
MARKS = (b".", b",", b";", b":", b"!", b"?")
#: Bytes by what they are to that rule: mark, space, letter or number, other.
_KINDS = bytes(ord("m") if bytes([c]) in MARKS else 32 if c == 32 else ord("a") if bytes([c]).isalnum() or c >= 128 else ord("o") for c in range(256))
#: A space that does not begin a pre-token: more white space, or the end, follows it.
LOOSE_SPACE = re.compile(rb" (?:[\x09-\x0d\x20]|\xc2[\x85\xa0]|\Z)")
#: A space at which a pre-token begins, whatever the characters: none of its neighbours is white space.
JOINING_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A stretch between spaces with a character that is not split here, and white space among such characters.
ODD_STRETCH = re.compile(f"[^ ]*[\\u{SAFE_BELOW:04x}-\U0010ffff][^ ]*")
ODD_SPACE = re.compile("[\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Characters of a stretch between such spaces that is kept; longer ones (text without spaces) are looked up by pre-tokens alone.
LONGEST_KEPT = 48
#: Begins a chunk that has no space ahead of it, where spaces are part of pre-tokens.
JOINT = b"\0"


def marks_apart(raw: bytes, joint: bytes) -> bytes:
    """``raw``, text below U+0180, with a space and ``joint`` ahead of each mark; unchanged where a mark may follow something
    other than a letter or a number."""
    kinds = raw.translate(_KINDS)
    if b"mm" in kinds or b"om" in kinds or b" m" in kinds or kinds[:1] == b"m" or joint and joint in raw:
        return raw
    if b"\xc2" in raw or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:  # the characters from U+0080 on that are neither
        return raw
    for mark in MARKS:
        raw = raw.replace(mark, b" " + joint + mark)
    return raw


class Generations(dict):
    """A cache with two generations: what was used since the last turn-over survives the next one.  ``fixed`` entries stay."""

    def __init__(self, compute: Callable, entries: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.old, self.misses = compute, fixed or {}, {}, 0
        self.entries = entries + len(self.fixed)

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
            self.misses += 1
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[key] = value
        return value


class TextEncoder:
    """Ids (or only their number) of whole texts.

    tokenizer_json: the content of a ``tokenizers`` file.  ``kind`` is ``word`` (lower case, white space dropped, word
    ends) or ``byte`` (byte level, the space belongs to the next word); for any other layout each text goes to the library.
    hot: numbers of ids of frequent pre-tokens (in UTF-8), which the caches hold from the start on (counting only).
    """

    def __init__(self, tokenizer_json: str, counting: bool = False, hot: dict | None = None, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.counting = counting
        self._code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = layout(json.loads(tokenizer_json))
        self.special = sorted(str(t.content) for t in self.library.get_added_tokens_decoder().values())
        self._space = "Ġ" if self.kind == "byte" else ""
        self._tokenize = self.library.model.tokenize
        self.tokens = Generations(self._token, entries, {p.decode(): n for p, n in (hot or {}).items()})
        self.chunks = Generations(self._chunk, entries, {self._as_chunk(p): n for p, n in (hot or {}).items() if p.split() == [p.strip()]})
        self.wide = counting and self.kind == "byte"
        self.letters = Generations(self._looked_up, entries, {p.decode("latin-1").translate(BYTE_LEVEL): n for p, n in (hot or {}).items()} if self.wide else None)
        self.stretches = Generations(self._stretch, entries)

    def _as_chunk(self, token: bytes) -> bytes:
        """The chunk that a pre-token is where it stands alone."""
        if self.kind == "byte":
            return token[1:] if token.startswith(b" ") else JOINT + token
        return token

    def _token(self, token: str):
        return self._looked_up(token if token.isascii() and token.isalnum() else token.encode().decode("latin-1").translate(BYTE_LEVEL))

    def _looked_up(self, token: str):
        """What the library says of a pre-token in the byte level's letters."""
        found = self._tokenize(token)
        return len(found) if self.counting else array(self._code, [t.id for t in found]).tobytes()

    def _stretch(self, text: str):
        """Of what follows a joining space, by the library's own splitter."""
        return self._by_letters(" " + text)

    def _by_letters(self, text: str):
        return self._joined(self.letters[letters] for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def _of_any(self, text: str):
        """Of a text of any characters: odd stretches one by one, what is between them as other texts are."""
        raw = text.encode()
        if LOOSE_SPACE.search(raw) is None and JOINT not in raw and "İ" not in text and ODD_SPACE.search(text) is None:
            out, at = [], 0
            for found in ODD_STRETCH.finditer(text):
                a, b = found.span()
                if a - 1 > at:  # up to the space that belongs to the stretch
                    out.append(self._spaced(text[at : a - 1].encode()))
                part = found[0]
                out.append(self.stretches[part] if a and len(part) <= LONGEST_KEPT else self._by_letters(" " * bool(a) + part))
                at = b
            return self._joined([*out, self._spaced(text[at:].encode())] if at < len(text) else out)
        first, *rest = JOINING_SPACE.split(text)
        kept = self.stretches
        return self._joined([self._by_letters(first), *(kept[part] if len(part) <= LONGEST_KEPT else self._by_letters(" " + part) for part in rest)])

    def _joined(self, parts):
        return sum(parts) if self.counting else b"".join(parts)

    def _chunk(self, chunk: bytes):
        """Of what stands between two spaces; for ``byte`` the first of them belongs to it unless ``JOINT`` takes its place."""
        if chunk.isalpha():  # ASCII letters are one pre-token
            return self._looked_up(self._space + chunk.decode())
        text = chunk.decode()
        if text.isalpha():
            return self._looked_up(self._space + chunk.decode("latin-1").translate(BYTE_LEVEL))
        if self.kind == "byte":
            text = text[1:] if chunk[:1] == JOINT else " " + text
        found = (WORD_PATTERN if self.kind == "word" else BYTE_PATTERN).findall(text)
        return self._joined(map(self.tokens.__getitem__, found))

    def _spaced(self, raw: bytes):
        """Of a byte-level text all of whose spaces begin pre-tokens."""
        first, *rest = marks_apart(raw, JOINT).split(b" ")
        parts = list(map(self.tokens.__getitem__, BYTE_PATTERN.findall(first.decode())))
        parts += map(self.chunks.__getitem__, rest)
        return self._joined(parts)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; none where its pre-tokens are the library's alone to tell."""
        if not text or not self.kind or any(x in text for x in self.special):
            return []
        if not self._plain(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if self.wide else []
        return WORD_PATTERN.findall(text.lower()) if self.kind == "word" else BYTE_PATTERN.findall(text)

    def _plain(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if text.isascii():
            return True
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        return bool(units.max() < SAFE_BELOW) and "İ" not in text

    def __call__(self, text: str | None):
        """The packed ids, little-endian in ``self.dtype``; their number if ``counting``.  Null is as the empty text."""
        if not text:
            return 0 if self.counting else b""
        if self.kind and self._plain(text):
            if self.kind == "word":
                return self._joined(map(self.chunks.__getitem__, marks_apart(text.lower().encode(), b"").split()))
            raw = text.encode()
            if LOOSE_SPACE.search(raw) is None and JOINT not in raw:
                return self._spaced(raw)
            return self._joined(map(self.tokens.__getitem__, BYTE_PATTERN.findall(text)))
        if self.wide and not any(x in text for x in self.special):
            return self._of_any(text)
        ids = self.library.encode(text, add_special_tokens=False).ids
        return len(ids) if self.counting else array(self._code, ids).tobytes()


_HELD: dict[tuple, TextEncoder] = {}


def encoder(tokenizer_json: str, counting: bool = False, hot: list[tuple[bytes, int]] | None = None) -> TextEncoder:
    """This worker's encoder, kept from task to task with what it has met; one is held at a time."""
    name = (zlib.crc32(tokenizer_json.encode()), len(tokenizer_json), counting)
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = TextEncoder(tokenizer_json, counting, dict(hot or ()))
    return _HELD[name]


def layout(spec: dict) -> str | None:
    """``word``, ``byte`` or None for a tokenizer file's normalizer, splits and model."""
    model, before, normal = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")):
        return None
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens") or []):
        return None
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "byte" if not model.get("end_of_word_suffix") else None
    steps, parts = (normal or {}).get("normalizers", []), before.get("pretokenizers", [])
    # Text below U+0180 without joining marks is in NFC as it is.
    if steps != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}] or len(parts) != 2:
        return None
    split = {"type": "Split", "pattern": {"Regex": CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    if parts[0] == split and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space"):
        return "word"
    return None


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file, to be sent to the workers (its size does not depend on the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
