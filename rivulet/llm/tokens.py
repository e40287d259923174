"""Exact ids of the ``word_bpe_49k.json`` tokenizer, fast.

That vocabulary drops white space and never merges across it, so the ids of a
text are the ids of its white-space-separated chunks in a row.  Chunks repeat
far more often than texts do: each worker keeps the ids of the chunks it has
met twice (up to ``MEMORY`` of them) and works out only the others.

Splitting is done on Latin-1 bytes, where the tokenizer's normaliser (NFC,
white space, lower case) is a byte table, ``_SLICE`` bytes at a time.  A run of
letters is one word of the vocabulary's model, which is asked directly.  Any
text with other characters, or with the literal form of a special token, goes
to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Chunks that a worker remembers; about 200 bytes each.
MEMORY = 300_000
#: Bytes of text split into chunks at once.
_SLICE = 1 << 20
#: Places that note, by hash, which chunks a worker has met once.
_MET = 1 << 22

# white space and separators to a space, capitals to small letters
_TABLE = bytes(
    0x20 if c in (0x85, 0xA0) or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 or (0xC0 <= c <= 0xDE and c != 0xD7) else c
    for c in range(256)
)
_LETTERS = bytes(c for c in range(256) if chr(c).isalpha())
_TAIL = bytes(c for c in range(33, 256) if not chr(c).isalpha() and not chr(c).isnumeric() and c not in (0x27, 0x85, 0xA0))
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_READY: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class WordIds:
    """Ids of texts as little-endian bytes: ``kind`` is two bytes an id where the vocabulary allows it, else four."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.known: dict[bytes, bytes] = {}
        self.met = bytearray(_MET)
        self.kind = "<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4"
        self.size = int(self.kind[-1])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, letters: bytes) -> bytes:
        """Ids of one run of small letters."""
        shown = letters.decode("latin-1")
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(_BYTE_LETTERS)
        size = self.size
        return b"".join([t.id.to_bytes(size, "little") for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk that is not remembered.  Punctuation at its end is a piece of its own unless an
        apostrophe is in it."""
        stem = chunk.rstrip(_TAIL)
        if stem.translate(None, _LETTERS):
            ids = self.whole(chunk.decode("latin-1"))
        else:
            ids = b"" if not stem else self.known.get(stem) or self._word(stem)
            if tail := chunk[len(stem) :]:
                ids += self.known.get(tail) or self._remember(tail, self.whole(tail.decode("latin-1")))
        return self._remember(chunk, ids)

    def _remember(self, chunk: bytes, ids: bytes) -> bytes:
        place = hash(chunk) & (_MET - 1)
        if not self.met[place]:
            self.met[place] = 1
        elif len(self.known) < MEMORY:
            self.known[chunk] = ids
        return ids

    def _split(self, raw: bytes) -> Iterator[list[bytes]]:
        """Chunks of a normalised text, a slice that ends at a space at a time."""
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > _SLICE:
                end = raw.rfind(b" ", at, at + _SLICE) + 1 or raw.find(b" ", at + _SLICE) + 1 or len(raw)
            yield raw[at:end].split()
            at = end

    def one(self, text: str | None) -> bytes:
        """The ids of a text; a null text counts as empty."""
        text = text or ""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text.encode("utf-8", "replace").decode("utf-8"))
        if b"<|" in raw and any(s in text for s in _SPECIAL):
            return self.whole(text)
        get, parts = self.known.get, []
        for chunks in self._split(raw.translate(_TABLE)):
            found, at = list(map(get, chunks)), -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self._chunk(chunks[at])
            parts.append(b"".join(found))
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        return list(map(self.one, texts))


def wide(ids: bytes, kind: str) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return ids if kind == "<u4" else np.frombuffer(ids, kind).astype("<u4").tobytes()


def word_ids(path: str) -> WordIds:
    """The worker's one instance for this vocabulary file."""
    if path not in _READY:
        _READY[path] = WordIds(path)
    return _READY[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file; a parameter of every operator that tokenises."""
    import public_tokenizers

    return public_tokenizers.path(name)
