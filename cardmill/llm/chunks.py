"""Token ids of whole texts out of a table of chunks that were encoded before, in array operations.

Texts are cut, as bytes, where no token of the tokenizer can reach across. A chunk of at
most 23 bytes is three 64-bit words (the last byte holds its length), so that it is found
in an open-addressing table without a Python object for it; longer ones are found by a
dictionary. What a batch brings anew is encoded once, and the ids of the texts are one
gather. A full table is emptied, so memory does not grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex

from .arrow import ragged

#: White space of the pattern as the Unicode property has it, whatever the engine's own class holds.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Bytes of a chunk that the table can hold, and of one that is remembered at all.
SHORT, LONG = 23, 256
#: Places of the table (a power of two) and chunks after which it is emptied.
PLACES, CHUNKS = 1 << 20, 1 << 19

#: True where a chunk starts, for all bytes of the texts that start at the given places.
Cut = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Flat ids and the number of ids of each chunk.
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with its white-space classes spelled out."""
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")
    spelled = spelled.replace(r"(?!\S)", rf"(?![^{WHITE}])").replace(r"\s+", f"[{WHITE}]+")
    return regex.compile(spelled)


class Growing:
    """An array that is appended to."""

    def __init__(self, kind: type, size: int = 1 << 16):
        self.data, self.size = np.zeros(size, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.data[self.size : end] = values
        self.size = end


class Chunks:
    def __init__(self, cut: Cut, encode: Encode, places: int = PLACES, limit: int = CHUNKS):
        self.cut, self.encode, self.limit = cut, encode, limit
        self.shift = np.uint64(64 - (places.bit_length() - 1))
        self.words = np.zeros((3, places), np.uint64)
        self.entry = np.zeros(places, np.int32)
        self._empty()

    def _empty(self) -> None:
        self.entry.fill(-1)
        self.long: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int32)

    def _first(self, words: np.ndarray) -> np.ndarray:
        mixed = words[0] * _ODD[0] + words[1] * _ODD[1] + words[2] * _ODD[2]
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _ODD[3]) >> self.shift).astype(np.int64)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 for one that is new."""
        last = len(self.entry) - 1
        at = self._first(words)
        found = self.entry[at]
        off = np.flatnonzero((found >= 0) & ~self._same(words, at))
        at, left = at[off], words[:, off]
        while len(off):
            at = (at + 1) & last
            found[off] = self.entry[at]
            on = (found[off] >= 0) & ~self._same(left, at)
            off, at, left = off[on], at[on], left[:, on]
        return found

    def _same(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.words[0][at] == words[0]) & (self.words[1][at] == words[1]) & (self.words[2][at] == words[2])

    def _insert(self, words: np.ndarray, entries: np.ndarray) -> None:
        """Chunks that differ from each other and from those in the table."""
        last = len(self.entry) - 1
        at = self._first(words)
        while len(at):
            free = self.entry[at] < 0
            self.entry[at[free]] = entries[free]
            # Of several for one place the last one has it.
            got = self.entry[at] == entries
            self.words[:, at[got]] = words[:, got]
            at, words, entries = (at[~got] + 1) & last, words[:, ~got], entries[~got]

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        ids, lengths = self.encode(chunks)
        entry, start = self.starts.size, self.ids.size
        self.starts.extend(start + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.ids.extend(ids)
        return np.arange(entry, entry + len(chunks), dtype=np.int32)

    def _entries(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        padded = np.concatenate([flat, np.zeros(32, np.uint8)])
        at_any = np.ndarray((len(flat) + 24,), "<u8", padded, strides=(1,))
        short = sizes <= SHORT
        begin, size = starts[short], sizes[short]
        words = np.empty((3, len(begin)), np.uint64)
        for k in range(3):
            words[k] = at_any[begin + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)]
        words[2] |= size.astype(np.uint64) << np.uint64(56)
        found = self._find(words)
        new = np.flatnonzero(found < 0)
        if len(new):
            data = flat.tobytes()
            own = [data[a:b] for a, b in zip(begin[new].tolist(), (begin[new] + size[new]).tolist(), strict=True)]
            fresh = {chunk: k for k, chunk in enumerate(dict.fromkeys(own))}
            entries = self._learn(list(fresh))
            which = np.fromiter(map(fresh.__getitem__, own), np.int64, len(own))
            found[new] = entries[which]
            first = np.empty(len(fresh), np.int64)
            first[which[::-1]] = new[::-1]
            self._insert(words[:, first], entries)
        entries = np.empty(len(starts), np.int64)
        entries[short] = found
        rest = np.flatnonzero(~short)
        if len(rest):
            own = [flat[a : a + n].tobytes() for a, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
            fresh = [chunk for chunk in dict.fromkeys(own) if chunk not in self.long]
            known = dict(zip(fresh, self._learn(fresh).tolist(), strict=True)) if fresh else {}
            self.long.update((chunk, entry) for chunk, entry in known.items() if len(chunk) <= LONG)
            entries[rest] = [known[chunk] if chunk in known else self.long[chunk] for chunk in own]
        return entries

    def encode_all(self, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts.

        ``flat`` has the bytes of the texts, ``edges`` where each starts and the last one ends.
        """
        if self.starts.size > self.limit:
            self._empty()
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        mark = self.cut(flat, edges)
        mark[edges[:-1][edges[:-1] < len(flat)]] = True
        starts = np.flatnonzero(mark)
        entries = self._entries(flat, starts, np.diff(starts, append=len(flat)))
        lengths = self.lengths.data[entries].astype(np.int64)
        ids = self.ids.data[ragged(self.starts.data[entries], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, edges)]


ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Kinds of bytes that the pattern never puts into one match: letters, digits, marks.
#: 0 is any other; the apostrophe is one, as it may start a match with letters.
_KINDS = np.zeros(256, np.uint8)
for _byte in range(33, 127):
    _KINDS[_byte] = 1 if chr(_byte).isalpha() else 2 if chr(_byte).isdigit() else 3 if _byte != 39 else 0


def _white_after(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII starts at a place; each has the three bytes that it takes to tell."""
    a, b, c = flat[at], flat[at + 1], flat[at + 2]
    return (
        ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )


def cut_words(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pattern of byte-level BPE surely ends a match.

    White space leaves its last character to what follows: a space joins it, any other
    character stands alone. So there is an edge before the last white space of a run, and
    one behind it unless it is a space. White space at the end of a text is one match.
    Letters (ASCII and U+00C0 to U+00FF), digits and marks follow each other in matches
    of their own.
    """
    kinds = _KINDS[flat]
    # Two bytes of a letter from U+00C0 on, but for the signs U+00D7 and U+00F7.
    lead = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] != 0x97) & (flat[1:] != 0xB7))
    kinds[lead] = kinds[lead + 1] = 1
    mark = np.zeros(len(flat) + 1, bool)
    mark[1:-1] = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
    last = edges[1:] - 1
    ends = np.zeros(len(flat), bool)
    ends[last[last >= 0]] = True
    white = ASCII_WHITE[flat]
    at = np.flatnonzero(white[:-1] & ~white[1:] & ~ends[:-1])
    high = np.flatnonzero(flat[at + 1] >= 0xC2)
    if len(high):
        padded = np.concatenate([flat[: len(flat)], np.zeros(3, np.uint8)])
        at = np.delete(at, high[_white_after(padded, at[high] + 1)])
    mark[at] = True
    mark[at[flat[at] != 32] + 1] = True
    return mark[:-1]


def _byte_names() -> list[str]:
    """Byte-level models name bytes by characters: the visible ones by themselves, the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(byte) if byte in seen else chr(next(other)) for byte in range(256)]


_POOLS: dict[tuple[str, str], Chunks] = {}


def byte_bpe(path: str, pattern: str = public_tokenizers.PATTERN) -> Chunks:
    """A byte-level BPE of the tokenizers library without a normaliser, one table per Python worker."""
    if (path, pattern) not in _POOLS:
        from tokenizers import Tokenizer

        model, names = Tokenizer.from_file(path).model, _byte_names()
        split: regex.Pattern = splitter(pattern)
        blank = names[32]

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids: list[int] = []
            lengths = np.empty(len(chunks), np.int64)
            for k, chunk in enumerate(chunks):
                before = len(ids)
                # Most new chunks are a space and ASCII letters: one match, only the space has another name.
                if chunk[:1] == b" " and chunk.isascii() and chunk[1:].isalpha():
                    ids += [token.id for token in model.tokenize(blank + chunk[1:].decode())]
                else:
                    for match in split.findall(chunk.decode("utf-8", "replace")):
                        ids += [token.id for token in model.tokenize(match.encode().decode("latin-1").translate(names))]
                lengths[k] = len(ids) - before
            return np.array(ids, np.uint32), lengths

        _POOLS[path, pattern] = Chunks(cut_words, encode)
    return _POOLS[path, pattern]


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE of the tokenizers library."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    values = {name: byte for byte, name in enumerate(_byte_names())}
    tokens = [b""] * whole.get_vocab_size(with_added_tokens=True)
    for name, token in whole.get_vocab(with_added_tokens=False).items():
        if all(char in values for char in name):
            tokens[token] = bytes(values[char] for char in name)
    return tokens


#: An id that no tokenizer has: the pieces of a chunk do not give its bytes back.
CHANGED = 0xFFFFFFFF


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece model: U+2581 is a space, ``<0xHH>`` a byte, control ids have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for token in range(model.get_piece_size()):
        name = model.id_to_piece(token)
        if model.is_byte(token):
            tokens.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(token) or model.is_unknown(token):
            tokens.append(b"")
        else:
            tokens.append(name.replace("▁", " ").encode())
    return tokens


def sentence_pieces(path: str) -> Chunks:
    """A SentencePiece BPE that changes no text but for the space before it, one table per Python worker.

    Texts come with that space. Merges only make pieces of the vocabulary, so two bytes that
    no piece has side by side are never joined, and texts are cut between them.
    """
    if (path, "") not in _POOLS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = piece_tokens(path)
        joined = np.zeros((256, 256), bool)
        # Bytes of one character stay together.
        joined[:, 0x80:0xC0] = True
        for token in tokens:
            own = np.frombuffer(token, np.uint8)
            joined[own[:-1], own[1:]] = True
        # A character that is joined with nothing stands before a chunk, in place of its context.
        alone = [byte for byte in range(1, 128) if not joined[byte, :0x80].any() and not joined[:, byte].any()]
        if not alone:
            raise ValueError(f"every character of {path} is part of longer pieces")
        before = chr(alone[0])
        skipped = len(model.encode(before))

        def cut(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
            mark = np.ones(len(flat), bool)
            mark[1:] = ~joined[flat[:-1], flat[1:]]
            return mark

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, lengths = [], np.empty(len(chunks), np.int64)
            found = model.encode([before + chunk.decode("utf-8", "replace") for chunk in chunks], num_threads=1)
            for k, (chunk, own) in enumerate(zip(chunks, found, strict=True)):
                own = own[skipped:]
                if b"".join(map(tokens.__getitem__, own)) != chunk:
                    own = [CHANGED]
                ids += own
                lengths[k] = len(own)
            return np.array(ids, np.uint32), lengths

        _POOLS[path, ""] = Chunks(cut, encode)
    return _POOLS[path, ""]
