"""Token ids of whole texts by a tokenizers file, with a bounded table of space-delimited pieces.

A byte-level BPE splits a text into pre-tokens before it merges, and no pre-token holds white space after
other characters. So a text may be cut wherever a space follows a character that is no white space, each
piece encoded on its own, and the ids joined: the same ids as for the whole text. Pieces repeat: those seen
are found by their own bytes, many at a time, and only new ones go to the library. Texts with white space on
either side of a space, or a space at the end, and tokenizers of another kind take the library's own way.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

END_ID = 0
_MARKS = ".,;:!?"
_IS_MARK, _IS_WORD = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[[ord(m) for m in _MARKS]] = True
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
#: Bytes of texts handled together, new pieces encoded as one text, slots of the table as a power of two, of
#: which six tenths are used at most, and bytes of long pieces kept: bounds on a worker's memory.
STEP_BYTES, PIECES, SLOTS, LONG_BYTES = 1 << 20, 4000, 21, 16 << 20
#: Pieces of up to this many bytes are their own key, as three words; longer ones are looked up one by one.
SHORT = 24
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Keys:
    """Short pieces by what they are: up to 24 bytes as three words, and a mark for length and opening. place is
    only where the table looks first; whether a piece is there is decided by all four."""

    def __init__(self, words: list[np.ndarray], mark: np.ndarray, place: np.ndarray | None = None):
        self.words, self.mark = words, mark
        if place is None:
            place = mark.astype(np.uint64)
            for w in words:
                place = _mixed(place ^ w)
        self.place = place

    @classmethod
    def of(cls, padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: np.ndarray) -> Keys:
        """Of padded[start : start + length], length at most 24; padded has 24 bytes more than any piece needs."""
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        words = [eight[starts + k] & _LOW_BYTES[np.clip(lengths - k, 0, 8)] for k in (0, 8, 16)]
        return cls(words, (lengths * 2 + opens + 1).astype(np.uint8))

    def __len__(self) -> int:
        return len(self.mark)

    def take(self, at: np.ndarray) -> Keys:
        return Keys([w[at] for w in self.words], self.mark[at], self.place[at])


class PieceTable:
    """Ids by key, with open addressing over arrays. A mark of 0 is an empty slot."""

    def __init__(self, bits: int = SLOTS):
        self.bits, self.most = bits, (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.words, self.mark = [np.zeros(size, np.uint64) for _ in range(3)], np.zeros(size, np.uint8)
        self.start, self.length = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 16, "<u4"), 0, 0

    def find(self, keys: Keys) -> np.ndarray:
        """The slot of each key, -1 for those that aren't there."""
        mask = np.uint64((1 << self.bits) - 1)
        slot, out = (keys.place & mask).astype(np.int64), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            mark = self.mark[at]
            hit = mark == keys.mark[todo]
            for own, there in zip(keys.words, self.words):
                hit &= there[at] == own[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (mark != 0)]
            slot[todo] = (slot[todo] + 1) & np.int64(mask)
        return out

    def add(self, keys: Keys, ids: list[bytes]) -> None:
        """Keys that aren't there yet, each once."""
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        starts = self.used + np.cumsum(lengths) - lengths
        total = self.used + int(lengths.sum())
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), "<u4")])
        self.pool[self.used : total] = np.frombuffer(b"".join(ids), "<u4")
        self.used, self.count = total, self.count + len(ids)
        mask = np.uint64((1 << self.bits) - 1)
        slot, todo = (keys.place & mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.mark[slot[todo]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[free]
            for own, there in zip(keys.words, self.words):
                there[at] = own[free]
            self.mark[at], self.start[at], self.length[at] = keys.mark[free], starts[free], lengths[free]
            left = np.ones(len(keys), bool)
            left[free] = False
            todo = todo[left[todo]]
            slot[todo] = np.where(self.mark[slot[todo]] != 0, (slot[todo] + 1) & np.int64(mask), slot[todo])


class TokenEncoder:
    """Encodes texts into little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, bits: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        kind = str(self.tokenizer.pre_tokenizer)
        line_end = self._ids("\n")
        self.cuts = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None and len(line_end) == 1
        self.line_end, self.line_end_raw = (line_end or [-1])[0], self._raw("\n")
        self.marks = {m: self._raw(m) for m in _MARKS} if self.cuts else {}
        self.table = PieceTable(bits)
        self.long: dict[str, bytes] = {}
        self.long_bytes = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return np.asarray(self._ids(text), dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [ids for run in self._runs(texts) for ids in self._encode(run)]

    @staticmethod
    def _runs(texts: list[str]) -> Iterator[list[bytes]]:
        run: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode()
            if run and size + len(raw) > STEP_BYTES:
                yield run
                run, size = [], 0
            run.append(raw)
            size += len(raw)
        if run:
            yield run

    def _encode(self, raws: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        text_starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
        before, after = np.concatenate([[32], data[:-1]]), np.concatenate([data[1:], [32]])
        # Besides spaces: a mark that ends a word of ASCII, and a line end between two visible ASCII characters.
        marks = _IS_MARK[data] & _IS_WORD[before] & ((after == 32) | (after == 10))
        lines = (data == 10) & (before > 32) & (before < 127) & (after > 32) & (after < 127)
        begins = marks | lines | np.concatenate([[False], lines[:-1]])
        opens_at = begins.copy()
        begins |= before == 32
        opens_at[text_starts[:-1]] = begins[text_starts[:-1]] = True
        starts = np.flatnonzero(begins)
        opens = opens_at[starts].astype(np.int64)
        ends = np.append(starts[1:], len(data))
        ends = np.where(data[ends - 1] == 32, np.maximum(ends - 1, starts), ends)
        if len(ends) > self.table.most // 2:
            return [self._raw(r.decode()) for r in raws]  # more pieces than the table is made for
        if self.table.count + len(ends) > self.table.most:
            self.table.clear()
        firsts = np.searchsorted(starts, text_starts)
        size = ends - starts
        short = np.flatnonzero(size <= SHORT)
        keys = Keys.of(np.concatenate([data, np.zeros(SHORT + 8, np.uint8)]), starts[short], size[short], opens[short])
        slots = self.table.find(keys)
        own_way: set[int] = set()
        missing = np.flatnonzero(slots < 0)
        piece = lambda k: (" " if opens[k] else "") + data[starts[k] : ends[k]].tobytes().decode()
        if len(missing):
            new = missing[np.unique(keys.place[missing], return_index=True)[1]]
            pieces = [piece(k) for k in short[new].tolist()]
            plain = [k for k, p in enumerate(pieces) if _may_stand_alone(p)]
            self.table.add(keys.take(new[plain]), self._learned([pieces[k] for k in plain]))
            slots[missing] = self.table.find(keys.take(missing))
            # What is left is white space that a cut would part, or two pieces of one place.
            own_way.update((np.searchsorted(firsts, short[slots < 0], side="right") - 1).tolist())
        lengths, begin = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        lengths[short] = np.where(slots < 0, 0, self.table.length[slots])
        begin[short] = self.table.start[slots]
        long = {k: piece(k) for k in np.flatnonzero(size > SHORT).tolist()}
        new_long = [p for p in dict.fromkeys(long.values()) if p not in self.long and _may_stand_alone(p)]
        if self.long_bytes + sum(map(len, new_long)) > LONG_BYTES:
            self.long, self.long_bytes = {}, 0
            new_long = [p for p in dict.fromkeys(long.values()) if _may_stand_alone(p)]
        self.long.update(zip(new_long, self._learned(new_long)))
        self.long_bytes += sum(map(len, new_long))
        for k, p in long.items():
            if p in self.long:
                lengths[k] = len(self.long[p]) // 4
            else:
                own_way.add(int(np.searchsorted(firsts, k, side="right")) - 1)
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        ids = np.take(self.table.pool, np.repeat(begin - (upto - lengths), lengths) + np.arange(total), mode="clip")
        for k, p in long.items():
            if lengths[k]:
                ids[upto[k] - lengths[k] : upto[k]] = np.frombuffer(self.long[p], "<u4")
        cut = np.concatenate([[0], upto])[firsts].tolist()
        return [self._raw(raws[k].decode()) if k in own_way else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(cut, cut[1:]))]

    def _learned(self, new: list[str]) -> list[bytes]:
        return [ids for at in range(0, len(new), PIECES) for ids in self._learn(new[at : at + PIECES])]

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of pieces, all encoded as the lines of one text. " x" stands for x at the beginning of a text or
        line, x for x after a space. Lines within a piece and a final mark are pre-tokens of their own."""
        lines: dict[str, bytes | None] = {" ": b""}
        made: list[list[tuple[str, bytes]] | bytes] = []
        for piece in new:
            if piece.isalpha():
                lines[piece] = None
                made.append([(piece, b"")])
                continue
            first, *rest = piece.split("\n")
            if rest and (not first or first[-1].isspace() or any(not r or r[0].isspace() or r[-1].isspace() for r in rest)):
                made.append(self._raw(piece[1:] if piece[0] == " " else " " + piece))
                continue
            parts = []
            for core in (first, *(" " + r for r in rest)):
                tail = b""
                if core[-1] in self.marks and len(core) > 1 and core[-2].isalnum():
                    core, tail = core[:-1], self.marks[core[-1]]
                lines.setdefault(core, None)
                parts.append((core, tail))
            made.append(parts)
        cores = [c for c, ids in lines.items() if ids is None]
        texts = [c[1:] if c[0] == " " else " " + c for c in cores]
        plain = [k for k, t in enumerate(texts) if t[1:].isalpha() and (t[0] == " " or not t[0].isspace()) or t[1:] and "\n" not in t and not t[-1].isspace() and not t[1].isspace() and (t[0] == " " or not t[0].isspace())]
        if plain:
            ids = np.asarray(self.tokenizer.encode_batch_fast(["\n".join([texts[k] for k in plain])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) + 1 == len(plain):
                raw, at = ids.tobytes(), 0
                for k, end in zip(plain, [*(ends * 4).tolist(), len(ids) * 4]):
                    lines[cores[k]] = raw[at:end]
                    at = end + 4
        for core, text in zip(cores, texts):
            if lines[core] is None:
                lines[core] = self._raw(text)
        return [parts if isinstance(parts, bytes) else self.line_end_raw.join([lines[core] + tail for core, tail in parts]) for parts in made]


def _may_stand_alone(piece: str) -> bool:
    """Whether a cut parts no white space at the piece's ends."""
    return piece in (" ", " \n") or bool(piece) and not piece[-1].isspace() and (piece[0] == " " or not piece[0].isspace())


_ENCODERS: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """One for each Python worker, so that its table outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    """The public byte-level BPE's file, by the package that knows its place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
