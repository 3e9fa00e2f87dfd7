"""Byte-pair encoding as a lazily determinised transducer, and decoding as a UTF-8 state machine.

The encoding of a string is the only sequence of vocabulary tokens in which every neighbouring pair
stays as it is when the pair's bytes are encoded alone. So for each prefix the last token is fixed, and
whether a token may follow depends on its left neighbour only. A state holds the token before the
undecided bytes and these bytes themselves; a byte leads to a new state and emits the tokens that all
continuations agree upon. States and transitions are made when first met and kept; the vocabulary's
longest token bounds the lookahead.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import regex

#: Transitions kept by a transducer before it starts afresh.
MAX_TRANSITIONS = 400_000
MAX_WORDS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a file of base64 tokens and ids; ids follow the order of the merges."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes byte strings; `step` and `finish` are the transducer, `encode` runs it over a string."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Proper prefixes of tokens: what may still grow into a longer one.
        self.growing = {t[:i] for t in ranks for i in range(1, len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.moves: dict[tuple[int, bytes, int], tuple[int, bytes, tuple[int, ...]]] = {}
        self.ends: dict[tuple[int, bytes], tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def merged(self, text: bytes) -> list[int]:
        """The encoding by its definition: always merge the leftmost pair of the lowest rank."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    at, best = i, rank
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` may come directly after `left` (-1: the beginning)."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if left < 0:
                known = self.merged(self.bytes_of[right]) == [right]
            else:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.fits) >= MAX_TRANSITIONS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _last_tokens(self, left: int, text: bytes) -> list[tuple[int, int] | None]:
        """For each prefix of text after `left`: its last token and where that begins; None at 0."""
        last: list[tuple[int, int] | None] = [None]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(text[start:end])
                if token is None:
                    continue
                before = left if start == 0 else last[start][0] if last[start] else None
                if before is not None and self.follows(before, token):
                    last.append((token, start))
                    break
            else:
                last.append(None)
        return last

    @staticmethod
    def _path(last: list, end: int) -> list[tuple[int, int]]:
        """(token, end) along the encoding of the prefix of that length."""
        out = []
        while end > 0:
            token, start = last[end]
            out.append((token, end))
            end = start
        return out[::-1]

    def step(self, left: int, pending: bytes, byte: int) -> tuple[int, bytes, tuple[int, ...]]:
        """The next state and the tokens emitted on reading a byte."""
        text = pending + bytes((byte,))
        last = self._last_tokens(left, text)
        # A token still open may begin at any prefix whose rest is the beginning of a longer token.
        live = [q for q in range(len(text) + 1) if (q == 0 or last[q]) and (q == len(text) or text[q:] in self.growing)]
        paths = [self._path(last, q) for q in live]
        sure = 0
        while all(len(p) > sure for p in paths) and len({p[sure] for p in paths}) == 1:
            sure += 1
        if not sure:
            return left, text, ()
        emitted = paths[0][:sure]
        return emitted[-1][0], text[emitted[-1][1] :], tuple(t for t, _ in emitted)

    def finish(self, left: int, pending: bytes) -> tuple[int, ...]:
        """The tokens of the undecided bytes at the end of the input."""
        return tuple(t for t, _ in self._path(self._last_tokens(left, pending), len(pending)))

    def run(self, text: bytes) -> tuple[int, ...]:
        left, pending, out = -1, b"", []
        moves = self.moves
        for byte in text:
            move = moves.get((left, pending, byte))
            if move is None:
                if len(moves) >= MAX_TRANSITIONS:
                    moves.clear()
                move = moves[left, pending, byte] = self.step(left, pending, byte)
            left, pending, emitted = move
            if emitted:
                out += emitted
        end = self.ends.get((left, pending))
        if end is None:
            if len(self.ends) >= MAX_TRANSITIONS:
                self.ends.clear()
            end = self.ends[left, pending] = self.finish(left, pending)
        return (*out, *end)

    def encode(self, text: bytes) -> tuple[int, ...]:
        known = self.words.get(text)
        if known is None:
            known = self.run(text)
            if len(text) <= 64:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[text] = known
        return known


class Tokenizer:
    """A byte-level tokenizer: the pattern cuts a text into words, the transducer encodes each."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, none for null or empty; text that looks like a special token is plain text."""
        out: list[int] = []
        if text:
            encode = self.transducer.encode
            for m in self.pattern.finditer(text):
                out += encode(m[0].encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        machine, of = Utf8(), self.transducer.bytes_of
        return "".join([machine.feed(of[i]) for i in ids]) + machine.end()


class Utf8:
    """Incremental UTF-8 decoding: a state of bytes still missing and the code point so far.

    Bytes may be fed in any cuts; a broken sequence gives one replacement character.
    """

    def __init__(self):
        self.missing, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.missing and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.point, self.missing, self.low, self.high = self.point << 6 | b & 0x3F, self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.missing, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                # Neither overlong forms nor surrogates.
                self.missing, self.point, self.low, self.high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.missing, self.point, self.low, self.high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What is left of an unfinished sequence."""
        left, self.missing = ("�" if self.missing else ""), 0
        return left


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str | None = None) -> Tokenizer:
    """A public byte-level tokenizer, made once in each worker. folder: where the vocabulary files lie."""
    import public_tokenizers

    path = os.path.join(folder, f"{name}.tiktoken") if folder else public_tokenizers.path(f"{name}.tiktoken")
    return Tokenizer(path, public_tokenizers.PATTERN)
