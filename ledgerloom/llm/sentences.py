"""Sentence spans across scripts by semi-Markov dynamic programming.

A text is cut into blocks at blank lines and into list items; these always end a sentence. Inside a
block every mark that might end a sentence gives a candidate. Dynamic programming then chooses whole
spans between candidates: a span's score adds its length, its opening words, its closing words and
whether the quotations inside it are balanced, so that a mark inside an open quotation, or one followed
by the words that attribute a quotation, loses against the longer span.
"""

from __future__ import annotations

from itertools import accumulate

import regex

from ledgerloom.llm.abbreviations import BEFORE_NUMBER, MAYBE_LAST, MONTHS, NEVER_LAST, ORDINAL_BEFORE

# Fixed values. Verbs that attribute a quotation, by their beginnings.
SAYING = regex.compile(
    r"\b(?:ask|wrote|writ|said|say|told|tell|repl|answer|shout|call(?:ed|s)|add(?:ed|s)|not(?:ed|es)\b|warn|explain|insist|claim|exclaim|whisper|demand"
    r"|schrieb|sagte|fragte|meinte|rief|antwortete|écrit|écrivit|dit\b|demand|répond|escrib|dijo|dice|pregunt|respond|escreveu|disse|pergunt"
    r"|написал|сказал|спросил|ответил)|问|說|说|写道|答|喊|言い|書き|言っ|書い|尋ね|적었|말했|물었|썼|라고|하고|लिखा|कहा|पूछा|बोला|كتب|قال|سأل",
    regex.I,
)
QUOTING_PARTICLES = ("と", "って", "という", "は", "を", "が", "の", "라고", "이라고", "하고", "고")
THAI_LAST = regex.compile(r"(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า)(?=\s)")
# Fixed values. Lower-case words that often open a sentence in chats.
CHAT_OPENERS = frozenset("btw fyi so got hey um uh ok okay nope yep yeah hmm again i will can it the my its lol well also plus hi hello pls please thanks this that they we u now imo tbh".split())

SENTENCE_MARKS = ".!?…。！？।॥؟۔｡．"
CLOSERS = "\"'”’»“›)]}」』）】〉》"
OPEN_OF = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "】": "【", "》": "《"}
OPENERS = set(OPEN_OF.values()) | {"„"}
QUOTES = set("\"“”„«»「」『』")
_BLANK_LINE = regex.compile(r"(?>\r\n|\n|\r)[^\S\r\n]*(?>\r\n|\n|\r)\s*|[ \f]\s*")
_LINE = regex.compile(r"[^\r\n]*(?>\r\n|\n|\r|$)")
_BULLET, _NUMBERED = regex.compile(r"\s*[-*•‣◦▪·]\s+\S"), regex.compile(r"\s*(?:\d{1,3}[.)]|[a-zA-Z]\))\s+\S")
_CANDIDATE = regex.compile(rf"[{SENTENCE_MARKS}]+")
_SPACE_TRIM = "\ufeff\u200b"
_HALF_DAY = regex.compile(r"\b[ap]\.\s+$")
_POINTED, _LETTER = regex.compile(r"(?:\p{L}\.)+\p{L}"), regex.compile(r"\p{L}\p{M}*")
_LETTERS, _WORD = regex.compile(r"\p{L}+"), regex.compile(r"[\p{L}']+")
_QUOTE_OR_BRACKET = regex.compile("[" + "".join(regex.escape(c) for c in sorted(QUOTES | set(OPEN_OF) | OPENERS)) + "]")
#: The clause after a quotation ends at the next quotation, pause or end of a sentence, however far.
_CLAUSE_END = regex.compile(rf"[\"“”„«»「」『』,;:，、；：،؛]|(?<![\p{{Lu}}\s]\p{{L}}?|\b\p{{Lu}}\p{{L}}{{0,2}})[{SENTENCE_MARKS}](?=\s|$)|[。！？।]")
#: Scores of a span: lost for each quote or bracket left open or stray, for each character beyond LONG, and for next to nothing.
UNBALANCED, BY_LENGTH, LONG, TINY = 7.0, 0.002, 250, 1.5
#: Lost for a boundary inside a quotation that closes: more than it can earn, 7 by its words and BY_LENGTH * LONG by length.
INSIDE = 8.0


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in _SPACE_TRIM):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in _SPACE_TRIM):
        b -= 1
    return a, b


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is_item): what blank lines and list items set apart."""
    out, at = [], 0
    pieces = []
    for m in _BLANK_LINE.finditer(text):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(text)))
    for a, b in pieces:
        a, b = _trim(text, a, b)
        if a < b:
            out += _items(text, a, b)
    return out


def _items(text: str, a: int, b: int) -> list[tuple[int, int, bool]]:
    body = text[a:b]
    if "\n" not in body and "\r" not in body:
        return [(a, b, bool(_BULLET.match(body) or _NUMBERED.match(body)) and _single_item(body))]
    lines = [(m.start() + a, m.end() + a) for m in _LINE.finditer(body) if m.end() > m.start()]
    marks = [2 if _BULLET.match(text, x, y) else 1 if _NUMBERED.match(text, x, y) else 0 for x, y in lines]
    # A number opens an item in a list that begins the block or next to another item's line; elsewhere it is wrapped text.
    item = [k == 2 or k == 1 and (i == 0 or marks[i - 1] > 0 or i + 1 < len(marks) and marks[i + 1] > 0) for i, k in enumerate(marks)]
    if item[0] and marks[0] == 1 and len(lines) > 1 and not any(item[1:]):
        item[0] = False
    out: list[tuple[int, int, bool]] = []
    for (x, y), new in zip(lines, item):
        goes_on = out and not new and (not out[-1][2] or text[x:y].lstrip()[:1].islower())
        if goes_on:
            out[-1] = (out[-1][0], y, out[-1][2])
        else:
            out.append((x, y, new))
    return out


def _single_item(body: str) -> bool:
    return bool(_BULLET.match(body)) or not _CANDIDATE.search(body[4:-1])


def _word_before(text: str, lo: int, at: int) -> str:
    """The word that ends at `at`, with inner points but no opening punctuation."""
    i = at
    while i > lo and not text[i - 1].isspace() and text[i - 1] not in "([{\"“„«「（/,;:=!?…。":
        if text[i - 1] == "." and i < at and i - 3 >= lo and text[i].isupper() and text[i - 3 : i - 1].isalnum() and not text[i - 2].isupper():
            break  # a sentence that ended without a space
        i -= 1
    return text[i:at]


def _next_char(text: str, at: int, hi: int) -> int:
    while at < hi and (text[at].isspace() or text[at] in _SPACE_TRIM):
        at += 1
    return at


def _wide(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿" or "＀" <= ch <= "￯" or "　" <= ch <= "〿"


def _closing(text: str, lo: int, a: int, b: int, end: int, nxt: int, hi: int) -> float:
    """Score of the closing words: text[a:b] are the marks, end is behind closing quotes, nxt the next visible character."""
    marks = text[a:b]
    first = text[nxt] if nxt < hi else ""
    if marks[-1] in "。！？।॥؟۔｡" or any(m in "!?" for m in marks):
        return 5.0
    if "…" in marks or len(marks) > 1:
        return 0.0 if not first or first.isupper() or first in "¿¡«“\"" else -4.0
    word = _word_before(text, lo, a)
    bare = word.rstrip("’'").lower()
    tail = bare.rsplit("-", 1)[-1].rsplit("–", 1)[-1].rsplit("'", 1)[-1].rsplit("’", 1)[-1]
    number = first.isdigit() or first in "#№$€£¥₹"
    if not bare:
        return 3.0
    if "฀" <= bare[-1] <= "๿":
        return -10.0  # Thai writes points in abbreviations only
    if tail in BEFORE_NUMBER and number:
        return -10.0
    if bare == "m" and lo < a - 3 and _HALF_DAY.search(text[max(lo, a - 9) : a - 1]) or tail in MAYBE_LAST or "." in bare and _POINTED.fullmatch(bare) and tail not in NEVER_LAST:
        if bare in ("e.g", "i.e", "z.b", "u.a", "d.h", "т.е", "p.ex"):
            return -10.0
        return 0.5
    if len(bare) < 4 and _LETTER.fullmatch(bare):
        # A single letter: an initial, or a part of an abbreviation in several words.
        before = _word_before(text, lo, _back(text, lo, a - len(word)))
        if bare in ("д", "п") and before.lower() == "т." or word.islower() and before[-1:].isdigit():
            return 0.5  # a unit after its number may be the last word
        return -8.0
    if tail == "ms" and word.islower():
        return 4.0  # milliseconds
    if tail in NEVER_LAST:
        if tail in BEFORE_NUMBER and first.isupper():
            return 1.0
        return -10.0
    if bare.endswith(("str", "pl")) and number:
        return -10.0
    if "ऀ" <= bare[-1] <= "ॿ" and len(bare) <= 3:
        return -10.0
    if bare.isdigit() and len(bare) <= 2:
        following = _LETTERS.match(text, nxt, hi)
        before = _word_before(text, lo, _back(text, lo, a - len(word))).lower()
        if following and following[0].lower() in MONTHS or before in ORDINAL_BEFORE and first.isalpha() and before != "die":
            return -10.0
        if a - len(word) <= lo:
            return -6.0  # a number that opens the block
    return 4.0


def _back(text: str, lo: int, at: int) -> int:
    while at > lo and text[at - 1].isspace():
        at -= 1
    return at


def _opening(text: str, end: int, nxt: int, hi: int, quoted: bool) -> float:
    """Score of what would open the next sentence."""
    first = text[nxt]
    gap = nxt > end
    if first.isupper() or first.istitle():
        return 2.0 if gap else 1.0
    if first in "¿¡«“„「『(（[\"‘":
        return 1.5
    if first.isdigit():
        return 0.5 if gap else -9.0
    if first.islower():
        word = _WORD.match(text, nxt, hi)[0].lower()
        if quoted or not gap:
            return -9.0
        if word in CHAT_OPENERS or word == "and" and text.startswith("and now", nxt):
            return 1.0
        return -3.0
    if first.isalpha():
        return 1.5  # a script without letter case
    if first in "—–-,;:":
        return -9.0
    return 0.5


def _closes(kind: str, opened: str) -> bool:
    return opened == kind or kind == "“" and opened == "„" or kind == "„" and opened == "“"


class _Block:
    """Candidates of a block and their scores."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        self.low = text.find("„", lo, hi) >= 0
        self.ends: list[int] = [lo]
        self.score: list[float] = [0.0]
        self._find()
        self.ends.append(hi)
        self.score.append(0.0)
        self.events = [self._quotes(a, b) for a, b in zip(self.ends, self.ends[1:])]
        for j in self._inside():
            self.score[j] -= INSIDE

    def _find(self) -> None:
        text, lo, hi = self.text, self.lo, self.hi
        at = []
        for m in _CANDIDATE.finditer(text, lo, hi):
            a, b = m.span()
            end = b
            while True:
                if end < hi and text[end] in CLOSERS and not (text[end] == "“" and not self._low_quote_open(end)) and not (text[end] == '"' and self._opens(end)):
                    end += 1
                elif end + 1 < hi and text[end] in "\xa0\u202f " and text[end + 1] == "»":
                    end += 2
                elif end < hi and text[end] in SENTENCE_MARKS and end > b:
                    end += 1
                else:
                    break
            nxt = _next_char(text, end, hi)
            if nxt >= hi:
                continue
            gap = nxt > end
            wide = text[b - 1] in "。！？।॥؟۔｡" or _wide(text[nxt]) and text[b - 1] in "!?"
            if not gap and not wide:
                # Without a space only a new capital, or a letter of a script without case, can begin a sentence.
                before, after = text[a - 1] if a > lo else "", text[nxt]
                ended = before.islower() or before.isdigit() or before in ")”»\"%€₽$"
                follow = text[nxt + 1] if nxt + 1 < hi else " "
                # An initial or a short title only after a word: "u.S" and the like stay whole.
                cased = ended and after.isupper() and (follow.islower() or follow.isspace() or follow in "'’" or follow == "." and (text[b - 1] in "!?" or len(_word_before(text, lo, a)) > 3))
                cased |= ended and (after in "“«¿¡„" or after == '"' and self._opens(nxt) or after == "(" and follow.isupper())
                caseless = before.isalpha() and after.isalpha() and not (after.isupper() or after.islower()) and not (before.isupper() or before.islower()) and len(_word_before(text, lo, a)) > 1 and "…" not in text[a:b] and b - a == 1
                if not (cased or caseless):
                    continue
            at.append((a, b, end, nxt))
        found = {end: self._rate(a, b, end, nxt) for a, b, end, nxt in at}
        for m in THAI_LAST.finditer(text, lo, hi):
            nxt = _next_char(text, m.end(), hi)
            if nxt < hi and m.end() not in found:
                found[m.end()] = 6.0
        for end in sorted(found):
            self.ends.append(end)
            self.score.append(found[end])

    def _opens(self, i: int) -> bool:
        """Whether a quote that can stand on either side opens here."""
        text = self.text
        left = text[i - 1] if i > self.lo else " "
        right = text[i + 1] if i + 1 < self.hi else " "
        return (left.isspace() or left in "([{—–-:=„«") and not right.isspace() or left in SENTENCE_MARKS and right.isalnum() and text.count(text[i], self.lo, i) % 2 == 0

    def _low_quote_open(self, i: int) -> bool:
        """Whether “ closes a quotation that began with „."""
        return self.low and self.text.rfind("„", self.lo, i) > max(self.text.rfind("“", self.lo, i), self.text.rfind("”", self.lo, i))

    def _rate(self, a: int, b: int, end: int, nxt: int) -> float:
        quoted = b < end and any(c in CLOSERS and c != "'" for c in self.text[b:end])
        close = _closing(self.text, self.lo, a, b, end, nxt, self.hi)
        if quoted and close < 0 and "…" in self.text[a:b]:
            close = 1.0
        if quoted and self._quote_begins_sentence(b, end) and self._attributed(end):
            close -= 12
        if quoted and self.text.startswith(QUOTING_PARTICLES, nxt) and any(c in QUOTES for c in self.text[b:end]):
            close -= 12
        return close + _opening(self.text, end, nxt, self.hi, quoted)

    def _quotes(self, a: int, b: int) -> list[str]:
        """Quotes and brackets between two candidates as +x and -x, turned to their kinds."""
        out = []
        for m in _QUOTE_OR_BRACKET.finditer(self.text, a, b):
            i, c = m.start(), m[0]
            if c == '"':
                out.append('+"' if self._opens(i) else '-"')
            elif c == "“":
                out.append("-„" if self._low_quote_open(i) else "+“")
            elif c in OPEN_OF:
                out.append("-" + OPEN_OF[c])
            else:
                out.append("+" + c)
        return out

    def _inside(self) -> list[int]:
        """Candidates inside a quotation that closes in this block, each once."""
        stack: list[tuple[str, int]] = []
        change = [0] * (len(self.ends) + 1)
        for j, events in enumerate(self.events, 1):
            for e in events:
                if e[0] == "+":
                    stack.append((e[1], j))
                elif stack and _closes(e[1], stack[-1][0]):
                    kind, opened = stack.pop()
                    if kind in QUOTES:
                        change[opened] += 1
                        change[j] -= 1
        return [j for j, depth in enumerate(accumulate(change)) if depth]

    def spans(self) -> list[tuple[int, int]]:
        n = len(self.ends)
        if n == 2:
            return [(self.lo, self.hi)]
        best, back = [0.0] + [float("-inf")] * (n - 1), [0] * n
        # Exact stops. Where a span from i passes j, one from j to the same end scores as much but for what is
        # unbalanced before j, the length, and best[j] for best[i]; closers still to come may balance some.
        passed = [float("-inf")] * n
        closers = [0] * n
        for j in range(n - 2, -1, -1):
            closers[j] = closers[j + 1] + (sum(e[0] == "-" for e in self.events[j]) if self.events[j] else 0)
        for i in range(n - 1):
            if passed[i] >= best[i]:
                continue  # an earlier start, with nothing unbalanced between, is as good for every end
            stack: list[str] = []
            stray = 0
            for j in range(i + 1, n):
                for e in self.events[j - 1]:
                    kind = e[1]
                    if e[0] == "+":
                        stack.append(kind)
                    elif stack and _closes(kind, stack[-1]):
                        stack.pop()
                    elif kind not in "([（【":
                        stray += 1
                score = best[i] + self.score[j] - UNBALANCED * (len(stack) + stray)
                length = self.ends[j] - self.ends[i]
                score -= BY_LENGTH * max(0, length - LONG) + (TINY if length < 3 else 0.0)
                if score > best[j]:
                    best[j], back[j] = score, i
                if not stack and not stray:
                    passed[j] = max(passed[j], best[i] - BY_LENGTH * length)
                if best[j] - TINY > best[i] - UNBALANCED * (len(stack) + stray - 2 * min(len(stack), closers[j])):
                    break  # a start at j is better for every later end
        out, j = [], n - 1
        while j > 0:
            out.append((self.ends[back[j]], self.ends[j]))
            j = back[j]
        return out[::-1]

    def _quote_begins_sentence(self, b: int, end: int) -> bool:
        """Whether the quotation that closes between b and end opened where a sentence may begin."""
        text = self.text
        closer = next((c for c in text[b:end] if c in QUOTES), None)
        if closer is None:
            return False
        openers = {'"': '"', "“": "„", "”": "“„”", "»": "«", "«": "»", "」": "「", "』": "『"}.get(closer, "")
        at = max(text.rfind(o, self.lo, b) for o in openers) if openers else -1
        if at < 0:
            return False
        before = _back(text, self.lo, at)
        return before == self.lo or text[before - 1] in SENTENCE_MARKS + CLOSERS

    def _attributed(self, end: int) -> bool:
        """Whether the words after a quotation say whose it is."""
        a = _next_char(self.text, end, self.hi)
        cut = _CLAUSE_END.search(self.text, a, self.hi)
        return SAYING.search(self.text, a, cut.start() if cut else self.hi) is not None


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Code-point spans of the sentences of a text, end exclusive; none for null, empty or blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for a, b, item in blocks(text):
        found = [(a, b)] if item else _Block(text, a, b).spans()
        for x, y in found:
            x, y = _trim(text, x, y)
            if x < y:
                out.append((x, y))
    return out
