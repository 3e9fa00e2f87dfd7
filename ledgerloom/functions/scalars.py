"""Column expressions of the ledger: money, dates, text, ids. All stay in generated code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Short codes of known institutions.
INSTITUTION_CODES = {"BANK OF AMERICA": "BOA", "BANK OF AMERICA, N.A.": "BOA", "BOFA": "BOA"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def even_spaces(c: Column) -> Column:
    """Every kind of blank as a plain one, so that \\s means the same in all regex dialects."""
    return F.regexp_replace(c, r"[\p{Z}\t]", " ")


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(c * 10**digits + 0.5) / F.lit(float(10**digits))


def parse_amount(text: Column) -> Column:
    """A number from text with $, thousands marks, a leading minus or parentheses; null if it is none.

    A trailing minus is ignored.
    """
    bare = F.regexp_replace(text, r"[$,\s()]", "")
    number = F.abs(F.regexp_extract(bare, r"^-?(\d+\.?\d*|\.\d+)", 1).try_cast("double"))
    negative = F.contains(text, F.lit("(")) | F.startswith(bare, F.lit("-"))
    return F.when(negative, -number).otherwise(number)


def currency(amount: Column) -> Column:
    """$1,234.50, with the minus before the sign."""
    text = F.concat(F.lit("$"), F.format_number(F.abs(amount), 2))
    return F.when(amount < 0, F.concat(F.lit("-"), text)).otherwise(text)


def parse_us_date(text: Column, year: Column) -> Column:
    """A day from M/D/YY, M/D/YYYY, M/D or Mon D (the latter two of the given year); null if it is none."""
    t = F.trim(text)
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    full, short, named = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", r"^(\d{1,2})/(\d{1,2})$", r"^([A-Za-z]{3})\s+(\d{1,2})$"
    y = F.coalesce(F.when(F.length(part(full, 3)) == 2, F.concat(F.lit("20"), part(full, 3))).otherwise(part(full, 3)), F.when(t.rlike(short) | t.rlike(named), year.cast("string")))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(named, 1)))
    m = F.coalesce(part(full, 1), part(short, 1), F.when(month > 0, month.cast("string")))
    d = F.coalesce(part(full, 2), part(short, 2), part(named, 2))
    return F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def institution_code(name: Column) -> Column:
    tidy = F.regexp_replace(F.upper(F.trim(name)), r"\s+", " ")
    out = F.regexp_replace(tidy, " ", "_")
    for known, code in INSTITUTION_CODES.items():
        out = F.when(tidy == known, code).otherwise(out)
    return out


def statement_key(institution: Column, kind: Column, mask: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", institution_code(institution), F.lower(F.trim(kind)), mask, start.cast("string"), end.cast("string"))


def period_label(institution: Column, kind: Column, start: Column, end: Column) -> Column:
    """YYYY-MM for a period within a month, start..end otherwise, then institution and kind."""
    name = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 100)))
    month = F.date_format(start, "yyyy-MM")
    span = F.when(month == F.date_format(end, "yyyy-MM"), month).otherwise(F.concat(start.cast("string"), F.lit(".."), end.cast("string")))
    return F.concat_ws(" ", span, institution_code(institution), name)


def for_hash(c: Column) -> Column:
    """Trimmed, blanks collapsed, upper case; empty for null."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Z}\s]+", " ")))


def transaction_key(statement: Column, day: Column, posted: Column, direction: Column, amount: Column, description: Column, merchant: Column, page: Column, original: Column) -> Column:
    """tx_ and 24 hex digits over nine parts; amount must be a decimal of two places."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [text(statement), text(day), text(posted), text(direction), text(amount), for_hash(description), for_hash(merchant), text(page), for_hash(original)]
    return F.concat(F.lit("tx_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def is_transaction_key(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^tx_[a-f0-9]{24}$"), F.lit(False))


def is_statement_key(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\x21-\x7E]+$"), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 1 minus the edit distance over the longer length."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def similarity_from(a: str, b: str, least: float | str, measured: bool = False) -> Column:
    """The similarity of two columns that are trimmed and in lower case already, 0 where it is under `least`, a number or a column's name.

    The edit distance stops as soon as it is too large. measured: their lengths and letters are at hand,
    as can_be_similar() wants them, and tell most texts apart without it.
    """
    edits = f"(1 - `{least}`)" if isinstance(least, str) else f"{1 - least!r}"
    length = (lambda c: f"`{c}_length`") if measured else (lambda c: f"length(`{c}`)")
    longest = F.expr(f"greatest({length(a)}, {length(b)})")
    distance = F.expr(f"levenshtein(`{a}`, `{b}`, cast(floor(greatest({length(a)}, {length(b)}) * {edits} + 1e-9) as int))")
    close = can_be_similar(a, b, F.expr(edits)) if measured else F.expr(f"abs({length(a)} - {length(b)}) <= greatest({length(a)}, {length(b)}) * {edits} + 1e-9")
    # Too large a distance comes as -1, which the remainder makes larger than any text is.
    return F.when(F.col(a) == F.col(b), 1.0).when(close, F.greatest(1 - F.pmod(distance, F.lit(2**31 - 1)) / longest, F.lit(0.0))).otherwise(0.0)


#: Characters that letters() counts, and how far; others count for nothing. They fill 63 bits.
COUNTED = [*[(c, 3 if c in "ae" else 2) for c in "abcdefghijklmnopqrstuvwxyz"], (" ", 3), ("0123456789", 6)]


def letters(texts: pa.Array) -> pa.Array:
    """How often each text has each of COUNTED, a bit for each time."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    place = np.full(256, len(COUNTED))
    for i, (chars, _) in enumerate(COUNTED):
        place[list(chars.encode())] = i
    at = place[np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    counts = np.bincount(row * (len(COUNTED) + 1) + at, minlength=len(texts) * (len(COUNTED) + 1)).reshape(len(texts), -1)
    out, bit = np.zeros(len(texts), np.int64), 0
    for i, (_, most) in enumerate(COUNTED):
        out |= ((np.int64(1) << np.minimum(counts[:, i], most)) - 1) << bit
        bit += most
    return pa.array(out)


def can_be_similar(a: str, b: str, edits: Column) -> Column:
    """False only where two columns differ by more than `edits` times the longer length; beside them are a_length, a_letters and so on."""
    x, y, p, q = (F.col(f"{c}_{k}") for k in ("length", "letters") for c in (a, b))
    most = F.greatest(x, y) * edits + 1e-9
    return F.greatest(F.abs(x - y), F.bit_count(p.bitwiseAND(F.bitwise_not(q))), F.bit_count(q.bitwiseAND(F.bitwise_not(p)))) <= most


def csv_field(c: Column, delimiter: str = ",") -> Column:
    """Quoted only if it holds the delimiter, a quote or a line break; empty for null."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    quote = F.contains(s, F.lit(delimiter)) | s.rlike('["\\r\\n]')
    return F.when(quote, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def xml_text(c: Column, longest: int) -> Column:
    """Escaped, other than printable ASCII as ?, then cut; a cut may fall inside an entity."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return F.substring(F.regexp_replace(c, r"[^\x20-\x7E]", "?"), 1, longest)


def merchant_key(description: Column) -> Column:
    """The first three words without punctuation, lower case; four if a payment to or from a person begins with zelle."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.lower(even_spaces(description)), r"[^a-z0-9\s]", ""), r"\s+", " "))
    words = F.split(tidy, " ")
    person = tidy.rlike(r"^zelle payment (from|to)( |$)")
    return F.when(person, F.array_join(F.slice(words, 1, 4), " ")).otherwise(F.array_join(F.slice(words, 1, 3), " "))


def pattern_hash(key: Column) -> Column:
    """The 31-multiplier string hash in 32 bits, its absolute value as eight hex digits."""
    codes = F.transform(F.split(key, ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: (acc * 31 + x).bitwiseAND(F.lit(4294967295)))
    signed = F.when(h >= 2147483648, 4294967296 - h).otherwise(h)
    return F.lpad(F.lower(F.hex(signed)), 8, "0")


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name or its first three letters, whatever their case; null if it is none."""
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.trim(name), 1, 3)))
    return F.when(place > 0, place.cast("int"))


def statement_year(period_end: Column) -> Column:
    """The year that a statement's days without a year are of."""
    return F.year(period_end)
