"""Checking documents against the two versions of the result's schema.

The schemas are tables of fields; documents of unknown shape are walked in Python on Arrow batches, and
each violation is a row with its path and keyword.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSIONS, DEFAULT = ("v1", "v2"), "v1"
# The fields of each object. A ? marks what may be absent, -> the object or list of objects that a field holds.
# text:n is a text of n characters or more, int:n a whole number from n on, share a number from 0 to 1, day yyyy-mm-dd.
COMMON = {
    "period": "start day; end day",
    "summary": "startingBalance number; endingBalance number; totalCredits number; totalDebits number",
    "raw": "originalText text; page int:1",
    "error": "filename text; error text",
}
V1 = COMMON | {
    "": "schemaVersion? =v1; schemaRevision? text; statements [->statement; totalStatements int:0; totalTransactions int:0; parseErrors? [->error; recurring? any",
    "statement": "account ->account; summary ->summary; transactions [->transaction; metadata ->metadata; statementId? text; periodLabel? text",
    "account": "institution =Bank of America; accountType checking|savings|credit; accountNumberMasked /^\\*{4}\\d{4}$/; statementPeriod ->period; currency =USD",
    "transaction": "date day; postedDate any; description text:1; merchant any; amount number; direction debit|credit; category text:1; subcategory any; confidence share; raw ->raw; transactionId? /^tx_[a-f0-9]{24}$/",
    "metadata": "parserVersion text; parsedAt text; warnings [text; sourceFile? text",
}
V2 = COMMON | {
    "": "schemaVersion? =v2; schemaRevision? text; startingBalance number; endingBalance number; totalStatements int:0; totalTransactions int:0; accounts [->block; analytics any; integrity any; recurring? any; dataSources? any; reconciliation? any",
    "block": "account ->account; summary ->summary; transactions [->transaction; totalStatements int:0; totalTransactions int:0",
    "account": "institution text:1; accountType checking|savings|credit|unknown; accountNumberMasked text:4; statementPeriod ->period; currency text:3",
    "transaction": "date day; postedDate any; description text:1; merchant text:1; amount number; direction credit|debit; category text; subcategory any; confidence share; statementId text; periodLabel text; raw ->raw; transactionId? /^tx_[a-f0-9]{24}$/; plaidMatch? any",
}
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
Schema = dict[str, dict[str, tuple[bool, str]]]


def _parsed(table: dict[str, str]) -> Schema:
    out: Schema = {}
    for name, text in table.items():
        fields = (f.split(" ", 1) for f in text.split("; "))
        out[name] = {k.rstrip("?"): (not k.endswith("?"), kind) for k, kind in fields}
    return out


SCHEMAS = {"v1": _parsed(V1), "v2": _parsed(V2)}


def assert_version(version: str) -> str:
    if version not in VERSIONS:
        raise ValueError(f"version must be one of {VERSIONS}, not {version!r}")
    return version


def resolve_version(asked: str | None = None, environment: str | None = None, configured: str | None = None) -> str:
    """The first version that is given: what is asked for, the environment's, the configured one, else v1. Unknown ones are an error."""
    return next((assert_version(v) for v in (asked, environment, configured) if v), DEFAULT)


def _one(value: object, kind: str) -> str | None:
    """The keyword that a value breaks, of a kind that holds no object."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "any":
        return None
    if kind.startswith("="):
        return None if value == kind[1:] else "const"
    if kind in ("number", "share"):
        return "type" if not number else "minimum" if kind == "share" and value < 0 else "maximum" if kind == "share" and value > 1 else None
    if kind.startswith("int"):
        return "type" if not number or value != int(value) else "minimum" if value < int(kind[4:]) else None
    if "|" in kind and not kind.startswith("/"):
        return None if value in kind.split("|") else "enum"
    if not isinstance(value, str):
        return "type"
    if kind == "day":
        return None if _DAY.fullmatch(value) else "pattern"
    if kind.startswith("/"):
        return None if re.search(kind[1:-1], value) else "pattern"
    return "minLength" if kind.startswith("text:") and len(value) < int(kind[5:]) else None


def violations_of(document: object, version: str) -> list[tuple[str, str]]:
    """(path, keyword) of everything that breaks the schema; / is the document itself."""
    schema, out = SCHEMAS[assert_version(version)], []
    todo: list[tuple[object, str, str]] = [(document, "", "")]
    while todo:
        value, name, path = todo.pop()
        if not isinstance(value, dict):
            out.append((path or "/", "type"))
            continue
        fields = schema[name]
        out += [(path or "/", "required") for k, (must, _) in fields.items() if must and k not in value]
        out += [(path or "/", "additionalProperties") for k in value if k not in fields]
        for k, (_, kind) in fields.items():
            if k not in value:
                continue
            items, at = [(value[k], f"{path}/{k}")], kind
            if kind.startswith("["):
                if not isinstance(value[k], list):
                    out.append((f"{path}/{k}", "type"))
                    continue
                items, at = [(v, f"{path}/{k}/{i}") for i, v in enumerate(value[k])], kind[1:]
                if not items and version == "v2" and k == "accounts":
                    out.append((f"{path}/{k}", "minItems"))
            for v, p in items:
                if at.startswith("->"):
                    todo.append((v, at[2:], p))
                elif (broken := _one(v, at)) is not None:
                    out.append((p, broken))
    return sorted(out)


def violations(df: DataFrame, id_: str, document: str, version: str | None = None) -> DataFrame:
    """(id, version, path, keyword) of each JSON document; one that cannot be read breaks `parse`.

    Without a version each document's own schemaVersion counts, v1 if it names none that is known.
    """
    fixed = assert_version(version) if version else None

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["document"]):
                if text is None:
                    continue
                try:
                    doc = json.loads(text)
                except (ValueError, RecursionError):
                    rows.append((key, fixed, "/", "parse"))
                    continue
                named = doc.get("schemaVersion") if isinstance(doc, dict) else None
                v = fixed or (named if named in VERSIONS else DEFAULT)
                rows += [(key, v, p, k) for p, k in violations_of(doc, v)]
            yield pd.DataFrame(rows, columns=["id", "version", "path", "keyword"])

    kind = dict(df.dtypes)[id_]
    return df.select(F.col(id_).alias("id"), F.col(document).alias("document")).mapInPandas(check, f"id {kind}, version string, path string, keyword string")
