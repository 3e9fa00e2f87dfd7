"""Short text reports: a few lines from one summary row and at most `top` rows of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.positions import masked

TOP = 10


def _listed(rows: DataFrame, order: list[str], line, top: int) -> list[str]:
    """The first rows as lines; what is beyond them is counted, not fetched."""
    shown = rows.orderBy(*order).limit(top + 1).collect()
    out = [line(r) for r in shown[:top]]
    if len(shown) > top:
        out.append(f"... and {rows.count() - top} more")
    return out


def reconciliation_report(summary: DataFrame, unmatched_left: DataFrame, unmatched_right: DataFrame, top: int = TOP) -> str:
    """Counts, rate and amounts, then the first rows of each side without a match. Empty sides have no section."""
    s = summary.first()
    out = [
        "Reconciliation", f"Matched: {s.matched} ({s.match_rate:.1%})", f"  exact {s.exact}, fuzzy {s.fuzzy}, amount and date {s.amount_date}, other {s.amount_only}",
        f"Amounts: {s.amount_left:.2f} against {s.amount_right:.2f}, difference {s.amount_difference:.2f}",
    ]
    for title, rows, text in (("Only in statements", unmatched_left, "description"), ("Only in the feed", unmatched_right, "name")):
        lines = _listed(rows, ["date", "id"], lambda r, text=text: f"  {r.date} {r.amount:>12} {r[text]}", top)
        if lines:
            out += [f"{title}:", *lines]
    return "\n".join(out)


def merge_report(merged: DataFrame) -> str:
    """How many rows were updated from the feed, added from it, and left as they were."""
    n = {r.origin: r["count"] for r in merged.groupBy("origin").count().collect()}  # three origins
    return "\n".join(["Merge", f"Updated: {n.get('both', 0)}", f"Added: {n.get('feed', 0)}", f"Unchanged: {n.get('ledger', 0)}"])


def balance_report(checks: DataFrame, top: int = TOP) -> str:
    """Statements whose balances do not add up, the largest differences first."""
    bad = checks.where(~F.col("passed")).withColumn("size", -F.abs("delta"))
    lines = _listed(bad, ["size", "id"], lambda r: f"  {r.severity}: {r.id} is off by {r.delta:.2f}", top)
    return "\n".join(["Balances", *(lines or ["  all statements add up"])])


def holdings_report(gains: DataFrame, totals: DataFrame, top: int = TOP) -> str:
    """The largest holdings and each account's totals."""
    lines = _listed(gains.selectExpr("*", "-value as size"), ["size", "security_id"], lambda r: f"  {r.security or r.security_id}: {r.value:.2f}" + ("" if r.gain is None else f" ({r.gain:+.2f})"), top)
    sums = _listed(totals, ["account_id"], lambda r: f"  {r.account_id}: {r.value:.2f}, gain {r.gain:+.2f}", top)
    return "\n".join(["Holdings", *lines, "Accounts", *sums])


def owners_report(owners: DataFrame, top: int = TOP) -> str:
    """Who holds each account; what is unknown is left out."""
    lines = _listed(owners, ["account_id", "name"], lambda r: f"  {r.account_id}: " + ", ".join(x for x in (r.name, r.email, r.phone) if x), top)
    return "\n".join(["Owners", *(lines or ["  none known"])])


def numbers_report(numbers: DataFrame, top: int = TOP) -> str:
    """Account and routing numbers, all but the last digits hidden. numbers: account_id, account, routing."""
    shown = numbers.select("account_id", masked(F.col("account")).alias("account"), "routing")
    lines = _listed(shown, ["account_id"], lambda r: f"  {r.account_id}: {r.account or '-'}, routing {r.routing or '-'}", top)
    return "\n".join(["Account numbers", *(lines or ["  none known"])])


def liabilities_report(liabilities: DataFrame, top: int = TOP) -> str:
    """Debts, the largest first, with rate and next payment where they are known."""
    rate = lambda r: "" if r.highest_apr is None else f", {r.highest_apr:.2f}%"
    due = lambda r: "" if r.next_payment is None else f", next {r.next_payment:.2f}" + (f" on {r.next_due}" if r.next_due else "")
    lines = _listed(liabilities.selectExpr("*", "-balance as size"), ["size", "account_id"], lambda r: f"  {r.account or r.account_id} ({r.kind}): {r.balance or 0:.2f}{rate(r)}{due(r)}", top)
    return "\n".join(["Liabilities", *(lines or ["  none known"])])


def batch_report(summary: DataFrame, errors: DataFrame, top: int = TOP) -> str:
    """How many files could be read, and the first of those that could not."""
    s = summary.first()
    lines = _listed(errors, ["file"], lambda r: f"  {r.file}: {r.error}", top)
    return "\n".join(["Files", f"Read: {s.files_read} of {s.files_found}", f"Statements: {s.statements_found}, {s.duplicates_removed} of them duplicates", *lines])
