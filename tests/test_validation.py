import copy
import json
from datetime import date

import pytest
from ledgerloom.operators import positions
from ledgerloom.operators.validation import resolve_version, violations, violations_of
from ledgerloom.sinks import reports

TX = {"date": "2025-01-15", "postedDate": None, "description": "x", "merchant": "m", "amount": -5, "direction": "debit", "category": "Food", "subcategory": None, "confidence": 0.5, "raw": {"originalText": "o", "page": 1}}
ACCOUNT = {"institution": "Bank of America", "accountType": "checking", "accountNumberMasked": "****1234", "statementPeriod": {"start": "2025-01-01", "end": "2025-01-31"}, "currency": "USD"}
SUMMARY = {"startingBalance": 1, "endingBalance": 2.5, "totalCredits": 0, "totalDebits": 0}
V1 = {"schemaVersion": "v1", "statements": [{"account": ACCOUNT, "summary": SUMMARY, "transactions": [TX], "metadata": {"parserVersion": "1", "parsedAt": "2025-02-01T00:00:00Z", "warnings": []}}], "totalStatements": 1, "totalTransactions": 1}
V2 = {"schemaVersion": "v2", "startingBalance": 1, "endingBalance": 2, "totalStatements": 1, "totalTransactions": 1, "accounts": [{"account": ACCOUNT, "summary": SUMMARY, "transactions": [TX | {"statementId": "s", "periodLabel": "p"}], "totalStatements": 1, "totalTransactions": 1}], "analytics": {}, "integrity": {}}


def changed(doc, path, value):
    doc = copy.deepcopy(doc)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


def test_valid_documents():
    assert violations_of(V1, "v1") == [] and violations_of(V2, "v2") == []


@pytest.mark.parametrize(
    ("path", "value", "want"),
    [
        (["totalStatements"], ..., ("/", "required")), (["totalStatements"], -1, ("/totalStatements", "minimum")), (["totalStatements"], 1.5, ("/totalStatements", "type")), (["more"], 1, ("/", "additionalProperties")), (["statements"], {}, ("/statements", "type")),
        (["statements", 0, "account", "accountType"], "loan", ("/statements/0/account/accountType", "enum")), (["statements", 0, "account", "currency"], "EUR", ("/statements/0/account/currency", "const")), (["statements", 0, "account", "accountNumberMasked"], "1234", ("/statements/0/account/accountNumberMasked", "pattern")),
        (["statements", 0, "transactions", 0, "confidence"], 1.2, ("/statements/0/transactions/0/confidence", "maximum")), (["statements", 0, "transactions", 0, "date"], "1/2/25", ("/statements/0/transactions/0/date", "pattern")), (["statements", 0, "transactions", 0, "description"], "", ("/statements/0/transactions/0/description", "minLength")),
        (["statements", 0, "transactions", 0, "amount"], "5", ("/statements/0/transactions/0/amount", "type")), (["statements", 0, "summary"], None, ("/statements/0/summary", "type")), (["statements", 0, "metadata", "warnings"], [1], ("/statements/0/metadata/warnings/0", "type")),
        (["statements", 0, "transactions", 0, "transactionId"], "tx_1", ("/statements/0/transactions/0/transactionId", "pattern")),
    ],
)
def test_each_keyword(path, value, want):
    assert violations_of(changed(V1, path, value), "v1") == [want]


def test_documents_as_rows(spark):
    docs = [("a", json.dumps(V1)), ("b", json.dumps(changed(V2, ["accounts"], []))), ("c", "{"), ("d", None), ("e", "[]"), ("f", json.dumps(changed(V1, ["schemaVersion"], "v9")))]
    df = spark.createDataFrame(docs, "id string, doc string")
    got = sorted((r.id, r.version, r.path, r.keyword) for r in violations(df, "id", "doc").collect())
    assert got == [("b", "v2", "/accounts", "minItems"), ("c", None, "/", "parse"), ("e", "v1", "/", "type"), ("f", "v1", "/schemaVersion", "const")]
    assert violations(df, "id", "doc", "v2").where("id = 'a' and keyword = 'required'").count() == 5
    assert violations(df.limit(0), "id", "doc").count() == 0


def test_versions():
    assert resolve_version() == "v1" and resolve_version("v2", "v1") == "v2" and resolve_version(None, "v2", "v1") == "v2" and resolve_version("", "", "v2") == "v2"
    with pytest.raises(ValueError):
        resolve_version("v3")


def test_text_reports(spark):
    owners = spark.createDataFrame([("a", "Ann", "a@b", None)], "account_id string, name string, email string, phone string")
    assert reports.owners_report(owners) == "Owners\n  a: Ann, a@b" and reports.owners_report(owners.limit(0)).endswith("none known")
    numbers = spark.createDataFrame([("a", "12345678", "021")], "account_id string, account string, routing string")
    assert reports.numbers_report(numbers) == "Account numbers\n  a: ****5678, routing 021"
    debts = spark.createDataFrame([("a", "card", 10.0, [("p", 19.5), ("q", 25.0)], 2.0, date(2025, 1, 2)), ("b", "loan", 99.0, [], None, None)], "account_id string, kind string, balance double, aprs array<struct<type:string,percentage:double>>, next_payment double, next_due date")
    text = reports.liabilities_report(positions.liability_report(debts, spark.createDataFrame([("a", "Gold", "1")], "account_id string, name string, mask string")))
    assert text == "Liabilities\n  b (loan): 99.00\n  Gold (card): 10.00, 25.00%, next 2.00 on 2025-01-02"
    s = spark.createDataFrame([(3, 2, 1, 5, 1)], "files_found int, files_read int, files_failed int, statements_found int, duplicates_removed int")
    assert reports.batch_report(s, spark.createDataFrame([("x.pdf", "No text")], "file string, error string")) == "Files\nRead: 2 of 3\nStatements: 5, 1 of them duplicates\n  x.pdf: No text"
