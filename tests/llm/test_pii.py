import hashlib
import re
import time

import pytest

from quirefold.llm import pii
from tests.llm import cases

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if holds(k, m.group())]


TRICKY = [
    "a@b.c+d@e.f", "a@b", "@x.y", "a@b..c", "x@y.z.", "1.2.3.4.5.6.7.8", "01.002.3.255", "1.2.3.256 1.2.3.4",
    "4111-1111 1111-1111", "4111  1111 1111 1111", "+4111111111111111", "+1 (2) 3", "+1 234 567 890 +2 345 678 9012", "++1-234-567-890-",
    "4" * 40, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 7", "\U0001f600 a@b.c \U0001f600 1.1.1.1", "a" * 50_000 + "@" + "b" * 50_000, "1." * 20_000 + "1",
]


def test_base_spans_match_a_plain_scan(spark):
    texts = TRICKY + [r[1] for r in cases.rows()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find_spans(d).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS]
        assert got == plain(texts[r.doc_id] or ""), texts[r.doc_id][:80]


def test_checksums_and_context(spark):
    rows = {r.doc_id: r.spans for r in pii.find_spans(cases.documents(spark)).where("doc_id in (67, 68)").collect()}
    kinds = [(s.kind, s.score) for s in rows[68]]
    assert kinds == [("iban", 1.0), ("ssn", 0.75)]
    assert ("card", 1.0) in [(s.kind, s.score) for s in rows[67]]


def test_query_columns(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    for doc_id, text, *_ in cases.rows():
        texts.setdefault(doc_id, []).append(text or "")
    for r in pii.op2_pii(spark, str(tmp_path)).collect():
        hashes = [hashlib.sha256(",".join("%s:%d:%d" % s for s in plain(t)).encode()).hexdigest() for t in texts[r.doc_id]]
        assert r.base_sha256 in hashes
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == sum(1 for s in r.spans.split(",") if s.split(":")[0] in BASE)


def test_redact_keeps_columns_and_everything_else(spark):
    d = cases.documents(spark)
    out = pii.redact(d)
    assert out.columns == d.columns
    by_id = {r.doc_id: r for r in out.where("doc_id in (60, 61, 63, 67, 68)").collect()}
    assert by_id[60].text is None and by_id[61].text == "" and by_id[63].text == "one two three"
    assert by_id[67].text == "mail [EMAIL][EMAIL], card [CARD], [PHONE], host [IP] 10.0.0.256 [IP].5"
    assert by_id[68].text.startswith("bank account [IBAN] and not DE89370400440532013001; social security [SSN], ")
    assert by_id[67].n_chars == len(by_id[67].text)


@pytest.mark.parametrize("fn", [pii.find_spans, pii.redact])
def test_empty_table(spark, fn):
    assert fn(cases.empty(spark)).count() == 0


def test_plan_has_no_python_and_no_exchange(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    plan = pii.op2_pii(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def around(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.kind not in pii.BASE_KINDS] for r in pii.find_spans(d).collect()}
    return [found[i] for i in range(len(texts))], [r.text for r in pii.redact(d).orderBy("doc_id").collect()]


def test_context_on_both_sides_and_along_lists(spark):
    ssns = [f"{200 + i}-45-{6000 + i}" for i in range(30)]
    far = " word" * 12
    texts = [
        "social security numbers: " + ", ".join(ssns), "SSN\n" + "\n".join(ssns), ", ".join(ssns) + " (SSN)", "123-45-6789 (SSN)",
        f"ssn 000-45-6789 {ssns[0]}", f"{ssns[0]}{far} ssn {ssns[1]}{far} {ssns[2]}", f"part {ssns[0]}", f"ssn {ssns[0]}x", "\U0001f600 " * 20 + ssns[0] + " ssn",
    ]
    found, clean = around(spark, texts)
    want = [ssns, ssns, ssns, ["123-45-6789"], [ssns[0]], [ssns[1]], [], [], [ssns[0]]]
    assert found == [[("ssn", s) for s in w] for w in want]
    assert clean[0] == "social security numbers: " + ", ".join(["[SSN]"] * 30) and clean[3] == "[SSN] (SSN)"


def test_ibans_in_print_form(spark):
    de, gb, be, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "NO93 8601 1117 947"
    texts = [
        f"{de} {gb} {be} EUR {no} PAID", f"{de}, {de.replace(' ', '')}; DE89 37040044 0532013000", de[:-1] + "1", "DE89  3704 0044 0532 0130 00",
        f"REF AB12 CD34 {de}", de + "7", "XX89 3704 0044 0532 0130 00",
    ]
    found, clean = around(spark, texts)
    want = [[de, gb, be, no], [de, de.replace(" ", ""), "DE89 37040044 0532013000"], [], [], [de], [], []]
    assert found == [[("iban", s) for s in w] for w in want]
    assert clean[0] == "[IBAN] [IBAN] [IBAN] EUR [IBAN] PAID"


def test_query_finds_lists(spark, tmp_path):
    rows = [(1, "social security numbers: 123-45-6789, 234-56-7890, 345-67-8901; IBAN DE89 3704 0044 0532 0130 00")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = pii.op2_pii(spark, str(tmp_path)).collect()
    assert [s.split(":")[0] for s in r.spans.split(",") if s.split(":")[0] in ("iban", "ssn")] == ["iban", "ssn", "ssn", "ssn"]


LONG = {
    "email": " ".join(f"u{i}@h{i % 97}.org" for i in range(50_000)),
    "ip": ",".join(f"10.{i % 250}.{i // 250 % 250}.7" for i in range(50_000)),
    "ssn": "social security: " + ", ".join(f"{100 + i % 500}-{10 + i % 80}-{1000 + i % 8000}" for i in range(50_000)) + " end " * 30 + "123-45-6789",
    "mixed": "\n".join(f"row {i} a{i}@b.co 4111111111111111 +1 555 {1000000 + i} 1.2.3.{i % 300} é" for i in range(20_000)),
}


def plain_redaction(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_very_long_texts_with_many_matches(spark):
    d = spark.createDataFrame(list(LONG.items()), "doc_id string, text string").repartition(4)
    begun = time.monotonic()
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_spans(d).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert time.monotonic() - begun < 60  # quadratic work takes many minutes
    for name, text in LONG.items():
        assert [s for s in found[name] if s[0] in pii.BASE_KINDS] == plain(text)
        assert clean[name] == plain_redaction(text, found[name])
    # one heading serves the list, and not the number far behind it
    assert [s[0] for s in found["ssn"]].count("ssn") == 50_000


@pytest.mark.parametrize("block", [1, 2, 5, 128])
def test_blocks_leave_no_trace(spark, monkeypatch, block):
    """Spans, contexts across short gaps, lists and overlapping redactions, whatever a block holds."""
    texts = [" ".join(f"{i}@x.y" for i in range(13)), "ssn 123-45-6789, 234-56-7890 345-67-8901", "345-67-8901 234-56-7890 (SSN)", "", "a@b.c1.2.3.4@d.e 10.0.0.1", TRICKY[0], TRICKY[5], TRICKY[9], TRICKY[12]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {r.doc_id: r.spans for r in pii.find_spans(d).collect()}, {r.doc_id: r.text for r in pii.redact(d).collect()}
    monkeypatch.setattr(pii, "BLOCK", block)
    assert ({r.doc_id: r.spans for r in pii.find_spans(d).collect()}, {r.doc_id: r.text for r in pii.redact(d).collect()}) == want
    for i, t in enumerate(texts):
        assert want[1][i] == plain_redaction(t, [(s.kind, s.start, s.end) for s in want[0][i]])
    assert [s.kind for s in want[0][1]] == ["ssn"] * 3 and [s.kind for s in want[0][2]] == ["ssn"] * 2
