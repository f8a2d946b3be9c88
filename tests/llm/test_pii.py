import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import pii
from tests.llm.helpers import empty_docs, odd_docs, sf_docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    out = 0
    for i, d in enumerate(map(int, digits[::-1])):
        out += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return out % 10 == 0


def passes(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")),
            "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def base(text):
    return [x[:3] for x in pii.spans(text) if x[0] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aB1239.@+-() %_é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111", "1111", " ", "-", "1.2", ".3", "255", "+4", "@", "x.y", "-", "7"]), max_size=30).map("".join))
def test_base_spans_equal_the_plain_patterns_on_likely_pieces(text):
    assert base(text) == brute(text)


def test_given_texts_and_digest(spark):
    rows = {r.doc_id: r for r in pii.op2(sf_docs(spark)).collect()}
    for d in sf_docs(spark).collect():
        want = brute(d.text)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]


def test_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    found = pii.spans("iban GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789; part 123-45-6789" + " " * 60)
    kinds = [x[0] for x in found]
    assert kinds.count("iban") == 1 and kinds.count("ssn") >= 1
    assert not [x for x in pii.spans("part no 123-45-6789 in stock") if x[0] == "ssn"]
    alone, near = pii.spans("4111111111111111")[0][3], pii.spans("visa card 4111111111111111")[0][3]
    assert near > alone


def test_ibans_before_capitals_digits_and_line_ends():
    plain, grouped, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for iban in (plain, grouped, other, "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for tail in (" Please pay", " BIC COBADEFF", " 2024", " A", "\nNext", "\n", ".", "", " and", " BIC COBADEFF XXX 12 OF THE BANK IN FULL"):
            text = f"to {iban}{tail}"
            assert [x[:3] for x in pii.spans(text)] == [("iban", 3, 3 + len(iban))], text
            assert pii.redact_text(text) == f"to [IBAN]{tail}"
    two = f"{plain} {other} AB12 CD34 EF56 GH78 {plain} X"
    assert [two[s:e] for k, s, e, _ in pii.spans(two) if k == "iban"] == [plain, other, plain]
    for text in ("DE89370400440532013001 Please", "xDE89370400440532013000", "DE89370400440532013000x", "DE8937040044053201300"):
        assert not [x for x in pii.spans(text) if x[0] == "iban"]


def test_redaction_masks_and_leaves_clean_texts(spark):
    docs = sf_docs(spark).withColumn("spans", F.lit(1))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    for r in docs.withColumnRenamed("text", "old").join(out.select("doc_id", "text"), "doc_id").collect():
        assert not brute(r.text)
        assert (r.text == r.old) == (not pii.spans(r.old))


def test_odd_texts_and_empty_table(spark):
    assert pii.op2(odd_docs(spark)).count() == odd_docs(spark).count()
    assert pii.redact(odd_docs(spark)).where("text is null").count() == 1
    assert pii.op2(empty_docs(spark)).count() == 0
    big = "9" * 2_000_000 + "a" * 2_000_000 + "1." * 500_000 + "(" * 100_000
    assert pii.spans(big) is not None
