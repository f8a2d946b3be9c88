"""Operator 2, personal data: expressions propose, checksums confirm, context
words adjust the score.

A kind proposes spans with a linear-time scan (leftmost, non-overlapping
within the kind); a failed check drops the proposal without a retry, but for
``iban``, whose ends and later starts are tried as well. Each span
has a score: a base for the kind, plus a step when a context word of the kind
stands within CONTEXT code points. Kinds with a checksum or an unmistakable
shape pass alone; a weak shape (``ssn``) needs its context word to reach
MIN_SCORE.

Defined results: a null text counts as empty; repeated rows and null ids are
scanned row by row; an empty table gives an empty result; other columns of
the input are kept by ``redact`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import doc_texts, free_name

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT = 40
MIN_SCORE = 0.5

#: Base score and context words of each kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social security"),
}
BOOST = 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match that fails at the first digit of a run fails at all its digits, so
#: the look-behind loses nothing and keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Runs of at least 13 digits with single separators are the only card runs;
#: a shorter run is a match of the contract's pattern that its check drops.
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The longest run an IBAN can be part of: what follows one may look like more
#: of it, so the run's ends at group edges are tried (``_ibans``).
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+))")
_EDGE = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Length of an IBAN by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
    "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += _LUHN[d] if i % 2 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start, the end at a group edge that the country's length asks
    for; else the longest that passes, for a listed country only the whole run.
    A start that fails does not keep a later one from being tried."""
    done = 0
    for m in _IBAN.finditer(text):
        start, stop = m.start(), m.end(1)
        if start < done:
            continue
        ends = [e.start() for e in _EDGE.finditer(text, m.end(), min(stop + 1, len(text))) if e.start() <= stop]
        sizes = {e: e - start - text.count(" ", start, e) for e in ends}
        fixed = IBAN_LENGTHS.get(text[start:start + 2])
        tried = [e for e in ends if sizes[e] == fixed]
        tried += [e for e in reversed(ends) if sizes[e] >= 15 and (fixed is None or e == stop)]
        found = next((e for e in tried if mod97(text[start:e])), None)
        if found:
            done = found
            yield start, found


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind and start."""
    for s, e in _emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span()
    for s, e in _ibans(text):
        yield "iban", s, e
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", *m.span()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans that reach MIN_SCORE."""
    out = []
    for kind, s, e in propose(text or ""):
        near = f"{text[max(0, s - CONTEXT):s]} {text[e:e + CONTEXT]}".lower()
        hit = any(re.search(rf"\b{w}", near) for w in WORDS[kind])
        score = round(min(1.0, SCORES[kind] + BOOST * hit), 2)
        if score >= MIN_SCORE:
            out.append((kind, s, e, score))
    return out


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by ``[KIND]``; overlapping spans of
    different kinds become one mark that names the first."""
    if not text:
        return text
    out, done = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e, _ in spans(text)):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:] if out else text


def _joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: the counts and digest of the base kinds, all spans joined,
    and their scores in the same order."""
    schema = T.StructType([docs.schema["doc_id"]]
                          + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
                          + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                             T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
            for text in b.column("text"):
                found = spans(text.as_py())
                for k in KINDS:
                    cols[f"n_{k}"].append(sum(x[0] == k for x in found))
                base = _joined([x for x in found if x[0] in BASE_KINDS])
                cols["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                cols["spans"].append(_joined(found))
                cols["scores"].append([x[3] for x in found])
            types = {f"n_{k}": pa.int64() for k in KINDS} | {
                "base_sha256": pa.string(), "spans": pa.string(), "scores": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(v, types[k]) for k, v in cols.items())],
                names=["doc_id", *cols])

    return doc_texts(docs).mapInArrow(scan, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with personal data masked; a column
    ``n_chars`` is brought up to date where the text changed."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([redact_text(t.as_py()) for t in texts], pa.string())

    if "n_chars" not in docs.columns:
        return docs.withColumn("text", masked("text"))
    m = free_name(docs, "_masked")
    new = docs.withColumn(m, masked("text"))
    length = F.when(F.col(m) != F.col("text"), F.char_length(m)).otherwise(F.col("n_chars"))
    return new.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).withColumn("text", F.col(m)).drop(m)


def op2(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    base = [f"n_{k}" for k in BASE_KINDS]
    return found.select("doc_id", *base, "base_sha256", "spans", "n_iban", "n_ssn",
                        F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"))
