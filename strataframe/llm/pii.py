"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import ship, texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = 4

# The local part is read backwards from its @ sign, so that long runs of letters stay linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: the run before it would have matched as well.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

# Prior score of each kind, and words nearby that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
RAISES = {
    "email": ("mail", "contact", "write", "reply"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security", "insurance")}
LOWERS = {
    "email": ("example",), "ip": ("version", "release", "section"), "card": ("order", "invoice", "serial"),
    "phone": ("order", "invoice", "serial"), "iban": ("serial",), "ssn": ("order", "part", "serial")}
_SCORING = {k: (re.compile(r"\b(?:" + "|".join(RAISES[k]) + ")", re.I), re.compile(r"\b(?:" + "|".join(LOWERS[k]) + ")", re.I))
            for k in KINDS}

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of bank account numbers: first four characters last, letters as 10 to 35, remainder 1."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while m := _DOMAIN.search(text, at):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind as listed, then by start."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int, reach: int) -> float:
    near = text[max(0, start - reach):start] + " " + text[end:end + reach]
    raises, lowers = _SCORING[kind]
    return min(1.0, max(0.0, PRIOR[kind] + 0.3 * bool(raises.search(near)) - 0.3 * bool(lowers.search(near))))


def find_spans(text: str, reach: int = 40, extra_score: float = 0.5) -> list[dict]:
    """All spans of a text; kinds beyond the first four need `extra_score`."""
    found = []
    for kind, start, end in _proposed(text):
        score = _score(text, kind, start, end, reach)
        if kind in KINDS[:BASE_KINDS] or score >= extra_score:
            found.append({"kind": kind, "start": start, "end": end, "score": score})
    return found


def redact(text: str, spans: list[dict]) -> str:
    """The text with spans replaced by their kind; overlapping spans become one, named by the first."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done:s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join(out) + text[done:]


def _batches(batches: Iterator[pa.RecordBatch], text: str, redacted: bool, reach: int, extra_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(text).to_pylist()
        spans = [find_spans(t, reach, extra_score) if t else [] for t in values]
        columns = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(spans, _SPANS_ARROW)]
        names = [*batch.schema.names, "_spans"]
        if redacted:
            columns.append(pa.array([redact(t, s) if s else t for t, s in zip(values, spans)], pa.string()))
            names.append("_redacted")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40,
               extra_score: float = 0.5) -> DataFrame:
    """(id, spans) of every row; offsets count code points, the end is exclusive.

    Emails, addresses of hosts, card numbers (Luhn) and phone numbers are always kept, with a score
    that words within `reach` characters raise or lower. Bank accounts (mod 97) and social security
    numbers need a score of `extra_score`. Null and empty texts have no spans; repeated rows are
    treated one by one; an empty table gives no rows; other columns are not read. Runs in one pass
    without a shuffle, and time is linear in the length of a text.
    """
    rows = texts(df, id_col, text_col)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _text string, _spans {SPANS}"
    run = partial(_batches, text="_text", redacted=False, reach=reach, extra_score=extra_score)
    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_spans").alias("spans"))


def redact_pii(df: DataFrame, text_col: str = "text", reach: int = 40, extra_score: float = 0.5) -> DataFrame:
    """The rows with every span of `text_col` replaced by its kind in brackets; null stays null."""
    ship(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    run = partial(_batches, text=text_col, redacted=True, reach=reach, extra_score=extra_score)
    done = df.mapInArrow(run, f"{fields}, _spans {SPANS}, _redacted string")
    return done.select(*[F.col("_redacted").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
