"""Personal data by offset-preserving deobfuscation.

Transducers rewrite a text step by step (look-alike letters, spelled digits, disguised at signs and dots); each keeps,
for every letter it writes, the span of source letters it stands for. Detectors for e-mail addresses, IPv4 addresses,
payment cards and phone numbers run over the text as it is (the base spans) and over the rewritten one; what the second
run finds under a disguise is mapped back to source letters and added. Base spans always stay.

Defined results: a null text counts as empty and has no spans; rows are independent, so ties, repeated rows and other
columns don't matter; texts of any length are scanned whole, in linear time; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from sealfold.llm import wordhash
from sealfold.llm.common import documents, in_arrow, replaced, row_texts, with_rows
from sealfold.llm.token_counts import texts

KINDS = ("email", "ip", "card", "phone")

# --- detectors -------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that starts inside a run of digits would have started before it, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers that stand in a text undisguised, in order; kind is an index of KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- transducers -----------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones. Fixed values.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυ", "aeopcyxijsdhlABEKMHOPCTXIJSABEZHIKMNOPTYXoivpu", strict=True))
#: Spelled digits in the corpus's four languages. Fixed values.
DIGIT_WORDS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0", "ein": "1"}
#: What stands for an at sign or a dot in the four languages. Fixed values.
AT_WORDS, DOT_WORDS = ("at", "arroba", "ät"), ("dot", "punkt", "punto", "point")
_FORMS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = r"[\s,-]{1,3}"
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_RUN = rf"(?:{_FORMS})(?:{_GAP}(?:(?:{_DOTS})\s+)?(?:{_FORMS}))"
#: Four spelled digits in a row are a number, or two of them next to figures; fewer are prose.
_SPELLED = re.compile(rf"\b(?:(plus)\s+)?({_RUN}{{3,}})\b|(?<=[0-9][\s,-])()({_RUN}+)\b|\b()({_RUN}+)(?=[\s,-][0-9])", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?:{_FORMS})\b|{_DOTS}", re.IGNORECASE)
_DOT = rf"(?:\s{{0,3}}[\[({{<]\s?(?:{_DOTS}|\.)\s?[\])}}>]\s{{0,3}}|\s{{1,3}}(?:{_DOTS})\s{{1,3}})"
_DISGUISED_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])", re.IGNORECASE)
_DISGUISED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])\s{0,3}[\[({<]\s?(?:at|arroba|ät|@)\s?[\])}>]\s{0,3}(?=[A-Za-z0-9])", re.IGNORECASE)
#: A bare "at" is prose unless a domain with a disguised dot follows.
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s{{1,3}}(?:{_ATS})\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z])", re.IGNORECASE)
_ODD = re.compile("[^\x00-\xff]|[\x85\xa0\xad\xb2\xb3\xb9]")
_BRACKET = re.compile(rf"[\[({{<]\s?(?:{_ATS}|{_DOTS}|@|\.)\s?[\])}}>]")
#: A bare dot word matters behind a bare at word alone; prose is full of the one, and lacks the other.
_BARE = re.compile(rf"\s(?:{_ATS})\s{{1,3}}[a-z0-9-]{{1,63}}\s{{1,3}}(?:{_DOTS})\s")
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(9, 14), *range(28, 33), ord(","), ord("-")]] = True
_HINT_WORDS = [*DIGIT_WORDS, *DOT_WORDS]


def may_be_disguised(found: list[str]) -> list[bool]:
    """Whether each text may hold what a transducer rewrites; what this rules out, none of them would touch."""
    low = [t.lower() for t in found]
    # What looks odd is looked for in the text as it is: some odd letters have a plain lower case.
    out = [bool("dot" in t or _BRACKET.search(t) or _ODD.search(own) or _BARE.search(t)) for own, t in zip(found, low, strict=True)]
    known = wordhash.words([w.encode() for w in _HINT_WORDS])[0]
    for first, part in wordhash.chunks([t.encode() for t in low]):
        h, doc = wordhash.words(part, space=_BETWEEN)
        hit = np.isin(h, known)
        # Spelled digits in a row: two words of a number side by side.
        for i in np.unique(doc[1:][hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])]):
            out[first + i] = True
    return out


class Tape:
    """A rewritten text and, for each of its letters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text, in order and apart from each other. All letters of a replacement stand for its whole span."""
        if not edits:
            return
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:s], new]
            starts += [*self.starts[at:s], *[self.starts[s] if s < e else 0] * len(new)]
            ends += [*self.ends[at:s], *[self.ends[e - 1] if s < e else 0] * len(new)]
            at = e
        self.text, self.starts, self.ends = "".join(parts), starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _plain(c: str) -> str:
    """The plain form of one letter: '' for invisible ones, itself if it has none."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd" or c == "−":
        return "-"
    if kind in ("Nd", "No") and (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


def homoglyphs(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), new) for m in _ODD.finditer(tape.text) if (new := _plain(m[0])) != m[0]])


def spelled_digits(tape: Tape) -> None:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        run = next(i for i in (2, 4, 6) if m[i] is not None)
        parts = list(_SPELLED_PART.finditer(tape.text, m.start(run), m.end(run)))
        if m[1]:
            edits.append((m.start(1), parts[0].start(), "+"))
        for p, after in zip(parts, [*parts[1:], None], strict=True):
            edits.append((p.start(), p.end(), DIGIT_WORDS.get(p[0].lower(), ".")))
            if after:
                edits.append((p.end(), after.start(), ""))
    tape.rewrite(edits)


def at_and_dot(tape: Tape) -> None:
    """At signs first: what makes a bare "at" one is the disguised dot behind it."""
    found = {m.span() for p in (_DISGUISED_AT, _BARE_AT) for m in p.finditer(tape.text)}
    tape.rewrite([(s, e, "@") for s, e in sorted(found)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _DISGUISED_DOT.finditer(tape.text)])


TRANSDUCERS = (homoglyphs, spelled_digits, at_and_dot)


def deobfuscate(text: str) -> Tape:
    tape = Tape(text)
    for step in TRANSDUCERS:
        step(tape)
    return tape


def spans(text: str, hint: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and those that the transducers add, as (start, kind, end) in source code points. Without ``hint`` no transducer is tried."""
    base = base_spans(text)
    if not hint:
        return base, []
    tape = deobfuscate(text)
    if tape.text == text:
        return base, []
    held = set(base)
    added = []
    for start, kind, end in base_spans(tape.text):
        s, e = tape.source(start, end)
        if text[s:e] != tape.text[start:end] and (s, kind, e) not in held and not any(k == kind and b <= s and e <= f for b, k, f in base):
            added.append((s, kind, e))
    return base, sorted(set(added))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are replaced together."""
    out, at, last = [], 0, -1
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2])):
        if s < last:  # goes on where the span before has not ended
            last = at = max(last, e)
            continue
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = last = e
    return "".join([*out, text[at:]])


# --- DataFrame operators ---------------------------------------------------------------------------------------------


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """row (all columns of docs) and pii, an array of (kind, start, end, disguised)."""

    rows = with_rows(docs)

    def run(batches):
        for part, found in row_texts(batches):
            got = [spans(t, h) for t, h in zip(found, may_be_disguised(found), strict=True)]
            out = [[{"kind": KINDS[k], "start": s, "end": e, "disguised": d} for d, own in ((False, base), (True, added)) for s, k, e in own] for base, added in got]
            yield pa.RecordBatch.from_arrays([part, pa.array(out, _SPAN)], ["row", "pii"])

    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("disguised", BooleanType())]))
    return in_arrow(rows, run, StructType([*rows.schema, StructField("pii", kind)]))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, if there, counted again. Null texts stay null."""

    counted = {"n_chars": "long"} if "n_chars" in docs.columns else {}
    rows = with_rows(docs.withColumns({c: F.col(c).cast(t) for c, t in counted.items()}))

    def run(batches):
        for part, found in row_texts(batches):
            missing = part.field("text").is_null().to_pylist()
            out: list[str | None] = []
            for t, h, m in zip(found, may_be_disguised(found), missing, strict=True):
                base, added = spans(t, h)
                out.append(None if m else redacted(t, base + added) if base or added else t)
            new = {"text": pa.array(out, part.type.field("text").type)} | {c: pa.array([None if t is None else len(t) for t in out], pa.int64()) for c in counted}
            yield pa.RecordBatch.from_arrays([replaced(part, **new)], ["row"])

    kind = dict(docs.dtypes)
    return in_arrow(rows, run, rows.schema).select(*[F.col(f"row.`{c}`").cast(kind[c]).alias(c) if c in ("text", "n_chars") else F.col(f"row.`{c}`") for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for part, found in texts(batches):
            got = [spans(t, h) for t, h in zip(found, may_be_disguised(found), strict=True)]
            columns = [part.column(0)]
            columns += [pa.array([sum(k == i for _, k, _ in base) for base, _ in got], pa.int64()) for i in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string()))
            columns.append(pa.array([joined(base + added) for base, added in got], pa.string()))
            columns.append(pa.array([len(added) for _, added in got], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [n.split()[0] for n in schema])

    schema = ["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_disguised long"]
    return in_arrow(docs, run, ", ".join(schema))
