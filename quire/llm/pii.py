"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, schemes and identifier
cues; a small deterministic parser at each anchor expands to both sides and
validates what it finds. Runs of digits are their own anchors for network
addresses and card numbers. Spans are code-point offsets, end exclusive.

Beyond the base kinds (email, ip, card, phone) the anchors give ``login`` (user
and password in a URL: ``scheme://user:password@``), ``account`` (an account
number behind a cue: IBAN with its check digits, or 8 to 17 digits) and
``secret`` (a value assigned to a cue such as ``token =``, or a key that begins
as the keys of a service do).

Defined results: a null or empty text has no spans; rows with equal or null
doc_id are searched one by one; a very long run of letters or digits costs time
in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, on_workers

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "secret")
CUES = ("account number", "account no", "acct", "iban", "kontonummer", "numéro de compte", "número de cuenta")
#: Names of a secret that is assigned, and beginnings of keys (fixed values of their issuers).
SECRETS = ("token", "secret", "password", "passwd", "passwort", "mot de passe", "contraseña", "api key", "api_key", "api-key", "apikey",
           "access key", "access_key", "private key", "private_key")
KEYS = ("akia", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "aiza")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@")
_ACCOUNT = re.compile(r"[\s:#=.]{0,3}(?:([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)|([0-9](?:[ -]?[0-9]){7,16}))(?![A-Za-z0-9])")

_ASSIGNED = re.compile(r"""["']?[ \t]{0,3}(?:=|:)>?[ \t]{0,3}(?:"([^"\n]{6,512})"|'([^'\n]{6,512})'|([^\s"'<>,;|]{8,512}))""")
_KEY = re.compile(r"[A-Za-z0-9_-]{16,255}(?![A-Za-z0-9_-])")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
#: Letters of cues, where a text cannot be lowered as a whole.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZÉÚÑ", "abcdefghijklmnopqrstuvwxyzéúñ")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s, kind in (("@", "email"), ("+", "phone"), ("://", "login"), *((c, "account") for c in CUES),
                    *((c, "secret") for c in SECRETS), *((k, "key") for k in KEYS)):
        a.add_word(s, (kind, len(s)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()
_NOT_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account(text: str, at: int) -> tuple[int, int] | None:
    """The account number that begins at ``at``: of an IBAN, which words in
    capitals may follow, the longest run of whole groups with right check digits."""
    m = _ACCOUNT.match(text, at)
    if not m:
        return None
    if not m[1]:
        return m.span(2)
    start, stop = m.span(1)
    while not iban(text[start:stop]):
        stop = text.rfind(" ", start, stop)
        if stop < 0:
            return None
    return start, stop


def assigned(text: str, at: int) -> tuple[int, int] | None:
    """A value assigned to the name before ``at``: quoted, or without blanks, and
    with a digit among letters or of 16 characters without a blank at least."""
    m = _ASSIGNED.match(text, at)
    if not m:
        return None
    value = m[m.lastindex]
    mixed = _DIGIT.search(value) and _LETTER.search(value)
    return m.span(m.lastindex) if mixed or len(value) >= 16 and " " not in value and _DIGIT.search(value) else None


def _key(text: str, at: int, stop: int) -> tuple[int, int] | None:
    """A key of a service: the letters and digits that go on from its beginning."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        return None
    m = _KEY.match(text, stop)
    return (at, m.end()) if m and _DIGIT.search(m[0]) else None


def _small(part: str) -> bool:
    """At most 255, whatever zeros lead."""
    p = part.lstrip("0")
    return len(p) < 3 or len(p) == 3 and p <= "255"


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, in order of their start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or not
    # Lower case as it is, unless a letter grows by it and places would move.
    low = text.lower()
    low = low if len(low) == len(text) else text.translate(_LOWER)
    for end, (kind, size) in _ANCHORS.iter(low):
        at = end - size + 1
        if kind == "email":
            start, low_end = at, free["email"]
            while start > low_end and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out["email"].append((start, m.end()))
                free["email"] = m.end()
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "login":
            m = _LOGIN.match(text, end + 1) if at >= free["login"] else None
            if m:
                out["login"].append((end + 1, m.end() - 1))
                free["login"] = m.end()
        elif kind in ("secret", "key"):
            span = assigned(text, end + 1) if kind == "secret" else _key(text, at, end + 1)
            if span and span[0] >= free["secret"]:
                out["secret"].append(span)
                free["secret"] = span[1]
        else:
            span = account(text, end + 1)
            if span and span[0] >= free["account"]:
                out["account"].append(span)
                free["account"] = span[1]
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):  # leftmost groups of four, none twice
            four = parts[k:k + 4]
            size = len(".".join(four))
            if all(map(_small, four)):
                out["ip"].append((at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    return out


def named(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Every span replaced by its kind; of overlapping spans the first and longest names the place."""
    got, at = [], 0
    for a, b, k in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda s: (s[0], -s[1])):
        if a >= at:
            got += [text[at:a], f"<{k.upper()}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*got, text[at:]])


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
_FOUND_DDL = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [find(t or "") for t in batch.column("text").to_pylist()]
        cols = [[len(r[k]) for r in rows] for k in BASE]
        cols += [[hashlib.sha256(named(r, BASE).encode()).hexdigest() for r in rows], [named(r, KINDS) for r in rows]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(_FOUND)[1:]))], schema=_FOUND)


def spans(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and all spans of every row."""
    return id_text(docs).mapInArrow(_search, _FOUND_DDL)


def _redact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t is None else redact(t, find(t)) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the spans in ``text`` replaced by their kinds
    (and ``n_chars``, if there is one, counted anew)."""
    on_workers(docs.sparkSession)
    out = docs.mapInArrow(_redact_rows, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))
