r"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each text once and finds anchors: at-signs,
schemes (``://``), plus signs, digits and identifier cues in any case (``account``,
``IBAN``, ``Customer ID`` ...). A local parser for each anchor expands it to both sides and validates what
it finds: domain labels, octets, Luhn and mod-97 check digits, digit counts.

Kinds: ``email``, ``ip``, ``card``, ``phone`` are the base kinds. ``address`` (an
URL with user info, ``scheme://user[:pw]@host``) and ``account`` (an identifier
with a digit after a cue; IBANs must pass mod 97) are added by the method.

Defined results: null or empty text has no spans; offsets are code points, end
exclusive; a text is scanned whole whatever its length; repeated rows are judged
each for itself; an empty table gives an empty table; columns of the input that
clash with an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
CUES = ("account", "acct", "iban", "passport", "customer id", "member id", "user id", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_USERINFO = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]+[A-Za-z0-9]")
_AFTER_CUE = re.compile(r"(?:[ ]?(?:no|nr|number|num)\b\.?)?[ ]?[:#=]?[ ]?([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*)", re.I)
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_NON_DIGIT = re.compile(r"[^0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def automaton():
    """Anchors of lower-cased texts."""
    a = ahocorasick.Automaton()
    a.add_word("@", (1, "email"))
    a.add_word("+", (1, "phone"))
    a.add_word("://", (3, "address"))
    for d in "0123456789":
        a.add_word(d, (1, "digit"))
    for cue in CUES:
        a.add_word(cue, (len(cue), "account"))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """text in lower case with the same offsets: where full lower-casing makes it longer, only A to Z are changed."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def iban(s: str) -> bool:
    return bool(_IBAN.fullmatch(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``: 6 to 34 letters and digits, one digit at least, until the first word without a digit."""
    m = _AFTER_CUE.match(text, at)
    if not m:
        return None
    start, end = m.span(1)
    ends = [start + w.end() for w in re.finditer(r"[A-Za-z0-9]+", text[start : min(end, start + 50)])]
    if valid := [e for e in ends if iban(re.sub(r"[ -]", "", text[start:e]))]:
        return start, valid[-1]
    for w in re.finditer(r"[A-Za-z0-9]+", text[start:end]):
        if not any(c.isdigit() for c in w[0]):
            end = start + max(w.start() - 1, 0)
            break
    s = re.sub(r"[ -]", "", text[start:end])
    if not 6 <= len(s) <= 34 or not any(c.isdigit() for c in s):
        return None
    if _IBAN.fullmatch(s) and not iban(s):
        return None
    return start, end


def find(text: str | None, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed. Within a kind spans do not overlap."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    mail = ip = card = phone = account = 0
    for last, (n, what) in anchors.iter(lowered(text)):
        at = last - n + 1
        if what == "digit":
            if at >= card:
                m = _RUN.match(text, at)
                card = m.end()
                if card - at >= 12 and 12 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                    out.append((at, card, "card"))
            if at >= ip:
                m = _DOTTED.match(text, at)
                ip = m.end()
                if ip - at >= 7 and len(parts := m[0].split(".")) >= 4:
                    place = at
                    for i in range(0, len(parts) - 3, 4):
                        end = place + sum(map(len, parts[i : i + 4])) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                            out.append((place, end, "ip"))
                        place = end + 1
        elif what == "email":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail = m.end()
                out.append((start, mail, "email"))
        elif what == "phone":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                    out.append((at, phone, "phone"))
        elif what == "address":
            start = at
            while start and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (m := _USERINFO.match(text, at + 3)):
                out.append((start, m.end(), "address"))
        elif at >= account and not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
            if found := _account(text, last + 1):
                account = found[1]
                out.append((*found, "account"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    anchors = automaton()
    for texts in batches:
        yield pd.Series([[f"{k}:{a}:{b}" for a, b, k in find(t, anchors)] for t in texts], dtype=object)


def pii_spans(df: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """df with an array of ``kind:start:end`` for each row. One pass, no shuffle."""
    return df.withColumn(out_col, _spans(F.col(text_col)))


@F.pandas_udf(T.StringType())
def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    anchors = automaton()
    for texts in batches:
        yield pd.Series([mask(t, find(t, anchors)) for t in texts], dtype=object)


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Spans become ``<KIND>``; of overlapping spans the first one names the whole stretch."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data replaced in text_col; texts without any stay as they are (null stays null)."""
    return df.withColumn(text_col, _masked(F.col(text_col)))


def op8_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: F.substring_index(s, ":", 1).isin(*BASE_KINDS))
    n = lambda kind: F.size(F.filter("pii_spans", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, BASE_KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("pii_spans", ",").alias("spans"))
