"""Text functions: index tokens, word bounds, folding, subsequences, boosts. Columns unless said otherwise."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest index token in bytes.
TOKEN_BYTES = 40
#: Letters that fold to more than one letter or have no decomposition.
EXPANSIONS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
SINGLES = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "’": "'", "‘": "'"}
#: Cyrillic and Greek letters in Latin ones.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "i", "є": "ie", "ґ": "g",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
_SPACE = r"[ \t\r\n]+"


def _latin() -> dict[str, str]:
    """Latin letters with marks, to their base letter."""
    out = dict(SINGLES)
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            out[chr(code)] = base
    return out


LATIN = _latin()


def _scripts() -> dict[str, str]:
    """Cyrillic and Greek letters in both cases, Greek also with marks, to Latin letters."""
    out = {}
    for low, latin in (CYRILLIC | GREEK).items():
        out[low] = latin
        if len(low.upper()) == 1:
            out[low.upper()] = latin.capitalize()
    for code in range(0x0386, 0x03CF):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base in out:
            out.setdefault(chr(code), out[base])
    return out


SCRIPTS = _scripts()
_OTHER = r"[\u0370-\u04FF]"


def fold(c: Column) -> Column:
    """Latin letters without marks, Cyrillic and Greek in Latin letters; other scripts stay as they are. Texts without such letters skip that part."""
    for a, b in EXPANSIONS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, "".join(LATIN), "".join(LATIN.values()))
    single = {a: b for a, b in SCRIPTS.items() if len(b) == 1}
    other = F.translate(c, "".join(single), "".join(single.values()))
    for a, b in SCRIPTS.items():
        if len(b) > 1:
            other = F.replace(other, F.lit(a), F.lit(b))
    return F.when(c.rlike(_OTHER), other).otherwise(c)


def fold_text(s: str) -> str:
    """fold() of one string, on the driver."""
    for a, b in EXPANSIONS.items():
        s = s.replace(a, b)
    return s.translate(str.maketrans(LATIN | SCRIPTS))


def index_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of at most TOKEN_BYTES bytes."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= TOKEN_BYTES))


def index_positions(c: Column) -> Column:
    """All runs of letters and digits, also overlong ones, so that places in the array are positions."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sanitize(c: Column) -> Column:
    """Folded, lower-cased, runs of white space as one space."""
    return F.regexp_replace(F.lower(fold(c)), _SPACE, " ")


def ascii_words(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\r\n\f]+"), lambda t: t != "")


def possessive(names: Column) -> Column:
    """Each name; after one with ``'s`` also without it, and with ``s`` in its place."""
    return F.flatten(F.transform(names, lambda n: F.when(F.contains(n, F.lit("'s")), F.array(n, F.replace(n, F.lit("'s"), F.lit("")), F.replace(n, F.lit("'s"), F.lit("s")))).otherwise(F.array(n))))


def subsequences(tokens: Column) -> Column:
    """All contiguous runs of an array, by start and then end."""
    n = F.size(tokens)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.slice(tokens, i, j - i + 1))))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<array<string>>"))


def boost(phrase: Column) -> Column:
    """1.05 to the power of the bytes, three times that where fewer than three characters are neither digits nor space but some are."""
    loose = F.length(F.regexp_replace(phrase, r"[^\p{N}\s]", ""))
    return F.pow(F.lit(1.05), F.octet_length(phrase)) * F.when((F.length(phrase) - loose < 3) & (loose > 0), 3.0).otherwise(1.0)


def blank(phrase: Column) -> Column:
    """Only white space and ASCII punctuation."""
    return F.regexp_replace(phrase, r"[\s!-/:-@\[-`{-~]", "") == ""


def split_csv(c: Column) -> Column:
    return F.split(c, ",")


def parse_id(c: Column) -> Column:
    """Decimal digits as a 64-bit id, or null."""
    return F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))


# ---- the same for one query string, on the driver -------------------------------


def word_bounds(query: str) -> list[str]:
    """Segments between Unicode word boundaries, trimmed, none empty. Punctuation stays."""
    return [s for s in (p.strip() for p in regex.split(r"(?V1w)\b", query)) if s]


def runs(tokens: list[str]) -> list[list[str]]:
    return [tokens[i : j + 1] for i in range(len(tokens)) for j in range(i, len(tokens))]


def is_blank(phrase: str) -> bool:
    return all(c.isspace() or (c.isascii() and c.isprintable() and not c.isalnum()) for c in phrase)


def boost_of(phrase: str) -> float:
    loose = sum(c.isspace() or unicodedata.category(c)[0] == "N" for c in phrase)
    return 1.05 ** len(phrase.encode()) * (3.0 if loose > 0 and len(phrase) - loose < 3 else 1.0)
