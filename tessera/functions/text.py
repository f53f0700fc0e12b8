"""Column expressions over text: counts, normal forms, hashes, scores, masks, URLs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Words -----------------------------------------------------------------------


def words(text: Text) -> Column:
    return F.filter(F.split(col(text), r"[ \t\n\r]+"), lambda w: w != "")


def tokens(text: Text) -> Column:
    """Lower case, runs of letters and digits; no stemming."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_count(text: Text, longer_than: int = 0) -> Column:
    return F.size(F.filter(words(text), lambda w: F.length(w) > longer_than))


def token_estimate(text: Text) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(col(text)) / 4)


def reading_minutes(text: Text, per_minute: int = 200) -> Column:
    return F.ceil(word_count(text) / per_minute)


# Normal forms -----------------------------------------------------------------


def normal_space(text: Text) -> Column:
    """Control characters go, dashes and quotes become plain, runs of white space one space."""
    x = F.regexp_replace(col(text), "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f​-‏﻿]", "")
    x = F.translate(x, "‐‑‒–—‘’“”«»", "-----''\"\"\"\"")
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


#: Letters and digits with one plain form.
ARABIC_FROM, ARABIC_TO = "أإآٱى٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ااااي01234567890123456789"
TASHKEEL = "[ً-ْٰ]"
INVISIBLE = "[ـ​-‏‪-‮⁦-⁩﻿]"


def arabic_normal(text: Text, strip_tashkeel: bool = True) -> Column:
    x = F.translate(F.regexp_replace(col(text), INVISIBLE, ""), ARABIC_FROM, ARABIC_TO)
    x = F.regexp_replace(x, TASHKEEL, "") if strip_tashkeel else x
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def ocr_clean(text: Text) -> Column:
    """Dots that stand alone, lengthening strokes and marks without a letter go."""
    x = F.regexp_replace(col(text), "ـ+", "")
    x = F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}ً-ْ]){TASHKEEL}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?<=\s)[.·•](?=\s)", ""), r"[ \t]+", " "))


def dedup_key(text: Text, length: int = 200) -> Column:
    """The first characters of the text in lower case, without signs."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N} \t\n\r]", ""), r"[ \t\n\r]+", " ")), 1, length)


def content_hash(text: Text) -> Column:
    return F.sha2(col(text), 256)


# Languages and scripts ---------------------------------------------------------


def letters_of(text: Text, kind: str) -> Column:
    return F.length(F.regexp_replace(col(text), f"[^{kind}]", ""))


LATIN, ARABIC = "A-Za-zÀ-ÖØ-öø-ÿ", "؀-ۿݐ-ݿ"


def script_language(text: Text, share: float = 0.7) -> Column:
    """ar or fr where the script has more than its share of letters, else mixed; fr without letters."""
    a, b = letters_of(text, ARABIC), letters_of(text, LATIN)
    return F.when(a + b == 0, "fr").when(a / (a + b) > share, "ar").when(b / (a + b) > share, "fr").otherwise("mixed")


def script_language_strict(text: Text, least: int = 50, share: float = 0.3) -> Column:
    """Null under `least` letters; mixed only where both scripts have more than the share."""
    a, b = letters_of(text, ARABIC), letters_of(text, LATIN)
    return F.when(a + b >= least, F.when((a > share * (a + b)) & (b > share * (a + b)), "mixed").when(a >= b, "ar").otherwise("fr"))


# Quality ------------------------------------------------------------------------


#: The heading of a scanned gazette, white space, and what odd sequences of OCR look like.
GAZETTE = "Imprimerie Officielle de la République Tunisienne"
SPACE = "[ \\t\\n\\r\\f\\x{0B}\\x{A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
OTHER = SPACE.replace("[", "[^")
SINGLE_LETTERS = f"[\\x{{600}}-\\x{{6FF}}]{SPACE}[\\x{{600}}-\\x{{6FF}}]{SPACE}[\\x{{600}}-\\x{{6FF}}]"
MIXED_LETTERS = f"[\\x{{600}}-\\x{{6FF}}]{SPACE}[A-Z]{SPACE}[\\x{{600}}-\\x{{6FF}}]"
SIGNS = r"[*#$%&!^|\\~<>{}=]"
CORRUPT = 0.6


#: By code point: white space, a letter of Arabic's first block, a capital, a digit, an odd sign.
SPACES, ARABIC_BLOCK, CAPITALS, DIGITS, ODD = 1, 2, 4, 8, 16


@functools.cache
def kinds() -> np.ndarray:
    found = np.zeros(0x110000, np.uint8)
    found[[*b" \t\n\r\f\x0b", 0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACES
    found[0x600:0x700] |= ARABIC_BLOCK
    found[ord("A") : ord("Z") + 1] |= CAPITALS
    found[ord("0") : ord("9") + 1] |= DIGITS
    found[[ord(c) for c in r"*#$%&!^|\~<>{}="]] |= ODD
    return found


def sequences(kind: np.ndarray, middle: int) -> int:
    """How many separate Arabic, space, `middle`, space, Arabic there are, found from the left as regular expressions find them."""
    if len(kind) < 5:
        return 0
    space, arabic = kind & SPACES > 0, kind & ARABIC_BLOCK > 0
    at = np.flatnonzero(arabic[:-4] & space[1:-3] & (kind[2:-2] & middle > 0) & space[3:-1] & arabic[4:])
    # Those that overlap begin two apart, four where a capital is between; of such a row every third, or second, is free.
    apart, free = (2, 3) if middle == ARABIC_BLOCK else (4, 2)
    rows = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(at) != apart, [True]]))) if len(at) else np.zeros(0, int)
    return int((-(-rows // free)).sum())


def _corruption(text: str) -> tuple[int, ...]:
    """Code points, tokens, tokens of one or two characters, those of one to three digits, sequences of single letters and of mixed ones, odd signs."""
    kind = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.diff(np.concatenate([[0], (kind & SPACES == 0).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size, digits = end - start, np.concatenate([[0], np.cumsum(kind & DIGITS > 0)])
    return len(kind), len(size), int((size <= 2).sum()), int(((size <= 3) & (digits[end] - digits[start] == size)).sum()), sequences(kind, ARABIC_BLOCK), sequences(kind, CAPITALS), int(np.count_nonzero(kind & ODD))


COUNTED = ("n_chars", "tokens", "short", "numbers", "single", "mixed", "odd")


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in COUNTED]))
def corruption_counts(texts: pd.Series) -> pd.DataFrame:
    """What corruption_score weighs, each text read once; null counts as empty."""
    return pd.DataFrame([_corruption(x or "") for x in texts], columns=list(COUNTED), dtype="int32")


def corruption_score(text: Text, least: int = 100) -> Column:
    """0 to 1, corrupt from CORRUPT on: a gazette's heading, shares of tokens of one or two characters and of
    short numbers (in texts of over 50 tokens), sequences of single letters, and the share of odd signs. 0 for short texts.

    Counts come from one pass over the text's code points in Arrow batches."""
    x = col(text)
    counts = corruption_counts(x)
    n = counts["tokens"]
    share = lambda k: F.when(n > 50, k / n).otherwise(0.0)
    step = lambda value, a, x1, b, x2: F.when(value > a, x1).when(value > b, x2).otherwise(0.0)
    score = (
        F.when(F.contains(x, F.lit(GAZETTE)), 0.5).otherwise(0.0)
        + step(share(counts["short"]), 0.65, 0.35, 0.50, 0.20)
        + step(counts["single"], 20, 0.30, 10, 0.15)
        + step(counts["odd"] / F.greatest(counts["n_chars"], F.lit(1)), 0.025, 0.20, 0.015, 0.10)
        + step(counts["mixed"], 15, 0.25, 8, 0.15)
        + F.when(share(counts["numbers"]) > 0.12, 0.15).otherwise(0.0)
    )
    return F.when(F.coalesce(F.length(x), F.lit(0)) < least, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 2))


# Trigrams -----------------------------------------------------------------------


def trigrams(text: Text) -> Column:
    """The set of three-letter windows of each word, padded with two blanks before and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


# Masks and numbers ----------------------------------------------------------------


def mask_email(x: Text) -> Column:
    return F.regexp_replace(col(x), r"^(.)[^@]*(@.*)$", "$1***$2")


def mask_token(x: Text, kept: int = 4) -> Column:
    return F.when(F.length(col(x)) <= 2 * kept, "***").otherwise(F.concat(F.left(col(x), F.lit(kept)), F.lit("***"), F.right(col(x), F.lit(kept))))


def mask_hash(x: Text) -> Column:
    """The first 12 signs; of fewer than 15, or of null, nothing."""
    return F.when(F.length(col(x)) >= 15, F.concat(F.left(col(x), F.lit(12)), F.lit("***"))).otherwise("***")


def mask_phone(x: Text) -> Column:
    """The first and last four signs; of fewer than eight, or of null, nothing."""
    return F.when(F.length(col(x)) >= 8, F.concat(F.left(col(x), F.lit(4)), F.lit("***"), F.right(col(x), F.lit(4)))).otherwise("***")


def phone_e164(x: Text, country: str = "216", local: str = "[2-9][0-9]{7}") -> Column:
    """+country and digits from the usual ways to write a number; what is none comes back without other signs."""
    n = F.regexp_replace(col(x), r"[^0-9+]", "")
    return F.when(n.rlike(f"^{local}$"), F.concat(F.lit(f"+{country}"), n)).when(n.rlike(f"^00{country}{local}$"), F.concat(F.lit("+"), F.substring(n, 3, 99))).when(n.rlike(f"^{country}{local}$"), F.concat(F.lit("+"), n)).otherwise(n)


# URLs ------------------------------------------------------------------------------

TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def normal_url(url: Text, dropped: str = TRACKING) -> Column:
    """Without fragment, tracking parameters, closing slash; the scheme and host in lower case."""
    x = F.regexp_replace(col(url), r"#.*$", "")
    x = F.regexp_replace(x, rf"([?&])(?:{dropped})=[^&]*", "$1")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    host = F.lower(F.regexp_extract(x, r"^([A-Za-z]+://[^/?]*)", 1))
    return F.regexp_replace(F.concat(host, F.substr(x, F.length(host) + 1)), r"/$", "")


def url_hash(url: Text) -> Column:
    return F.sha2(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(url), r"#.*$", ""), r"([?&])utm_(?:source|medium|campaign)=[^&]*", "$1"), r"&+", "&"), r"[?&]+$", ""), 256)


def host_of(url: Text) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z]+://([^/?#:]+)", 1))


def path_of(url: Text) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)


def in_scope(url: Text, host: str, prefix: str) -> Column:
    """The host's own pages at or below the prefix, on a boundary of the path."""
    path, stem = path_of(url), prefix.rstrip("/")
    return (host_of(url) == host) & ((path == stem) | path.startswith(f"{stem}/"))
