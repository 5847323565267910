"""Text clean-up and splitting as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

# Tone mark placement in Vietnamese, old form to new form.
TONE_PAIRS = {
    "òa": "oà", "Òa": "Oà", "ÒA": "OÀ",
    "óa": "oá", "Óa": "Oá", "ÓA": "OÁ",
    "ỏa": "oả", "Ỏa": "Oả", "ỎA": "OẢ",
    "õa": "oã", "Õa": "Oã", "ÕA": "OÃ",
    "ọa": "oạ", "Ọa": "Oạ", "ỌA": "OẠ",
    "òe": "oè", "Òe": "Oè", "ÒE": "OÈ",
    "óe": "oé", "Óe": "Oé", "ÓE": "OÉ",
    "ỏe": "oẻ", "Ỏe": "Oẻ", "ỎE": "OẺ",
    "õe": "oẽ", "Õe": "Oẽ", "ÕE": "OẼ",
    "ọe": "oẹ", "Ọe": "Oẹ", "ỌE": "OẸ",
    "ùy": "uỳ", "Ùy": "Uỳ", "ÙY": "UỲ",
    "úy": "uý", "Úy": "Uý", "ÚY": "UÝ",
    "ủy": "uỷ", "Ủy": "Uỷ", "ỦY": "UỶ",
    "ũy": "uỹ", "Ũy": "Uỹ", "ŨY": "UỸ",
    "ụy": "uỵ", "Ụy": "Uỵ", "ỤY": "UỴ",
}

# What cleaning drops, with and without punctuation kept.
DROP_KEEP_PUNCT = r"(?U)[^\p{IsLatin}\p{IsPunctuation}0-9\s]+"
DROP_NO_PUNCT = r"(?U)[^\p{IsLatin}0-9\s]+"

# The characters stripped from the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Words are runs of word characters or runs of other non-spaces.
WORD = r"(?U)\w+|[^\w\s]+"

# Fixed value: the published byte-level split of contractions, letters, digits, signs and spaces.
BYTE_LEVEL_PIECE = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The only characters that can make a text differ from its NFC form: marks,
# conjoining jamo, characters the JVM does not know yet, and characters that
# normalisation always replaces. Precomposed accents are not among them, and
# the leading range lets the scan pass quickly over common Latin text.
MAY_NOT_BE_NFC = (
    r"[\x{300}-\x{10FFFF}&&[\p{M}\p{Cn}"
    r"\x{374}-\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}-\x{B5D}\x{F43}-\x{F69}"
    r"\x{1160}-\x{11FF}\x{1F71}-\x{2001}\x{2126}-\x{212B}\x{2329}-\x{232A}\x{2ADC}\x{F900}-\x{FAD9}"
    r"\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D164}\x{1D1BB}-\x{1D1C0}\x{2F800}-\x{2FA1D}"
    r"]]"
)


# Rows of text that Python holds as strings at a time.
TEXTS_AT_ONCE = 64


def _nfc_udf():
    at_once = TEXTS_AT_ONCE

    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        import unicodedata

        parts = [pa.array([], pa.string())]
        for lo in range(0, len(texts), at_once):
            some = texts.slice(lo, at_once)
            if some.null_count == len(some):
                parts.append(pa.nulls(len(some), pa.string()))
            else:
                done = [t if t is None else unicodedata.normalize("NFC", t) for t in some.to_pylist()]
                parts.append(pa.array(done, pa.string()))
        return pa.concat_arrays(parts)

    return nfc


def nfc(text: Column) -> Column:
    """Unicode NFC. Only rows that may change are sent to Python."""
    return F.coalesce(_nfc_udf()(F.when(text.rlike(MAY_NOT_BE_NFC), text)), text)


def clean_charset(text: Column, keep_punct: bool = True) -> Column:
    """Drop all but Latin letters, ASCII digits, white space and punctuation.

    Punctuation is the Unicode class, so symbols such as ``$`` and ``+`` go.
    """
    return F.regexp_replace(text, DROP_KEEP_PUNCT if keep_punct else DROP_NO_PUNCT, "")


def normalize_tone(text: Column) -> Column:
    """Move Vietnamese tone marks to the second vowel of oa, oe and uy."""
    moved = text
    for old, new in TONE_PAIRS.items():
        moved = F.replace(moved, F.lit(old), F.lit(new))
    first = "".join(dict.fromkeys(k[0] for k in TONE_PAIRS))
    second = "".join(dict.fromkeys(k[1] for k in TONE_PAIRS))
    present = rf"[\x{{80}}-\x{{FFFF}}&&[{first}]][{second}]"
    return F.when(text.rlike(present), moved).otherwise(text)


def strip(text: Column) -> Column:
    """Drop white space at both ends, control separators included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_text(text: Column, strip_ends: bool = True, keep_punct: bool = True) -> Column:
    """NFC, character filter, tone placement, and strip, in this order."""
    cleaned = normalize_tone(clean_charset(nfc(text), keep_punct))
    return strip(cleaned) if strip_ends else cleaned


def pretokenize(text: Column, lowercase: bool = False) -> Column:
    """Split into words and runs of punctuation."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(WORD), F.lit(0))


def byte_level_pieces(text: Column) -> Column:
    """Split for byte-level encoding; the pieces concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(BYTE_LEVEL_PIECE), F.lit(0))


def join_word_pieces(tokens: Column, prefix: str = "##") -> Column:
    """Join tokens with spaces and glue continuation pieces to what precedes."""
    return F.replace(F.array_join(tokens, " "), F.lit(" " + prefix), F.lit(""))


def join_byte_pieces(hex_tokens: Column) -> Column:
    """Text of byte-level tokens given as hex strings."""
    return F.decode(F.unhex(F.array_join(hex_tokens, "")), "UTF-8")


def register_sql(spark: SparkSession) -> None:
    """Make ``nfc(text)`` and ``clean_text(text)`` callable from Spark SQL.

    The second is a SQL function over built-ins and the first, so it is inlined
    into the plan of the query that calls it.
    """

    def quoted(text: str) -> str:
        return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"

    spark.udf.register("nfc", _nfc_udf())
    kept = f"regexp_replace(nfc(t), r'{DROP_KEEP_PUNCT}', '')"
    for old, new in TONE_PAIRS.items():
        kept = f"replace({kept}, {quoted(old)}, {quoted(new)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN btrim({kept}, {quoted(WHITE_SPACE)})")
