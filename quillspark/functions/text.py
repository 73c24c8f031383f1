"""Column expressions for text; all run inside the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import EngineError

#: The code points of Unicode's White_Space property.
WS = r"[\x09-\x0d\x20\x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_ascii(c: Column | str) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(_c(c), UPPER, LOWER)


def normalize(c: Column | str) -> Column:
    """ASCII lower case; runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(fold_ascii(c), WS + "+", " "))


@F.arrow_udf(T.LongType())
def first_invalid(data: pa.Array) -> pa.Array:
    """The place of the first byte that isn't UTF-8; null if there is none."""
    out = []
    for b in data.to_pylist():
        try:
            (b or b"").decode()
            out.append(None)
        except UnicodeDecodeError as e:
            out.append(e.start)
    return pa.array(out, pa.int64())


def checked_normalize(data: Column | str, most_in: int | None = None, most_out: int | None = None) -> Column:
    """struct(text, context, byte_offset) of UTF-8 bytes: the normalised text, or the context of the first check that fails.

    Checks in order: ``normalize.input_bytes`` (more than ``most_in``), ``normalize.utf8`` (with the first invalid byte's offset),
    ``normalize.nul`` and ``normalize.output_bytes`` (more than ``most_out``). Python sees only bytes that aren't valid.
    """
    data = _c(data)
    text = F.try_validate_utf8(data.cast("string"))
    out = normalize(text)
    long_in = F.octet_length(data) > most_in if most_in is not None else F.lit(False)
    long_out = F.octet_length(out) > most_out if most_out is not None else F.lit(False)
    context = F.when(long_in, "normalize.input_bytes").when(text.isNull() & data.isNotNull(), "normalize.utf8").when(text.contains("\0"), "normalize.nul").when(long_out, "normalize.output_bytes")
    offset = first_invalid(F.when(context == "normalize.utf8", data))
    return F.struct(F.when(context.isNull(), out).alias("text"), context.alias("context"), F.when(context == "normalize.nul", F.octet_length(F.substring_index(text, "\0", 1)).cast("long")).otherwise(offset).alias("byte_offset"))


def english_tokens(c: Column | str) -> Column:
    """Maximal runs of ASCII letters and digits, in order, case kept."""
    return F.regexp_extract_all(_c(c), F.lit("[A-Za-z0-9]+"), 0)


def trim_space(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(_c(c), f"^{WS}+", ""), f"{WS}+$", "")


def is_blank(c: Column | str) -> Column:
    """White space only, or empty."""
    return F.regexp_replace(_c(c), WS, "") == ""


def unix_newlines(c: Column | str) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(_c(c), r"\r\n?", "\n")


def strip_bom(c: Column | str) -> Column:
    """Without one leading byte order mark."""
    return F.regexp_replace(_c(c), "^" + chr(0xFEFF), "")


def file_stem(path: Column | str) -> Column:
    """After the last slash, without the last extension unless the name begins with that dot."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def code_points(c: Column | str) -> Column:
    return F.char_length(_c(c)).cast("long")


def utf8_bytes(c: Column | str) -> Column:
    return F.octet_length(_c(c)).cast("long")


def escape_html(c: Column | str) -> Column:
    """The five characters that markup reserves, as entities; ampersands first."""
    out = _c(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def hex_lower(c: Column | str) -> Column:
    """Lower-case hexadecimal digits of the UTF-8 bytes."""
    return F.lower(F.hex(F.encode(_c(c), "UTF-8")))


def is_relative_path(c: Column | str) -> Column:
    """Not empty, no leading slash, no NUL, and no empty, '.' or '..' part."""
    return ~_c(c).contains("\0") & ~_c(c).rlike(r"(^|/)\.{0,2}(/|\z)")


def is_absolute_path(c: Column | str) -> Column:
    """A leading slash, no NUL, and no '..' part."""
    return _c(c).startswith("/") & ~_c(c).contains("\0") & ~_c(c).rlike(r"(^|/)\.\.(/|\z)")


def crc32(data: Column | str) -> Column:
    """The IEEE checksum of bytes or of a string's UTF-8 form, as a long."""
    return F.crc32(_c(data))


def json_string(c: Column | str) -> Column:
    """A JSON string literal: quotation marks and backslashes escaped, characters below U+0020 as \\u00xx, all others as they are."""
    out = F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for k in range(32):
        out = F.replace(out, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def score_text(score: float) -> str:
    """A score with up to 17 significant digits, without trailing zeros; one outside (0, 1] is an error."""
    if not 0 < score <= 1:
        raise EngineError("service.score", "a score lies outside (0, 1]")
    return format(score, ".17g")


def unsigned(c: Column | str) -> Column:
    """A canonical decimal number (no sign, no leading zero) as a long, else null."""
    return F.when(_c(c).rlike("^(0|[1-9][0-9]*)$"), _c(c).try_cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two longs differ."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("long")


def characters(c: Column | str) -> Column:
    """The distinct code points of a string."""
    return F.array_distinct(F.filter(F.split(_c(c), ""), lambda x: x != ""))
