"""Redaction and clean-up of error texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
INPUT_BYTES, OUTPUT_CHARS = 16 * 1024, 4096

# borders of words of ASCII: \b would count other letters as words and so spare what follows them
_FROM, _TO = r"(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])", r"(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])"
_EDGE = f"(?:{_FROM}|{_TO})"
# fixed values: the patterns, applied in this order, with their replacements; white space is spelled out, as \s has a vertical tab here
SECRETS = [
    (_FROM + r"(?i)(authorization|bearer)([\t\n\f\r ]*[:=]?[\t\n\f\r ]*)[^\t\n\f\r ]+", "$1$2" + MARK),
    (_FROM + r"(?i)(password|pwd)=([^\t\n\f\r &;]+)", "$1=" + MARK),
    (_FROM + r"(?i)([a-z][a-z0-9+.-]*://[^:/\t\n\f\r @]+:)([^@\t\n\f\r /]+)(@)", "$1" + MARK + "$3"),
    (r"(^|[^A-Za-z0-9_])((?:(?:sk_(?:live|test))|(?:rk_live))_[A-Za-z0-9_-]{16,})([^A-Za-z0-9_-]|$)", "$1" + MARK + "$3"),
    (r"(^|[^A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9_]{20,})([^A-Za-z0-9_]|$)", "$1" + MARK + "$3"),
    (r"(^|[^A-Za-z0-9_])(xox[baprs]-[A-Za-z0-9-]{10,})([^A-Za-z0-9-]|$)", "$1" + MARK + "$3"),
    (r"(^|[^A-Za-z0-9_])(AIza[A-Za-z0-9_-]{35})([^A-Za-z0-9_-]|$)", "$1" + MARK + "$3"),
    (r"(^|[^A-Z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})([^A-Z0-9]|$)", "$1" + MARK + "$3"),
    (r"(^|[^A-Za-z0-9_])((?:eyJ[A-Za-z0-9_-]*)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)([^A-Za-z0-9_.-]|$)", "$1" + MARK + "$3"),
]
RUN = _EDGE + r"[A-Za-z0-9+/_-]{20,}={0,2}" + _EDGE + "|" + _FROM + r"[0-9a-fA-F]{20,}" + _TO
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_opaque(token: Column) -> Column:
    """Whether a run of token characters looks like a secret: no UUID, no path, no 40-digit commit hash."""
    digit, upper, lower = (token.rlike(f"[{c}]") for c in ("0-9", "A-Z", "a-z"))
    hexadecimal = token.rlike("^[0-9A-Fa-f]+$")
    mixed = digit & upper & lower
    path = F.length(token) - F.length(F.replace(token, F.lit("/"))) >= 2
    shape = token.rlike("^[0-9A-Za-z+/=_-]{20,}$") & ~token.rlike(UUID) & ~path & ~(hexadecimal & (F.length(token) == 40))
    return shape & ((hexadecimal & digit) | token.rlike("[+/=]") | mixed)


def redact(text: Column) -> Column:
    """``text`` with known kinds of secrets and opaque runs replaced; null stays null."""
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)

    def runs(t: Column) -> Column:
        # what lies between the runs, and each run or its mark behind it
        found = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda x: F.when(is_opaque(x), MARK).otherwise(x))
        return F.array_join(F.zip_with(F.split(t, RUN, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return F.transform(F.array(text), runs)[0]


def sanitize(text: Column) -> Column:
    """An error text as stored: cut to INPUT_BYTES whole characters, redacted, without control characters, OUTPUT_CHARS long at most."""
    head = F.when(F.octet_length(text) <= INPUT_BYTES, text).otherwise(_head(text))
    clean = F.regexp_replace(redact(head), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    cut = lambda t: F.when(F.length(t) > OUTPUT_CHARS, F.concat(F.substring(t, 1, OUTPUT_CHARS - 3), F.lit("..."))).otherwise(t)
    return F.transform(F.array(clean), cut)[0]


def _head(text: Column) -> Column:
    """The longest prefix of whole characters in INPUT_BYTES bytes."""
    # a character has 4 bytes at most, so one of these four cuts ends at a character's end
    cuts = [F.try_validate_utf8(F.substring(F.encode(text, "utf-8"), 1, INPUT_BYTES - k).cast("string")) for k in range(4)]
    return F.coalesce(*cuts)
