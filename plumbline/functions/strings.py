"""String functions. Positions of `substring` and `index_of` are 1-based and a miss is 0; `split_part` counts from 0."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col

DATETIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"


def ascii_(s) -> Column:
    return F.ascii(col(s)).cast("bigint")


def char(code) -> Column:
    return F.char(col(code))


def chunk(s, n: int) -> Column:
    return F.regexp_extract_all(col(s), F.lit(f"(?s).{{1,{int(n)}}}"), F.lit(0))


def contains(s, part) -> Column:
    return F.coalesce(F.contains(col(s), col(part)), F.lit(False))


def starts_with(s, part) -> Column:
    return F.coalesce(F.startswith(col(s), col(part)), F.lit(False))


def ends_with(s, part) -> Column:
    return F.coalesce(F.endswith(col(s), col(part)), F.lit(False))


def encode_base64(s) -> Column:
    return F.base64(col(s).cast("binary"))


def decode_base64(s) -> Column:
    return F.unbase64(col(s)).cast("string")


def generate_guid() -> Column:
    return F.uuid()


def index_of(s, part, start=None) -> Column:
    return (F.instr(col(s), col(part)) if start is None else F.locate(part, col(s), start)).cast("bigint")


def join_strings(strings, *args: str) -> Column:
    """join_strings(list), (list, separator) or (list, prefix, separator, suffix); an empty list gives the empty text."""
    prefix, separator, suffix = args if len(args) == 3 else ("", args[0] if args else "", "")
    return F.concat(F.lit(prefix), F.coalesce(F.array_join(col(strings), separator), F.lit("")), F.lit(suffix))


def make_string(values, *args: str) -> Column:
    """As join_strings, but nulls show as TDSNull."""
    shown = F.transform(col(values), lambda x: F.coalesce(x.cast("string"), F.lit("TDSNull")))
    return join_strings(shown, *args)


def left(s, n) -> Column:
    return F.left(col(s), col(n))


def right(s, n) -> Column:
    return F.right(col(s), col(n))


def length(s) -> Column:
    return F.length(col(s).cast("string")).cast("bigint")


def levenshtein_distance(a, b) -> Column:
    return F.levenshtein(col(a), col(b)).cast("bigint")


def _pad(s, n, pad: str, padded) -> Column:
    s, n = col(s), col(n)
    if pad == "":
        return F.when(F.length(s) > n, F.left(s, n)).otherwise(s)
    return padded(s, n, F.lit(pad))


def lpad(s, n, pad: str = " ") -> Column:
    return _pad(s, n, pad, F.lpad)


def rpad(s, n, pad: str = " ") -> Column:
    return _pad(s, n, pad, F.rpad)


def trim(s) -> Column:
    return F.trim(col(s))


def ltrim(s) -> Column:
    return F.ltrim(col(s))


def rtrim(s) -> Column:
    return F.rtrim(col(s))


def matches(s, regex: str) -> Column:
    return col(s).rlike(f"^(?:{regex})$")


def parse_boolean(s) -> Column:
    return col(s).cast("boolean")


def parse_integer(s) -> Column:
    return col(s).cast("bigint")


def parse_float(s) -> Column:
    return col(s).cast("double")


def parse_decimal(s, precision: int = 5, scale: int = 2) -> Column:
    """A trailing d or D is a decimal mark; a column without given precision is decimal(5, 2)."""
    return F.regexp_replace(col(s), "[dD]$", "").cast(f"decimal({precision},{scale})")


def parse_date(s) -> Column:
    """ISO text with any number of parts; a zone is applied and the result is UTC without zone."""
    s = F.regexp_replace(col(s), "%", "")
    padded = F.when(F.length(s) == 4, F.concat(s, F.lit("-01-01"))).when(F.length(s) == 7, F.concat(s, F.lit("-01"))).otherwise(s)
    return padded.cast("timestamp").cast("timestamp_ntz")


def _flags(regex: str, flags: str) -> str:
    return (f"(?{''.join(sorted(set(flags)))})" if flags else "") + regex


def regexp_count(s, regex: str, flags: str = "") -> Column:
    return F.regexp_count(col(s), F.lit(_flags(regex, flags))).cast("bigint")


def regexp_extract(s, regex: str, extract_all: bool = False, group: int = 0, flags: str = "") -> Column:
    """A list of the matches, or of the first one only."""
    found = F.regexp_extract_all(col(s), F.lit(_flags(regex, flags)), F.lit(group))
    return found if extract_all else F.slice(found, 1, 1)


def regexp_index_of(s, regex: str, group: int = 0, flags: str = "") -> Column:
    """0-based place of the match or of a group of it, -1 on a miss."""
    s = col(s)
    if not group:
        return (F.regexp_instr(s, F.lit(_flags(regex, flags))) - 1).cast("bigint")
    whole = _flags(regex, flags + "s")
    match = F.regexp_substr(s, F.lit(whole))
    inside = F.instr(match, F.regexp_extract(s, whole, group))
    return F.when(match.isNull(), F.lit(-1)).otherwise(F.regexp_instr(s, F.lit(whole)) - 2 + inside).cast("bigint")


def regexp_like(s, regex: str, flags: str = "") -> Column:
    return col(s).rlike(_flags(regex, flags))


def regexp_replace(s, regex: str, replacement: str, replace_all: bool = True, flags: str = "") -> Column:
    """`replacement` is literal text."""
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    if replace_all:
        return F.regexp_replace(col(s), _flags(regex, flags), quoted)
    return F.regexp_replace(col(s), f"^((?s:.*?))(?:{_flags(regex, flags)})", "$1" + quoted)


def repeat_string(s, n) -> Column:
    return F.repeat(col(s), col(n))


def replace(s, part, by) -> Column:
    return F.replace(col(s), col(part), col(by))


def reverse_string(s) -> Column:
    return F.reverse(col(s))


def split(s, delimiter: str) -> Column:
    return F.split(col(s), "\\Q" + delimiter + "\\E")


def split_part(s, delimiter: str, index) -> Column:
    s = col(s)
    if delimiter == "":
        return F.when(col(index) == 0, s)
    return F.split_part(s, F.lit(delimiter), col(index) + 1)


def substring(s, start, end=None) -> Column:
    """From the 1-based start, which is at least 1; `end` is a length."""
    start = F.greatest(col(start), F.lit(1))
    return F.substr(col(s), start) if end is None else F.substr(col(s), start, col(end))


def to_lower(s) -> Column:
    return F.lower(col(s))


def to_upper(s) -> Column:
    return F.upper(col(s))


def to_lower_first_character(s) -> Column:
    return F.concat(F.lower(F.left(col(s), F.lit(1))), F.substr(col(s), F.lit(2)))


def to_upper_first_character(s) -> Column:
    return F.concat(F.upper(F.left(col(s), F.lit(1))), F.substr(col(s), F.lit(2)))


def to_string(x, kind: str | None = None) -> Column:
    """kind: "datetime" or "date" for the ISO forms, else the plain text of the value."""
    x = col(x)
    if kind == "datetime":
        return F.date_format(x, DATETIME)
    return x.cast("string")


def to_representation(x, kind: str = "string") -> Column:
    """The value as a literal of the language: quoted text, %-dates, D-decimals."""
    x = col(x)
    if kind == "string":
        return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
    if kind in ("date", "datetime"):
        return F.concat(F.lit("%"), to_string(x, kind))
    return F.concat(x.cast("string"), F.lit("D" if kind == "decimal" else ""))


_DIRECTIVE = re.compile(r"%(?:t\{([^}]*)\}|([-+ 0,#]*\d*(?:\.\d+)?)([sdfr%]))")


def format_(pattern: str, *args) -> Column:
    """%s, %d, %f (with width and digits), %r (representation), %t{date pattern}."""
    parts, at, rest = [], 0, list(args)
    for m in _DIRECTIVE.finditer(pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[3] == "%":
            parts.append(F.lit("%"))
            continue
        value = col(rest.pop(0))
        if m[1] is not None:
            parts.append(F.date_format(value, m[1].replace('"', "'")))
        elif m[3] == "r":
            parts.append(to_representation(value))
        elif m[2]:
            parts.append(F.format_string(f"%{m[2]}{m[3]}", value.cast("double") if m[3] == "f" else value))
        else:
            parts.append(value.cast("string"))
    return F.concat(*parts, F.lit(pattern[at:]))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    hits = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if not free[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_similarity(a, b) -> Column:
    """No built-in function computes it: a vectorised UDF, over distinct pairs of a batch."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(x, y):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else _jaro_winkler(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return similarity(col(a), col(b))


def is_numeric(s) -> Column:
    """Loose: text without letters."""
    return F.lower(col(s)) == F.upper(col(s))
