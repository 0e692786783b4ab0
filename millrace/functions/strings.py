"""String functions where a dialect's rule is not Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Skips NULLs; all NULL is empty."""
    return F.concat_ws("", *parts)


def byte_length(value: Column) -> Column:
    return F.octet_length(value)


def substring(value: Column, start: int, count: int | None = None) -> Column:
    """1-based; places before 1 exist and are empty, so they use up ``count``."""
    if count is None:
        return F.substring(value, F.lit(max(start, 1)), F.char_length(value))
    if count < 0:
        raise ValueError("negative length")
    return F.substring(value, F.lit(max(start, 1)), F.lit(max(start + count - max(start, 1), 0)))


def trim_string(value: Column, affix: str, where: str = "both") -> Column:
    """Strips whole repeats of ``affix``, not a set of characters."""
    unit = "(?:\\Q" + affix + "\\E)+"
    out = value
    if where in ("both", "leading"):
        out = F.regexp_replace(out, "^" + unit, "")
    if where in ("both", "trailing"):
        out = F.regexp_replace(out, unit + "\\z", "")
    return out


def regexp_replace_first(value: Column, pattern: str, replacement: str) -> Column:
    """Only the first match; ``replacement`` may use $1 for the pattern's first group and so on."""
    shifted = "".join(f"${int(c) + 1}" if k % 2 else c for k, c in enumerate(_groups(replacement)))
    return F.regexp_replace(value, f"(?s)\\A(.*?){pattern}", f"$1{shifted}")


def _groups(replacement: str) -> list[str]:
    import re

    return re.split(r"\$(\d)", replacement)


def regexp_match(value: Column, pattern: str, groups: int) -> Column:
    """The captures of the first match as an array (the whole match without groups); NULL without a match."""
    own = [F.regexp_extract(value, pattern, i) for i in range(1, groups + 1)] or [F.regexp_extract(value, pattern, 0)]
    return F.when(F.regexp_like(value, F.lit(pattern)), F.array(*own))


def position(needle: Column | str, value: Column) -> Column:
    return F.locate(needle, value) if isinstance(needle, str) else F.position(needle, value)


def initcap(value: Column) -> Column:
    """A letter or digit run's first letter is upper case, the rest lower."""
    words = F.regexp_extract_all(F.lower(value), F.lit("([\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), "")


def quote_literal(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def quote_identifier(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def formatted(template: str, *args: Column) -> Column:
    """%s as text (NULL: empty), %I as a quoted identifier, %L as a quoted literal, %% as a percent sign."""
    import re

    out, rest = [], list(args)
    for part in re.split(r"(%[sIL%])", template):
        if part == "%%":
            out.append(F.lit("%"))
        elif part == "%s":
            out.append(F.coalesce(rest.pop(0).cast("string"), F.lit("")))
        elif part == "%I":
            out.append(quote_identifier(rest.pop(0).cast("string")))
        elif part == "%L":
            out.append(quote_literal(rest.pop(0).cast("string")))
        elif part:
            out.append(F.lit(part))
    return F.concat(*out) if out else F.lit("")


def encode_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def like_nocase(value: Column, pattern: str) -> Column:
    return value.ilike(pattern)


def glob(value: Column, pattern: str) -> Column:
    """Case-sensitive * ? [set] [^set] over the whole value."""
    import re

    out = []
    for token in re.findall(r"\[\^?\]?[^\]]*\]|.", pattern, re.DOTALL):
        if token == "*":
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif token.startswith("[") and token.endswith("]") and len(token) > 2:
            out.append(token.replace("\\", "\\\\").replace("&", "\\&"))
        else:
            out.append("\\Q" + token + "\\E")
    return F.regexp_like(value, F.lit("(?s)\\A" + "".join(out) + "\\z"))


def regexp_substr(value: Column, pattern: str, position: int = 1, occurrence: int = 1) -> Column:
    """The text of a match, counted from ``position`` (from 1) on; NULL without that many."""
    found = F.regexp_extract_all(F.substring(value, F.lit(position), F.greatest(F.char_length(value) - position + 1, F.lit(0))), F.lit(f"(?:{pattern})"), 0)
    return F.get(found, occurrence - 1)


def regexp_instr(value: Column, pattern: str, position: int = 1, occurrence: int = 1, after: bool = False) -> Column:
    """Where a match begins, or ends with ``after``, in code points from 1; 0 without that many."""
    rest = F.substring(value, F.lit(position), F.greatest(F.char_length(value) - position + 1, F.lit(0)))
    # Each piece is what stands before a match and the match.
    pieces = F.slice(F.regexp_extract_all(rest, F.lit(f"(?s).*?(?:{pattern})"), 0), 1, occurrence)
    end = F.aggregate(pieces, F.lit(position), lambda n, p: n + F.char_length(p))
    start = end - F.char_length(F.get(F.regexp_extract_all(rest, F.lit(f"(?:{pattern})"), 0), occurrence - 1))
    return F.when(value.isNull(), None).when(F.size(pieces) < occurrence, 0).otherwise(end if after else start)
