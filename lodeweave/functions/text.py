"""Text expressions: tokens, mentions, paths, lines, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as sensitive in a record (FLT-05).
SENSITIVE = (
    r"(?i)(?:\b(?:[a-z0-9]+_)*(?:password|passwd|api[_ -]?key|access[_ -]?token|token|secret|authorization|cookie)\b"
    r"[\"']?\s*[=:：]\s*[\"']?(?!\[redacted\]|<redacted>)[^\s\"']+)"
    r"|\bbearer\s+[A-Za-z0-9._~+/=-]{6,}|\bsk-[A-Za-z0-9_-]{12,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
    r"|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b|(?<!\d)(?:\+86[- ]?)?1[3-9]\d{9}(?!\d)"
    r"|(?:密码|密钥|令牌|手机号|身份证号|邮箱)\s*[=:：]\s*\S+"
    r"|\b(?:postgres(?:ql)?(?:\+\w+)?|rediss?|https?)://[^\s/@:]+:[^\s/@]+@"
)


def normal_path(path: Column | str, strip_current: bool = False) -> Column:
    """Slashes for backslashes; with ``strip_current``, without the dots and slashes it begins with (a set of characters, not a prefix)."""
    path = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    return F.regexp_replace(path, r"^[./]+", "") if strip_current else path


def safe_path(path: Column | str) -> Column:
    """FLT-04: whether a path is relative, has no colon, and no part that is empty, . or .. ."""
    path = F.col(path) if isinstance(path, str) else path
    bad = F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))
    return ~path.startswith("/") & ~path.contains(":") & ~path.contains("\\") & ~bad


def tokens(text: Column | str) -> Column:
    """RET-04: distinct lower-case runs of letters, digits, _ and / of two characters or more, in order."""
    text = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(F.lower(normal_path(text)), F.lit(r"(?U)[\w/]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t) >= 2))


def question_tokens(question: str) -> list[str]:
    """The same of a question at hand."""
    return list(dict.fromkeys(t for t in re.findall(r"[\w/]+", question.replace("\\", "/").lower()) if len(t) >= 2))


def mentions(text: Column | str, value: str) -> Column:
    """FLT-03: whether a text names a value as a whole, in either case: no letter, digit or one of _ . / before it, nor letter, digit, _ or / nor .letter after it. An empty value is never named."""
    text = F.col(text) if isinstance(text, str) else text
    if not value:
        return F.lit(False)
    return text.rlike(r"(?i)(?<![A-Za-z0-9_./])" + re.escape(value) + r"(?![A-Za-z0-9_/]|\.[A-Za-z_])")


def lines(text: Column | str) -> Column:
    """Lines parted by line feeds alone; one at the end adds no line."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(text, 256)


# What is masked in public texts, and how much of one is shown.
SECRET = r"(?i)(bearer\s+)[^\s,;]+|((?:api[_-]?key|token|password|secret)\s*[:=]\s*)[^\s,;]+"
MOST_SHOWN = 500


def public_text(text: Column | str, most: int = MOST_SHOWN) -> Column:
    """PRJ-12: a text as the public sees it: secrets masked over the whole of it, then its first ``most`` characters."""
    text = F.col(text) if isinstance(text, str) else text
    clean = F.regexp_replace(text, SECRET, "$1$2[REDACTED]")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("...[truncated]"))).otherwise(clean)
