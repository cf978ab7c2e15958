"""Replacement of secrets in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolytics.functions.paths import is_binary_path, is_sensitive_path

TOKEN = "[REDACTED SECRET]"

# What is taken for a secret, in the order of replacement.
SECRETS = (
    r"""(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|bearer[_-]?token|password|passwd|pwd)\s*[:=]\s*['"][^'"]{4,}['"]""",
    r"(?i)bearer\s+[a-zA-Z0-9_\-\.]{20,}",
    r"gh[pousr]_[a-zA-Z0-9]{36,}",
    r"sk-[a-zA-Z0-9]{20,}",
    r"sk-proj-[a-zA-Z0-9_\-]{30,}",
    r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+ PRIVATE KEY-----",
    r"-----BEGIN [A-Z ]+ PRIVATE KEY-----",
)
ASSIGNED = r"(?i)\b(?:api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key|password|token|secret)\b\s*[:=]\s*[^\s,;]+"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
CONNECTION = r"(?i)(?:postgres(?:ql)?|mysql|mongodb|redis)://[^\s]+"
LOGGED = r"(?i)(bearer\s+|(?:api[_-]?key|token|password|secret)\s*[:=]\s*)\S+"
SHAPES = r"gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}"


def _safe(token: str) -> str:
    return token.replace("$", r"\$")


def redact_secrets(text: Column) -> Column:
    """Every pattern replaced in turn."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, _safe(TOKEN))
    return text


def redact_file(path: Column, content: Column) -> Column:
    """``content`` redacted and ``redacted`` whether that changed it; both null for sensitive and binary files."""
    ok = ~(is_sensitive_path(path) | is_binary_path(path))
    safe = F.when(ok, redact_secrets(content))
    return F.struct(safe.alias("content"), F.when(ok, safe != content).alias("redacted"))


def scrub_metadata(text: Column) -> Column:
    """As :func:`redact_secrets`, then unquoted values of secret keys, then key blocks; no NUL is left."""
    text = F.regexp_replace(redact_secrets(F.coalesce(text, F.lit(""))), ASSIGNED, TOKEN)
    return F.replace(F.regexp_replace(text, KEY_BLOCK, "[REDACTED PRIVATE KEY]"), F.lit("\x00"), F.lit(""))


def redact_log(text: Column) -> Column:
    """Connection strings, values behind secret keys, and token shapes."""
    text = F.regexp_replace(text, CONNECTION, "[redacted-connection]")
    text = F.regexp_replace(text, LOGGED, "$1[redacted]")
    return F.regexp_replace(text, SHAPES, "[redacted]")


def truncate_content(text: Column, most: int = 6000) -> Column:
    """The first ``most`` characters and a mark, only where there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[CONTENT TRUNCATED]"))).otherwise(text)
