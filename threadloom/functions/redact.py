"""Redaction of secrets and home paths as Column expressions (RED1-RED18).

Java's patterns stand for Unicode-aware ones by (?U). Java would use a stack frame for every link of the
key chain of secret assignments, so the chain is written without a loop: links that end in a hyphen end at
a word boundary anyhow, and the others are one run of letters, digits and single underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import ascii_lower, title

REDACTION_VERSION, PLACEHOLDER = 1, "<redacted>"

# The patterns of secrets, in the order in which they are applied.
KEY = r"(?:secret[_-]?access[_-]?key|access[_-]?key[_-]?id|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|api[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|token|secret|password|passwd|pwd)"
ENV_PREFIX, ENV_BARE = r"\b(?:export\s+)?[A-Z][A-Z0-9_]+=", r"""[^\s'"`;$]+"""
SECRET_BARE = r"""[^\s'"`]+"""
_QUOTED = r"""(?:(")[^"]*"|(')[^']*'|"""
ENV_ASSIGNMENT = rf"(?U)({ENV_PREFIX}){_QUOTED}{ENV_BARE})"
SECRET_ASSIGNMENT = rf"(?iU)(\b(?![a-z0-9_]*__)(?:[a-z0-9][a-z0-9_]*_)?{KEY}\s*[:=]\s*){_QUOTED}{SECRET_BARE})"
TOKENS = (
    r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
    r"(?U)\bsk-[A-Za-z0-9_-]{20,}\b",
    r"(?U)\bgh[pousr]_[A-Za-z0-9_]{30,}\b",
    r"(?U)\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"(?U)\bglpat-[A-Za-z0-9_-]{20,}\b",
    r"(?U)\bhf_[A-Za-z0-9]{20,}\b",
    r"(?U)\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    r"(?U)\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    r"(?U)\bAIza[0-9A-Za-z_-]{35}\b",
    r"(?U)\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    r"(?iU)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}",
)
_KEEP_QUOTES = "$1$2$3<redacted>$2$3"


#: For each of these patterns, texts of which it needs one; what lacks them isn't searched.
_NEEDS = (("PRIVATE KEY-----",), ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("glpat-",), ("hf_",), ("xox",), ("AKIA", "ASIA"), ("AIza",), ("eyJ",))
_KEYS = ("token", "secret", "password", "passwd", "pwd", "key", "\u017f", "\u212a")  # the last two are s and k in any case


def _any(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.contains(c, F.lit(needles[0]))
    for x in needles[1:]:
        out = out | F.contains(c, F.lit(x))
    return out


def patterns_compile(spark: SparkSession) -> bool:
    """Whether the executors' kind of pattern takes all of these."""
    try:
        for p in (ENV_ASSIGNMENT, SECRET_ASSIGNMENT, *TOKENS):
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(p)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def redact(c: Column, home: str | None = None) -> Column:
    """The whole pipeline: home path, environment, secret assignments, tokens. Idempotent. ``home`` is a
    literal that the driver resolved; empty or "/" replaces nothing. Each step is taken only by texts that have
    what its pattern needs, and sees the former step's text once. Where the patterns can't be used (RED16), the
    whole field is withheld, never shown as it is."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not patterns_compile(spark):
        return F.when(c.isNotNull(), F.lit(PLACEHOLDER))
    low = lambda x: ascii_lower(x)
    steps = [
        (lambda x: F.contains(x, F.lit("=")), ENV_ASSIGNMENT, _KEEP_QUOTES),
        (lambda x: _any(x, ("=", ":")) & _any(low(x), _KEYS), SECRET_ASSIGNMENT, _KEEP_QUOTES),
        *((lambda x, n=n: _any(x, n), pattern, PLACEHOLDER) for n, pattern in zip(_NEEDS, TOKENS[:-1], strict=True)),
        (lambda x: _any(low(x), ("bearer",)), TOKENS[-1], PLACEHOLDER),
    ]
    out = F.replace(c, F.lit(home), F.lit("~")) if home and home != "/" else c
    for step in steps:
        out = F.get(F.transform(F.array(out), _taken(*step)), 0)
    return out


def _taken(needed: Callable[[Column], Column], pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda x: F.when(needed(x), F.regexp_replace(x, pattern, by)).otherwise(x)


def redact_all(texts: Column, home: str | None = None) -> Column:
    return F.transform(texts, lambda x: redact(x, home))


def redacted_title(user: Column, home: str | None = None) -> Column:
    return redact(title(user), home)
