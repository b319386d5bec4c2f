"""Secret redaction of prose columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind, pattern and the groups around the secret, in the order in which the rules apply.
RULES = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", False),
    ("api-key", r"(?U)\b(?-U)sk-[A-Za-z0-9_-]{20,}", False),
    ("github-token", r"(?U)\b(?-U)(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", False),
    ("aws-key", r"(?U)\b(?-U)(?:AKIA|ASIA)[0-9A-Z]{16}(?U)\b", False),
    ("slack-token", r"(?U)\b(?-U)xox[abprs]-[A-Za-z0-9-]{10,}", False),
    ("google-key", r"(?U)\b(?-U)AIza[0-9A-Za-z_-]{35}", False),
    ("jwt", r"(?U)\b(?-U)eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False),
    ("bearer", r"(?i)((?U)\bbearer\s+(?-U))[A-Za-z0-9._~+/-]{20,}=*", True),
    ("secret", r"""(?i)((?U)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b["']?\s*[:=]\s*["']?)(?U)[^\s"',;]{8,}""", True),
)
CANDIDATE = "[A-Za-z0-9+/=_-]{32,}"
#: Hex has four bits a character at most.
ENTROPY_BITS = 4.3


def _entropy(token: Column) -> Column:
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def looks_random(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]") & (_entropy(token) > ENTROPY_BITS)


def rules_applied(text: Column) -> Column:
    """The nine rules one after another; later ones see what earlier ones wrote."""
    for kind, pattern, prefixed in RULES:
        text = F.regexp_replace(text, pattern, ("$1" if prefixed else "") + f"[REDACTED:{kind}]")
    return text


def random_redacted(text: Column) -> Column:
    """Runs that look random replaced; the pieces between them and the runs themselves come from one pattern."""
    found, pieces = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    kept = F.transform(found, lambda t: F.when(looks_random(t), F.lit("[REDACTED:high-entropy]")).otherwise(t))
    joined = F.array_join(F.flatten(F.zip_with(pieces, kept, lambda p, t: F.array(p, F.coalesce(t, F.lit(""))))), "")
    return F.when(F.size(found) == 0, text).otherwise(joined)


def _once(text: Column, then) -> Column:
    """then(text) for a function that uses text several times: bound as a lambda's variable, it is worked out once a row."""
    return F.get(F.transform(F.array(text), then), F.lit(0))


def redacted(text: Column) -> Column:
    return _once(rules_applied(text), random_redacted)


def redacted_list(items: Column) -> Column:
    return F.transform(items, redacted)


def findings(text: Column) -> Column:
    """Number of markers of each kind in a redacted text, as an array of (kind, n) with n > 0. The text is worked out once."""
    kinds = [k for k, _, _ in RULES] + ["high-entropy"]
    each = lambda t: F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(t, F.lit(rf"\[REDACTED:{k}\]")).alias("n")) for k in kinds])
    return F.filter(_once(text, each), lambda x: x["n"] > 0)
