"""Column functions that hide standalone secrets, and path rules for files that are never indexed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[hidden]"
# Published token forms, credentials in addresses and headers, and names of secret files.
TOKENS = r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|sk_live_[A-Za-z0-9]{24}|npm_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,})"
KEY_BLOCK = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
ADDRESS = r"(://[^\s:/@]*:)[^\s:/@$<{*][^\s/@]*(@)"
HEADER = r"(?i)(authorization[\"']?\s*[:=]\s*[\"']?(?:bearer|basic)\s+)[A-Za-z0-9._~+/=!%-]{8,}"
SECRET_PATH = r"(?i)(^|/)(\.env|\.env\.(local|dev|development|prod|production|staging|test|ci|secret|secrets|private|backup|bak|old)|[^/]*\.env|id_(rsa|dsa|ecdsa|ed25519)|\.netrc|\.npmrc|\.pypirc|credentials(\.json)?|[^/]*\.(pem|key|p12|pfx|jks|keystore))$|(^|/)\.(aws|kube|ssh)/"
IGNORED_PART = r"(?i)(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build|target|vendor)(/|$)"


def hide_standalone(text: Column) -> Column:
    """Token forms, key blocks, passwords in addresses and authorization values, each replaced; the rest byte for byte."""
    out = F.regexp_replace(text, KEY_BLOCK, MARK)
    out = F.regexp_replace(out, TOKENS, MARK)
    out = F.regexp_replace(out, ADDRESS, f"$1{MARK}$2")
    return F.regexp_replace(out, HEADER, f"$1{MARK}")


def secret_path(path: Column) -> Column:
    """Whether a path's name tells that it holds secrets."""
    return path.rlike(SECRET_PATH)


def ignored_path(path: Column) -> Column:
    """Whether a part of a path is never indexed, whatever its case."""
    return path.rlike(IGNORED_PART)
