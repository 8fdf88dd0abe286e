"""Identities: canonical JSON and digests on the driver, hashes and tie-breaks on executors."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Our default namespace of tie-breaks.
TIE_NAMESPACE = "plumbline.tie.v1"

# Names that mark credentials.
_CREDENTIAL_WORDS = ["apikey", "token", "accesstoken", "secret", "password", "passwd", "authorization", "credential", "credentials", "privatekey", "bearer"]
_HARMLESS_WORDS = ["maxtokens", "prompttokens", "completiontokens", "totaltokens", "tokenizer"]


def is_credential_key(name: str) -> bool:
    """Whether a key names a credential, whatever its letter case and separators."""
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    return plain not in _HARMLESS_WORDS and any(plain == w or plain.endswith(w) for w in _CREDENTIAL_WORDS)


def sanitized_url(url: str) -> str:
    """A URL without user info, query and fragment."""
    parts = urlsplit(url)
    host = parts.hostname or ""
    return urlunsplit((parts.scheme, f"{host}:{parts.port}" if parts.port else host, parts.path, "", ""))


def redacted(text: Column) -> Column:
    """Text with bearer tokens, credential assignments and URL queries blanked."""
    out = F.regexp_replace(text, r"(?i)(bearer\s+)\S+", "$1[redacted]")
    out = F.regexp_replace(out, r"(?i)\b((?:api[_-]?key|access[_-]?token|token|secret|password)\s*[=:]\s*)[^\s,;&]+", "$1[redacted]")
    return F.regexp_replace(out, r"(https?://[^\s?#]+)\?[^\s#]+", "$1?[redacted]")


def canonical(value: object) -> object:
    """Plain JSON data in one form: NFC keys and strings, sets sorted, -0 as 0; NaN, infinities and credential keys are errors."""
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("numbers in an identity must be finite")
        return 0.0 if value == 0 else value
    if isinstance(value, dict):
        out = {}
        for key, item in value.items():
            name = unicodedata.normalize("NFC", str(key))
            if is_credential_key(name):
                raise ValueError(f"credential key in an identity: {name}")
            if name in out:
                raise ValueError(f"key given twice: {name}")
            out[name] = canonical(item)
        return out
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=canonical_json)
    if isinstance(value, Path):
        return value.as_posix()
    if isinstance(value, Iterable):
        return [canonical(v) for v in value]
    raise TypeError(f"no canonical form for {type(value).__name__}")


def canonical_json(value: object) -> str:
    """Compact JSON of the canonical form, keys sorted, ASCII only."""
    return json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def digest(value: object) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def short_id(prefix: str, value: object, length: int = 16) -> str:
    """``prefix_`` and the first digits of the digest."""
    return f"{prefix}_{digest(value)[:length]}"


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(folder: str | Path) -> str:
    """Digest of all files of a folder by relative path; links are refused."""
    entries = []
    for path in sorted(Path(folder).rglob("*")):
        if path.is_symlink():
            raise ValueError(f"link in a digested tree: {path}")
        if path.is_file():
            entries.append([path.relative_to(folder).as_posix(), file_digest(path)])
    return digest(entries)


def resolve_tie(ids: Iterable[int], *, seed: int, benchmark: str, question: str, method: str, namespace: str = TIE_NAMESPACE) -> int:
    """One of the tied source indexes, by an 8-byte BLAKE2b over names and sorted ids; independent of their order."""
    tied = sorted(ids)
    if not tied:
        raise ValueError("no tied ids")
    text = "|".join([namespace, str(int(seed)), benchmark, question, method, ",".join(map(str, tied))])
    return tied[int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % len(tied)]


def tie_udf(seed: int, method: str, namespace: str = TIE_NAMESPACE):
    """Pandas UDF (benchmark, question, tied ids array) -> winning id; null for no ids."""

    @F.pandas_udf("int")
    def tie(benchmark: pd.Series, question: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(
            [resolve_tie(map(int, i), seed=seed, benchmark=b or "", question=q or "", method=method, namespace=namespace) if i is not None and len(i) else None for b, q, i in zip(benchmark, question, ids)], dtype="Int32"
        )

    # Always the same, but called so: a filter on the winner must not be pushed below the function that finds it.
    return tie.asNondeterministic()


def semantic_text(text: str | None) -> str:
    """NFKC, white space collapsed, case folded."""
    return " ".join(unicodedata.normalize("NFKC", text or "").split()).casefold()


@F.pandas_udf(T.StringType())
def semantic_identity(question: pd.Series, choices: pd.Series) -> pd.Series:
    """Identity of a question's meaning: its text and sorted option texts, free of order and labels."""
    return pd.Series([digest({"question": semantic_text(q), "choices": sorted(semantic_text(c) for c in (o if o is not None else []))}) for q, o in zip(question, choices)])


def cache_key(provider: Column, model: Column, prompt: Column, temperature: Column, max_tokens: Column, seed: Column) -> Column:
    """Content address of a request; a null part differs from an empty one."""
    part = lambda c: F.when(c.isNull(), F.lit("\u0000")).otherwise(c.cast("string"))
    return F.sha2(F.concat_ws("\u0001", *[part(c) for c in (provider, model, prompt, temperature, max_tokens, seed)]), 256)


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's canonical JSON text; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
