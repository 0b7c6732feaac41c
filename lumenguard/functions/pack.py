"""The rule pack: patterns with their class, confidence and validator, and forms of references that are no secrets."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

CLASSES = ("SSN", "PAN", "CUI", "CREDENTIAL", "IBAN", "PASSPORT", "MRN", "NPI")
VALIDATORS = ("none", "ssnArea", "luhn", "mod97", "npiLuhn", "notEmptyAssignmentTarget", "containsDigit")
VERSION = "1.0.0"
MOST_REPEATS = 1000


class PackError(ValueError):
    """A pack that must not run."""


@dataclass(frozen=True)
class Pattern:
    id: str
    cls: str
    confidence: float
    flags: str
    validator: str
    source: str
    hint: str = ""  # what a text must match for the pattern to have a chance; after (?i), words of which it must hold one


#: Patterns in scan order, in the dialect that Python, JavaScript, RE2 and Java share.
PATTERNS = (
    Pattern("ssn", "SSN", 0.95, "", "ssnArea", r"\b(\d{3}-\d{2}-\d{4})\b", r"\d-\d"),
    Pattern("pan", "PAN", 0.90, "", "luhn", r"\b(\d[\d -]{11,22}\d)\b", r"\d[\d -]{11}"),
    Pattern("cui-marking", "CUI", 0.99, "i", "none", r"\b(CUI//SP-[A-Z-]+|CONTROLLED\s+UNCLASSIFIED\s+INFORMATION|FOR\s+OFFICIAL\s+USE\s+ONLY|CUI//[A-Z-]+)\b", "(?i)CUI//|CLASSIFIED|OFFICIAL"),
    Pattern("aws-access-key-id", "CREDENTIAL", 0.98, "", "none", r"\b(AKIA[0-9A-Z]{16})\b", "AKIA"),
    Pattern("aws-secret-access-key", "CREDENTIAL", 0.90, "i", "none", r"""(?:aws[_-]?)?secret[_-]?access[_-]?key["']?\s*[:=]\s*['"]?([A-Za-z0-9/+]{40})['"]?""", "(?i)key"),
    Pattern("anthropic-api-key", "CREDENTIAL", 0.98, "", "none", r"(sk-ant-api\d{2}-[A-Za-z0-9_-]{20,1000})", "sk-ant-api"),
    Pattern("openai-project-key", "CREDENTIAL", 0.98, "", "none", r"(sk-proj-[A-Za-z0-9_-]{20,1000})", "sk-proj-"),
    Pattern("openrouter-key", "CREDENTIAL", 0.98, "", "none", r"(sk-or-v1-[A-Za-z0-9]{48,1000})", "sk-or-v1-"),
    Pattern("openai-legacy-key", "CREDENTIAL", 0.85, "", "none", r"\b(sk-[A-Za-z0-9]{48,1000})", "sk-"),
    Pattern("github-pat-classic", "CREDENTIAL", 0.98, "", "none", r"\b(ghp_[A-Za-z0-9]{36})\b", "ghp_"),
    Pattern("github-pat-fine-grained", "CREDENTIAL", 0.98, "", "none", r"\b(github_pat_[A-Za-z0-9_]{82})\b", "github_pat_"),
    Pattern("bearer-token", "CREDENTIAL", 0.85, "", "none", r"Bearer\s+([A-Za-z0-9._~+/=-]{20,1000})", "Bearer"),
    Pattern("generic-key-assignment", "CREDENTIAL", 0.80, "i", "notEmptyAssignmentTarget", r"""(?:api[_-]?key|secret[_-]?key|access[_-]?token)\s*[:=]\s*['"]?([A-Za-z0-9._~+/-]{16,1000}={0,2})['"]?""", "(?i)key|token"),
    Pattern("iban", "IBAN", 0.85, "", "mod97", r"\b([A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4})\b", r"[A-Z]{2}\d{2}"),
    Pattern("passport", "PASSPORT", 0.75, "i", "none", r"(?:passport|travel\s+document)[:\s#-]*\b([A-Z]{1,2}\d{6,9})\b", "(?i)passport|document"),
    Pattern("mrn", "MRN", 0.90, "i", "containsDigit", r"\bMRN[:\s#-]*([A-Z0-9]{6,12})\b", "(?i)MRN"),
    Pattern("npi", "NPI", 0.85, "i", "npiLuhn", r"\bNPI[:\s#-]*(\d{10})\b", "(?i)NPI"),
)
#: A finding whose trimmed capture is one of these as a whole is a reference to a secret and no secret.
REFERENCES = (
    r"(?:globalThis\.)?(?:process\.env|import\.meta\.env|Deno\.env)\.[A-Za-z_][A-Za-z0-9_]*",
    r"(?:globalThis\.)?(?:process\.env|import\.meta\.env|Deno\.env|os\.environ|ENV)\s*\[\s*['\"][A-Za-z_][A-Za-z0-9_]*['\"]\s*\]",
    r"(?:os\.environ\.get|os\.getenv|System\.getenv|Deno\.env\.get|std::env::var)\s*\(\s*['\"][A-Za-z_][A-Za-z0-9_]*['\"]\s*\)",
    r"\$\{?(?:env:)?[A-Za-z_][A-Za-z0-9_]*\}?",
)
_WORD = "[0-9A-Za-z_]"
#: Java's own boundary knows all of Unicode; this one knows ASCII, as the other dialects do.
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(p: Pattern) -> str:
    return ("(?i)" if "i" in p.flags else "") + p.source.replace(r"\b", BOUNDARY)


def reference_regex() -> str:
    return r"\A(?:" + "|".join(REFERENCES) + r")\z"


def problems(patterns: tuple[Pattern, ...] | list[Pattern]) -> list[str]:
    """What is wrong with a pack; empty if it may run."""
    found, seen = [], set()
    for i, p in enumerate(patterns):
        at = f"patterns[{i}] ({p.id!r})"
        if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", p.id or ""):
            found.append(f"{at}: id must be lower-case words joined by '-'")
        if p.id in seen:
            found.append(f"{at}: id occurs twice")
        seen.add(p.id)
        if p.cls not in CLASSES:
            found.append(f"{at}: unknown class {p.cls!r}")
        if p.flags not in ("", "i"):
            found.append(f"{at}: flags must be '' or 'i'")
        if p.validator not in VALIDATORS:
            found.append(f"{at}: unknown validator {p.validator!r}")
        if isinstance(p.confidence, bool) or not isinstance(p.confidence, int | float) or not 0 <= p.confidence <= 1:
            found.append(f"{at}: confidence must be from 0 to 1")
        if re.search(r"\(\?(?![:])|\\[1-9AGkKpPQEZz]|[*+?}][+]", p.source):
            found.append(f"{at}: uses a construct that not all dialects have")
        for low, comma, high in re.findall(r"\{(\d*)(,?)(\d*)\}", p.source):
            if not low or (comma and not high) or int(high or low) > MOST_REPEATS:
                found.append(f"{at}: a repeat must have bounds of at most {MOST_REPEATS}")
        try:
            if re.compile(p.source, re.ASCII).groups != 1:
                found.append(f"{at}: must have one capturing group")
        except re.error as e:
            found.append(f"{at}: {e}")
    return found


def checked(patterns: tuple[Pattern, ...] | list[Pattern]) -> tuple[Pattern, ...]:
    if bad := problems(patterns):
        raise PackError("; ".join(bad[:10]) + (f"; and {len(bad) - 10} more" if len(bad) > 10 else ""))
    return tuple(patterns)


def as_json(patterns: tuple[Pattern, ...] = PATTERNS) -> str:
    return json.dumps({"packVersion": VERSION, "referenceForms": list(REFERENCES), "patterns": [asdict(p) for p in patterns]}, sort_keys=True, separators=(",", ":"))


def from_json(text: str) -> tuple[Pattern, ...]:
    """A pack of one's own; anything wrong with it is an error before any job starts."""
    try:
        return checked([Pattern(**p) for p in json.loads(text)["patterns"]])
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise PackError(f"not a pack: {e}") from e


def identity(patterns: tuple[Pattern, ...] = PATTERNS) -> tuple[str, str]:
    """Version and SHA-256 of the pack's bytes."""
    return VERSION, hashlib.sha256(as_json(patterns).encode()).hexdigest()


checked(PATTERNS)
