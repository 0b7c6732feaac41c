"""Finding sensitive content in tables of text, and preparing corpora."""

from .functions.masks import mask, redact
from .functions.pack import PATTERNS, PackError, Pattern
from .operators.classify import classify
from .operators.integrations import ComplianceViolation, guard_io, guard_output
from .operators.policy import Policy
from .operators.registry import Registry
from .session import Session, comply

__all__ = ["PATTERNS", "ComplianceViolation", "PackError", "Pattern", "Policy", "Registry", "Session", "classify", "comply", "guard_io", "guard_output", "mask", "redact"]
