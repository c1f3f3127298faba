"""Security signatures, matched on raw line and message together."""

from pyspark.sql import Column, functions as F

from siltlog.functions.text import SPACE

# Signal types and their patterns, matched ignoring case.
SIGNATURES = (
    ("PATH_TRAVERSAL", r"(?:/etc/passwd|\.\./|\.\.\\|/proc/|/var/log)"),
    (
        "SQL_INJECTION",
        r"(?:['\"]?\s*(?:OR|AND|UNION)\s+\d|SELECT\s+.*FROM|DROP\s+TABLE|--\s*$|%27|%22.*(?:OR|AND))",
    ),
    (
        "XSS_PROBE",
        r"(?:<script|javascript:|onerror\s*=|onload\s*=|<xsstag>|domxss|<img\s+src)",
    ),
    ("ADMIN_BRUTE_FORCE", r"(?:/administrator/|/admin/|/wp-admin|/login).*(?:POST|5\d{2})"),
    ("DIRECTORY_FORBIDDEN", r"(?:Directory index forbidden|forbidden by rule)"),
    (
        "CREDENTIAL_PROBE",
        r"(?:task=user\.login|task=registration|/wp-login|auth|token)",
    ),
    ("SCANNER_SIGNATURE", r"(?:acunetix|nikto|sqlmap|nmap|wvstest|dirbuster)"),
)


def signal_types(raw: Column, message: Column) -> Column:
    """Array of the signal types that match, in signature order."""
    text = F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
    hits = [
        F.when(text.rlike("(?i)" + pattern.replace(r"\s", SPACE)), F.lit(name))
        for name, pattern in SIGNATURES
    ]
    return F.array_compact(F.array(*hits))
