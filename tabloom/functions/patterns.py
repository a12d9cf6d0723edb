"""Text patterns and replacement marks."""

# Page redaction, applied in this order.
PAGE_PII = (
    ("email", r"[\w\.-]+@[\w\.-]+", "[REDACTED_EMAIL]"),
    ("phone", r"\b\+?\d[\d\s\-]{7,}\b", "[REDACTED_PHONE]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
)

# Counted redaction, applied in this order.
COUNTED_PII = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "<REDACTED_EMAIL>"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b|\b\(\d{3}\)\s?\d{3}[-.]?\d{4}\b", "<REDACTED_PHONE>"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "<REDACTED_SSN>"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "<REDACTED_CC>"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "<REDACTED_IBAN>"),
)

# Numbers with an optional dollar sign and thousands commas; words of a page.
NUMBER = r"\$?\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\b"
TOKEN = r"[A-Za-z][A-Za-z\-]{1,20}"

# Pages that are not read.
PROFILE_URLS = ("linkedin.com/in/", "facebook.com/", "instagram.com/")

# A fenced or a bare JSON object in an answer; keys it must have.
FENCED_JSON = r"(?s)```json\s*(\{.*?\})\s*```"
BARE_JSON = r"(?s)(\{.*\})"
PRIORS_KEYS = ("schema_hint", "priors", "dependencies", "examples")
