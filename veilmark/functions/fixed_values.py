"""The constants that decide results.

Everything in this module is a *fixed value*: a pattern, word list, weight or
message that must have exactly this content, in exactly this order, for the
results to be right.  Nothing here is logic.  Patterns are written in their
plain form; :mod:`veilmark.functions.text` turns the shorthand classes
(``\\b \\w \\s \\d``) into explicit Unicode classes for the JVM engine.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Identifier patterns.  List order is priority order: a match of
# an earlier type blocks an overlapping match of a later one.
# ---------------------------------------------------------------------------
PATTERNS: list[tuple[str, str]] = [
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+91[\-\s]?)?[6-9]\d{9}\b|\b(?:\+1[\-\s]?)?\(?\d{3}\)?[\-\s]?\d{3}[\-\s]?\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("BANK_ACCOUNT", r"(?i)(?:account|a\/c|acct)\s*(?:no\.?|number|num|#)?\s*(?:is\s+|[:=#\-]\s*)?([0-9]{9,18})\b"),
    ("DATE", r"\b(?:\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2})\b"),
    ("URL", r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)"),
    ("PASSWORD", r"(?i)(?:password|passwd|pwd)[\s:=]+\S+"),
    ("USERNAME", r"(?i)(?:username|user|login)[\s:=]+\S+"),
    ("AADHAAR", r"\b[2-9]{1}[0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"),
    ("VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b"),
    ("DRIVING_LICENSE", r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{11}\b"),
    ("PASSPORT", r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b"),
    ("IFSC_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("UPI_ID", r"\b[\w.\-]{2,256}@(?:ybl|upi|okhdfcbank|okaxis|oksbi|okicici|apl|ibl|paytm|axl|sbi|hdfcbank|icici|fbl|kotak|axisbank|indus|boi|pnb|federal|rbl|idbi|cnrb)\b"),
    ("GST_NUMBER", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}[Z]{1}[A-Z\d]{1}\b"),
    ("PINCODE", r"\b[1-9][0-9]{5}\b"),
]
PASSWORD_PARTS = r"(?i)^(?:password|passwd|pwd)[\s:=]+(\S+)"

# Base confidence given by a detector to a valid match.
DEFAULT_CONFIDENCE = 0.85
BASE_CONFIDENCE = {
    "EMAIL": 0.92, "PHONE": 0.88, "CREDIT_CARD": 0.80, "AADHAAR": 0.90, "PAN": 0.95, "PINCODE": 0.50,
}
PASSWORD_STRONG, PASSWORD_PLAIN = 0.95, 0.55
IP_PUBLIC, IP_PRIVATE = 0.75, 0.60
IP_PRIVATE_PREFIXES = ["192.168.", "10.", "127.", "172."]
TRAILING_PUNCTUATION = ":;,.!?"

# Label maps, cut and constant score of the two annotation sources.
TRANSFORMER_LABELS = {
    "PER": "NAME", "PERSON": "NAME", "DATE": "DATE_OF_BIRTH", "TIME": "DATE_OF_BIRTH", "MONEY": "CREDIT_CARD",
}
TRANSFORMER_MIN_SCORE = 0.50
NER_LABELS = {"PERSON": "NAME", "DATE": "DATE_OF_BIRTH", "MONEY": "CREDIT_CARD"}
NER_CONFIDENCE = 0.78
CHUNK_CHARS, CHUNK_OVERLAP_WORDS = 450, 10

# ---------------------------------------------------------------------------
# Fusion.
# ---------------------------------------------------------------------------
IOU_THRESHOLD = 0.5
SOURCE_PRIORITY = {"regex": 0, "transformer": 1, "spacy": 2}
OTHER_PRIORITY = 3
SOURCE_RELIABILITY = {"regex": 0.92, "transformer": 0.85, "spacy": 0.78}
OTHER_RELIABILITY = 0.80
AGREEMENT_BOOST = {  # type: (two sources, three sources)
    "AADHAAR": (1.05, 1.10),
    "PAN": (1.05, 1.10),
    "CREDIT_CARD": (1.05, 1.10),
    "PASSPORT": (1.06, 1.12),
    "VOTER_ID": (1.06, 1.12),
    "DRIVING_LICENSE": (1.06, 1.12),
    "GST_NUMBER": (1.05, 1.10),
    "IFSC_CODE": (1.05, 1.10),
    "EMAIL": (1.06, 1.12),
    "PHONE": (1.08, 1.15),
    "IP_ADDRESS": (1.08, 1.14),
    "PASSWORD": (1.03, 1.06),
    "NAME": (1.18, 1.28),
    "ADDRESS": (1.15, 1.25),
    "LOCATION": (1.15, 1.25),
    "ORGANIZATION": (1.15, 1.25),
    "DATE_OF_BIRTH": (1.12, 1.22),
    "AGE": (1.10, 1.18),
}
DEFAULT_AGREEMENT_BOOST = (1.12, 1.20)

# ---------------------------------------------------------------------------
# Context validation.  Keywords are *substring* tests.
# ---------------------------------------------------------------------------
CO_OCCURRENCE_TYPES = [  # a document with one of these has "structured" data
    "EMAIL", "PHONE", "AADHAAR", "PAN", "CREDIT_CARD", "PASSPORT", "BANK_ACCOUNT", "VOTER_ID",
    "DRIVING_LICENSE", "GST_NUMBER", "IFSC_CODE", "UPI_ID",
]
STRUCTURED_TYPES = [  # these get the lower acceptance threshold
    "AADHAAR", "PAN", "CREDIT_CARD", "EMAIL", "PASSPORT", "VOTER_ID", "DRIVING_LICENSE", "GST_NUMBER",
    "IFSC_CODE", "PASSWORD", "UPI_ID", "PHONE", "IP_ADDRESS", "BANK_ACCOUNT",
]
CONTEXTUAL_TYPES = [
    "NAME", "LOCATION", "ORGANIZATION", "DATE_OF_BIRTH", "DATE", "URL", "ADDRESS", "AGE", "GENDER",
]
LABEL_SENSITIVE_TYPES = ["AADHAAR", "CREDIT_CARD", "PHONE", "BANK_ACCOUNT", "PINCODE", "IP_ADDRESS", "PAN"]
POSITIVE_KEYWORDS = {
    "EMAIL": ["email", "mail", "contact", "send", "reply", "from:", "to:", "cc:", "e-mail"],
    "PHONE": ["phone", "call", "mobile", "tel", "contact", "whatsapp", "cell", "dial"],
    "AADHAAR": ["aadhaar", "aadhar", "uid", "uidai", "identity", "biometric", "enrolment"],
    "PAN": ["pan", "income tax", "tax", "itr", "permanent account", "pan card"],
    "CREDIT_CARD": ["card", "credit", "debit", "payment", "visa", "mastercard", "amex", "rupay", "cc", "cvv",
                    "expiry"],
    "BANK_ACCOUNT": ["account", "bank", "transfer", "neft", "rtgs", "imps", "savings", "current account", "a/c",
                     "acct"],
    "PASSWORD": ["password", "passwd", "pwd", "login", "credentials", "secret", "passphrase"],
    "ADDRESS": ["address", "street", "road", "lane", "nagar", "colony", "pin", "pincode", "residing",
                "residence"],
    "NAME": ["name", "mr", "mrs", "ms", "dr", "prof", "sir", "madam", "applicant", "holder", "customer",
             "beneficiary"],
    "PASSPORT": ["passport", "travel", "visa", "immigration", "nationality"],
    "PINCODE": ["pin", "pincode", "postal", "zip", "area code", "pin code"],
    "IP_ADDRESS": ["ip", "server", "host", "address", "client", "remote", "proxy"],
    "VOTER_ID": ["voter", "election", "electoral", "voter id"],
    "DRIVING_LICENSE": ["license", "licence", "driving", "dl", "rto"],
    "GST_NUMBER": ["gst", "gstin", "tax", "goods and services"],
    "IFSC_CODE": ["ifsc", "bank", "branch", "neft", "rtgs"],
    "UPI_ID": ["upi", "payment", "pay", "gpay", "phonepe", "paytm"],
}
NEGATIVE_KEYWORDS = {
    "PHONE": ["version", "v.", "release", "model", "year", "chapter", "page", "item", "build", "revision"],
    "AADHAAR": ["order", "invoice", "ticket", "code", "ref", "receipt", "serial", "batch", "lot"],
    "CREDIT_CARD": ["item", "product", "code", "sku", "ref", "order", "tracking", "serial", "batch", "invoice"],
    "BANK_ACCOUNT": ["zip", "postal", "pin", "code", "id", "size", "element", "number of", "n ", "log"],
    "PINCODE": ["version", "build", "release", "population", "count", "total", "score", "code", "id"],
}
QUANTITY_WORDS = [
    "followers", "subscribers", "users", "views", "likes", "downloads", "impressions", "clicks", "shares",
    "posts", "comments", "reviews", "stars", "ratings",
    "items", "records", "entries", "rows", "transactions", "people", "members", "customers", "students",
    "employees", "patients", "votes", "points", "results", "matches",
    "times", "attempts", "steps", "miles", "meters", "km", "kg", "lbs", "dollars", "rupees", "percent", "units",
    "years", "months", "days", "hours", "minutes", "seconds",
    "pages", "chapters", "lines", "words", "characters",
]
ENTITY_KEYWORDS = {  # keywords of the per-type rules
    "PAN": ["pan", "income tax", "tax", "itr", "permanent account", "pan card", "pan no", "taxation"],
    "BANK_ACCOUNT": ["account", "bank", "savings", "current", "neft", "rtgs"],
    "DATE_OF_BIRTH": ["born", "dob", "birth", "age", "birthday", "date of birth"],
    "IP_ADDRESS": ["server", "host", "ip", "address", "request", "log", "connect"],
    "PINCODE": ["pin", "pincode", "postal", "zip", "address", "city", "state", "district", "area", "locality",
                "nagar", "colony", "street", "road"],
}
PRECEDING_LABEL = r"([a-zA-Z][\w\s]{0,25}?)\s*[:=–—]\s*"
LABEL_ENDS = ":=–—"
VERSION_PREFIX = r"\d\.\s*"
CONTEXT_CHARS, PREFIX_CHARS, FOLLOWING_CHARS, VERSION_PREFIX_CHARS = 120, 50, 40, 5
STRUCTURED_THRESHOLD, OTHER_THRESHOLD, RETHRESHOLD = 0.25, 0.30, 0.25

# Factors applied to the confidence, in the order they are applied.
CONFIRMING_LABEL, COMPETING_LABEL = 1.15, 0.20
POSITIVE_CONTEXT, NEGATIVE_CONTEXT, QUANTITY_FOLLOWS = 1.10, 0.65, 0.15
SINGLE_WORD_NAME, ABBREVIATED_NAME = 0.75, 0.50
NO_PAN_CONTEXT, DECIMAL_PREFIX, NO_FINANCE_CONTEXT, BIRTH_CONTEXT = 0.25, 0.15, 0.40, 1.15
TECH_CONTEXT, PLAIN_PASSWORD, SHORT_PASSWORD, NO_ADDRESS_CONTEXT = 1.10, 0.25, 0.50, 0.30
NO_CO_OCCURRENCE, SINGLE_DETECTOR, AGREEING_DETECTORS = 0.20, 0.70, 1.05

# ---------------------------------------------------------------------------
# Recalibration and verifier rescoring.
# ---------------------------------------------------------------------------
PAIR_BOOSTS: list[tuple[str, str, float]] = [
    ("NAME", "EMAIL", 0.05),
    ("NAME", "PHONE", 0.05),
    ("NAME", "ADDRESS", 0.07),
    ("NAME", "DATE_OF_BIRTH", 0.08),
    ("NAME", "AGE", 0.04),
    ("NAME", "GENDER", 0.03),
    ("NAME", "AADHAAR", 0.10),
    ("NAME", "PAN", 0.10),
    ("NAME", "PASSPORT", 0.10),
    ("NAME", "VOTER_ID", 0.09),
    ("NAME", "DRIVING_LICENSE", 0.09),
    ("NAME", "CREDIT_CARD", 0.08),
    ("NAME", "BANK_ACCOUNT", 0.08),
    ("BANK_ACCOUNT", "IFSC_CODE", 0.12),
    ("NAME", "UPI_ID", 0.06),
    ("PHONE", "UPI_ID", 0.08),
]
FREQUENT_OVER, FREQUENT_FACTOR = 3, 1.05
VERIFY_BELOW, VERIFY_MIN_SENTENCE, SENTENCE_REACH = 0.98, 5, 300
HYPOTHESES = {
    "PHONE": "This text contains someone's personal phone number or contact number",
    "CREDIT_CARD": "This text contains a credit card number or payment card number",
    "AADHAAR": "This text contains an Aadhaar identification number",
    "PAN": "This text contains a PAN card number or tax identification number",
    "BANK_ACCOUNT": "This text contains a bank account number",
    "PINCODE": "This text contains a postal PIN code or ZIP code for an address",
}
COUNTER_HYPOTHESIS = (
    "This text contains a general number, count, statistic, version number, identifier, or measurement "
    "that is not sensitive personal information"
)

# ---------------------------------------------------------------------------
# Risk.
# ---------------------------------------------------------------------------
RISK_PROFILE = {  # type: (exposure, fraud, regulatory, abuse)
    "CREDIT_CARD": (0.85, 0.95, 1.00, 0.98),
    "BANK_ACCOUNT": (0.60, 0.90, 0.95, 0.85),
    "UPI_ID": (0.70, 0.65, 0.60, 0.80),
    "IFSC_CODE": (0.80, 0.20, 0.20, 0.15),
    "AADHAAR": (0.65, 0.95, 1.00, 0.90),
    "PAN": (0.75, 0.85, 0.90, 0.80),
    "PASSPORT": (0.40, 0.90, 0.95, 0.75),
    "VOTER_ID": (0.70, 0.40, 0.50, 0.30),
    "DRIVING_LICENSE": (0.55, 0.60, 0.70, 0.50),
    "GST_NUMBER": (0.80, 0.30, 0.40, 0.25),
    "EMAIL": (0.95, 0.50, 0.40, 0.85),
    "PHONE": (0.90, 0.60, 0.50, 0.80),
    "NAME": (0.98, 0.30, 0.30, 0.40),
    "ADDRESS": (0.60, 0.40, 0.40, 0.40),
    "DATE_OF_BIRTH": (0.70, 0.55, 0.50, 0.60),
    "AGE": (0.65, 0.10, 0.10, 0.10),
    "GENDER": (0.85, 0.05, 0.10, 0.05),
}
DEFAULT_PROFILE = (0.5, 0.5, 0.5, 0.5)
PROFILE_SHARES = (0.3, 0.3, 0.2, 0.2)
SENSITIVITY_FLOORS = [("CRITICAL", 70.0), ("HIGH", 40.0), ("MEDIUM", 20.0)]
RISK_FLOORS = [("CRITICAL", 75.0), ("HIGH", 50.0), ("MEDIUM", 25.0)]
REID_FLOORS = [("CRITICAL", 100.0), ("HIGH", 50.0), ("MEDIUM", 20.0)]
LEVEL_STRATEGY = {"LOW": "MASK", "MEDIUM": "TOKENIZE", "HIGH": "REDACT", "CRITICAL": "REDACT"}
NO_PII_ADVICE = "No PII detected. Document appears safe."
LEVEL_ADVICE = {
    "CRITICAL": "⚠️  CRITICAL: Document contains highly sensitive PII. Immediate redaction required.",
    "HIGH": "🔴 HIGH RISK: Document contains sensitive PII. Tokenization/redaction recommended.",
    "MEDIUM": "🟡 MEDIUM RISK: PII detected. Masking recommended before sharing.",
    "LOW": "🟢 LOW RISK: Minor PII detected. Apply masking as a precaution.",
}
TYPE_ADVICE = {
    "AADHAAR": "Aadhaar numbers detected — comply with UIDAI guidelines (full redaction required).",
    "PAN": "PAN numbers detected — comply with Indian IT Act data handling norms.",
    "CREDIT_CARD": "Credit card data detected — PCI-DSS compliance mandatory.",
    "PASSWORD": "🚨 PASSWORDS DETECTED — Redact immediately. Do not transmit or store.",
    "MEDICAL_RECORD": "Medical data detected — HIPAA/DPDP Act compliance required.",
}

# ---------------------------------------------------------------------------
# Dangerous combinations.
# ---------------------------------------------------------------------------
COMBINATIONS: list[tuple[list[str], str, float, str]] = [
    (["NAME", "DATE_OF_BIRTH"], "MEDIUM", 25.0, "Name + DOB can narrow identity significantly"),
    (["NAME", "PHONE"], "HIGH", 35.0, "Name + Phone is often uniquely identifying"),
    (["NAME", "EMAIL"], "HIGH", 30.0, "Name + Email provides direct contact identity"),
    (["NAME", "ADDRESS"], "HIGH", 40.0, "Name + Address is a classic re-identification pair"),
    (["PAN", "NAME"], "HIGH", 45.0, "PAN + Name enables financial identity linkage"),
    (["AADHAAR", "NAME"], "CRITICAL", 60.0, "Aadhaar + Name is a unique national identifier pair"),
    (["AADHAAR", "PHONE"], "CRITICAL", 55.0, "Aadhaar + Phone is linked via UIDAI verification"),
    (["EMAIL", "PHONE"], "HIGH", 35.0, "Email + Phone enables cross-platform identity linking"),
    (["EMAIL", "PASSWORD"], "CRITICAL", 70.0, "Email + Password is a direct credential exposure"),
    (["CREDIT_CARD", "NAME"], "CRITICAL", 55.0, "Credit card + Name enables financial fraud"),
    (["BANK_ACCOUNT", "IFSC_CODE"], "CRITICAL", 60.0, "Account + IFSC fully identifies a bank account"),
    (["BANK_ACCOUNT", "NAME"], "HIGH", 45.0, "Account + Name enables targeted financial fraud"),
    (["UPI_ID", "PHONE"], "HIGH", 40.0, "UPI + Phone identifies fintech transaction source"),
    (["CREDIT_CARD", "DATE"], "HIGH", 35.0, "Card + Transaction date narrows transaction identity"),
    (["NAME", "DATE_OF_BIRTH", "PINCODE"], "CRITICAL", 65.0,
     "Name + DOB + PIN uniquely identifies per Rocher et al."),
    (["NAME", "AGE", "LOCATION"], "HIGH", 40.0, "Name + Age + Location is a strong quasi-ID triplet"),
    (["PAN", "BANK_ACCOUNT", "NAME"], "CRITICAL", 75.0, "PAN + Account + Name is full financial identity"),
    (["AADHAAR", "PAN", "NAME"], "CRITICAL", 80.0, "Aadhaar + PAN + Name is complete Indian identity"),
]
REID_ADVICE = {
    "CRITICAL": "⚠️  CRITICAL RE-IDENTIFICATION RISK: Multiple quasi-identifier combinations detected. "
                "Full redaction of identifying fields required.",
    "HIGH": "🔴 HIGH RE-ID RISK: Entity combinations could enable identity reconstruction. "
            "Apply k-anonymity or suppression.",
    "MEDIUM": "🟡 MODERATE RE-ID RISK: Some quasi-identifier pairs found. "
              "Consider generalization to reduce linkability.",
}
REID_COMBO_LINES = 3
REID_PAIR_ADVICE = [
    (["AADHAAR", "PAN"],
     "Aadhaar + PAN detected — per UIDAI and IT Act guidelines, these must never appear together in shared "
     "documents."),
    (["EMAIL", "PASSWORD"],
     "🚨 Credential pair (Email + Password) detected — immediate suppression required. Potential data breach."),
]

# File intake.
FILE_TYPES = ["pdf", "docx", "csv", "xlsx", "txt"]
BYTES_ONLY_TYPES = ["xls"]
MAX_FILE_BYTES = 10 * 1024 * 1024
