"""Inputs whose results are prescribed, as they stand, with the scores and texts that must come out."""

VECTORS = {  # id: (text, wanted types, unwanted types)
    "FW-1": ("I have reached 7000138006 followers, please reach out to me", [], ["PHONE"]),
    "FW-4": ("Call me at 9876543210 for the meeting.", ["PHONE"], []),
    "USER-3a": ("password policy: minimum 8 characters", [], ["PASSWORD"]),
    "USER-4": ("My account number is 12345678901234", ["BANK_ACCOUNT"], []),
    "EC-1": ("Tracking: 4532015112830366", [], ["CREDIT_CARD"]),
    "EC-2": ("Order ID: 2345 6789 0123", [], ["AADHAAR"]),
    "EC-2b": ("Aadhaar: 2345 6789 0123", ["AADHAAR"], []),
    "EC-3b": ("Address: 123 MG Road, Bangalore, Pin: 560001", ["PINCODE"], []),
    "EC-11": ("The weather today is nice. I love programming in Python.", [], ["EMAIL", "PHONE", "AADHAAR", "CREDIT_CARD", "PASSWORD"]),
    "POSITIVE": ("Name: Priya Mehta | Aadhaar: 2345 6789 0123 | PAN: ABCDE1234F | Email: priya@gmail.com | Phone: +91-9876543210",
                 ["AADHAAR", "PAN", "EMAIL", "PHONE"], []),
    "POSITIVE-4": ("Email: admin@company.com Password: S3cret!Pass", ["EMAIL", "PASSWORD"], []),
}

GOLDEN = {  # id: (base score, final score, level, text)
    "FW-1": (0.0, 0.0, "LOW", "I have reached 7000138006 followers, please reach out to me"),
    "FW-4": (68.73, 68.73, "HIGH", "Call me at [PHONE_REDACTED] for the meeting."),
    "EC-2b": (86.0, 86.0, "CRITICAL", "Aadhaar: [AADHAAR_REDACTED]"),
    "EC-3b": (28.75, 28.75, "MEDIUM", "Address: 123 MG Road, Bangalore, Pin: PINCODE_TOKEN_46FD88B7"),
    "USER-3a": (0.0, 0.0, "LOW", "password policy: minimum 8 characters"),
    "USER-4": (75.735, 75.735, "CRITICAL", "My [BANK_ACCOUNT_REDACTED]"),
    "POSITIVE": (76.31, 100.0, "CRITICAL", "Name: Priya Mehta | Aadhaar: [AADHAAR_REDACTED] | PAN: [PAN_REDACTED] | "
                 "Email: [EMAIL_REDACTED] | Phone: +91-[PHONE_REDACTED]"),
    "POSITIVE-4": (59.25, 100.0, "CRITICAL", "Email: [EMAIL_REDACTED] [PASSWORD_REDACTED]"),
}
UNCHANGED = ["FW-1", "USER-3a", "EC-11"]
