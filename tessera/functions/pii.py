"""Validators of personal data as expressions, and hints by column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of whole values, most specific first
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"
IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\z"
CARD = r"^([0-9][ -]?){13,16}\z"
PHONE = r"^\+?[0-9\s().-]{7,}\z"
PHONE_MARK = r"[+ ().-]"
OCTETS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z"

# fixed values: substrings of column names and what they imply
NAME_HINTS = {
    "email": "email",
    "e_mail": "email",
    "phone": "phone",
    "mobile": "phone",
    "ssn": "ssn",
    "social_security": "ssn",
    "passport": "passport",
    "credit": "credit_card",
    "card_number": "credit_card",
    "iban": "iban",
    "name": "name",
    "surname": "name",
    "address": "address",
    "street": "address",
    "zip": "postal_code",
    "postal": "postal_code",
    "dob": "date_of_birth",
    "birth": "date_of_birth",
}


def validators(value: Column) -> dict[str, Column]:
    """Whether a value is of each kind."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    card = F.when(value.rlike(CARD), F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))).otherwise(False)
    ip = F.when(value.rlike(OCTETS), F.forall(octets, lambda x: F.coalesce(x <= 255, F.lit(False)))).otherwise(False)
    return {"email": value.rlike(EMAIL), "ssn": value.rlike(SSN), "iban": value.rlike(IBAN), "credit_card": card, "ip": ip, "phone": value.rlike(PHONE) & value.rlike(PHONE_MARK)}


def name_hint(column: str) -> str | None:
    lowered = column.lower()
    return next((kind for hint, kind in NAME_HINTS.items() if hint in lowered), None)
