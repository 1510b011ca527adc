"""Finding types: names, dotted labels, specificity tiers and label aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names and their specificity tier (4 = finest).
SPECIFICITY: dict[str, int] = {
    "EMAIL_ADDRESS": 3,
    "PHONE_NUMBER": 2,
    "IP_ADDRESS": 2,
    "CREDIT_CARD": 3,
    "US_SSN": 3,
    "IBAN_CODE": 3,
    "API_KEY": 3,
    "URL": 2,
    "DATE_TIME": 1,
    "US_ZIP_CODE": 3,
    "PERSON": 1,
    "LOCATION": 1,
    "ORGANIZATION": 1,
    "CITY": 3,
    "US_STATE": 3,
    "STREET_ADDRESS": 3,
    "COUNTRY": 3,
    "NATIONALITY": 2,
    "TITLE": 2,
    "MEDICAL_RECORD": 3,
    "AGE": 2,
    "SWIFT_CODE": 3,
    "US_BANK_NUMBER": 3,
    "US_PASSPORT": 3,
    "US_DRIVER_LICENSE": 3,
    "IDENTITY_PERSON_NAME": 3,
    "IDENTITY_NATIONAL_ID": 3,
    "IDENTITY_PASSPORT": 3,
    "IDENTITY_DRIVERS_LICENSE": 3,
    "IDENTITY_DATE_OF_BIRTH": 3,
    "IDENTITY_TAX_ID": 3,
    "CONTACT_EMAIL": 3,
    "CONTACT_PHONE": 3,
    "CONTACT_ADDRESS": 3,
    "CONTACT_POSTAL_CODE": 3,
    "CONTACT_IP_ADDRESS": 3,
    "FINANCIAL_CREDIT_CARD": 3,
    "FINANCIAL_IBAN": 3,
    "FINANCIAL_BANK_ACCOUNT": 3,
    "FINANCIAL_SWIFT_BIC": 3,
    "FINANCIAL_CRYPTO_WALLET": 3,
    "FINANCIAL_AMOUNT": 2,
    "CREDENTIAL_API_KEY": 3,
    "CREDENTIAL_PASSWORD": 3,
    "CREDENTIAL_PRIVATE_KEY": 3,
    "CREDENTIAL_JWT": 3,
    "CREDENTIAL_CONNECTION_STRING": 3,
    "DEVELOPER_LOGIN_CREDENTIALS": 4,
    "ONLINE_USERNAME": 2,
    "ONLINE_URL": 3,
    "DEVICE_MAC_ADDRESS": 4,
    "DEVICE_IMEI": 4,
    "DEVELOPER_DEVICE_ID": 4,
    "LOCATION_GPS_COORDINATES": 3,
    "HEALTHCARE_MEDICAL_RECORD": 3,
    "HEALTHCARE_CONDITION": 2,
    "HEALTHCARE_MEDICATION": 2,
    "HEALTHCARE_HEALTH_PLAN_ID": 3,
    "ORG_COMPANY_NAME": 3,
    "SPECIAL_RELIGION": 4,
    "SPECIAL_POLITICAL": 4,
    "SPECIAL_ORIENTATION": 4,
    "SPECIAL_HEALTH_STATUS": 4,
    "LEGAL_CASE_NUMBER": 3,
}
DEFAULT_SPECIFICITY = 1

# Prefixes of the domain-labelled types ("identity.person_name" and so on).
DOMAINS = (
    "IDENTITY", "CONTACT", "FINANCIAL", "CREDENTIAL", "DEVELOPER", "ONLINE",
    "DEVICE", "HEALTHCARE", "ORG", "SPECIAL", "LEGAL",
)
DOMAIN_EXTRA = ("LOCATION_GPS_COORDINATES",)

# Other accepted spellings of a type.
LABEL_ALIASES: dict[str, str] = {
    "Email": "EMAIL_ADDRESS",
    "Phone": "PHONE_NUMBER",
    "IP_Address": "IP_ADDRESS",
    "Credit_Card": "CREDIT_CARD",
    "SSN": "US_SSN",
    "IBAN": "IBAN_CODE",
    "API_Key": "API_KEY",
    "CRYPTO": "API_KEY",
    "MEDICAL_LICENSE": "API_KEY",
    "DOMAIN_NAME": "URL",
    "Domain": "URL",
    "DATE": "DATE_TIME",
    "Date": "DATE_TIME",
    "ZIP_CODE": "US_ZIP_CODE",
    "Zip_Code": "US_ZIP_CODE",
    "PER": "PERSON",
    "Person": "PERSON",
    "LOC": "LOCATION",
    "ORG": "ORGANIZATION",
    "NRP": "ORGANIZATION",
    "City": "CITY",
    "US_State": "US_STATE",
    "Street_Address": "STREET_ADDRESS",
    "Country": "COUNTRY",
    "Nationality": "NATIONALITY",
    "Title": "TITLE",
    "Medical_Record": "MEDICAL_RECORD",
    "Age": "AGE",
    "SWIFT": "SWIFT_CODE",
    "identity.ssn": "US_SSN",
    "IDENTITY_SSN": "US_SSN",
}

# Labels written by generative detectors; anything else becomes API_KEY.
GENERATIVE_LABELS: dict[str, str] = {
    "first_name": "PERSON",
    "last_name": "PERSON",
    "email": "EMAIL_ADDRESS",
    "email_address": "EMAIL_ADDRESS",
    "phone_number": "PHONE_NUMBER",
    "street_address": "LOCATION",
    "city": "LOCATION",
    "state": "LOCATION",
    "country": "LOCATION",
    "zip_code": "LOCATION",
    "date_of_birth": "DATE_TIME",
    "date": "DATE_TIME",
    "ssn": "US_SSN",
    "credit_debit_card": "CREDIT_CARD",
    "credit_card": "CREDIT_CARD",
    "bank_routing_number": "API_KEY",
    "account_number": "API_KEY",
    "ip_address": "IP_ADDRESS",
    "url": "URL",
}
GENERATIVE_FALLBACK = "API_KEY"


def dotted_label(pii_type: str) -> str | None:
    """``IDENTITY_PERSON_NAME`` -> ``identity.person_name``; None outside the domains."""
    domain, _, rest = pii_type.partition("_")
    if rest and (domain in DOMAINS or pii_type in DOMAIN_EXTRA):
        return f"{domain.lower()}.{rest.lower()}"
    return None


def alias_table() -> dict[str, str]:
    """Every accepted label with its canonical type."""
    table = {t: t for t in SPECIFICITY}
    table.update({dotted_label(t): t for t in SPECIFICITY if dotted_label(t)})
    table.update(LABEL_ALIASES)
    return table


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[key]


def normalize_label(label: Column) -> Column:
    """Canonical type of a label; unknown labels are kept as they are."""
    return F.coalesce(_lookup(alias_table(), label), label)


def generative_label(label: Column) -> Column:
    """Type for a generative detector's label."""
    return F.coalesce(_lookup(GENERATIVE_LABELS, label), F.lit(GENERATIVE_FALLBACK))


def type_specificity(pii_type: Column) -> Column:
    return F.coalesce(_lookup(SPECIFICITY, pii_type), F.lit(DEFAULT_SPECIFICITY))


def type_dimension(spark: SparkSession) -> DataFrame:
    """Dimension table of the taxonomy (type, dotted_label, specificity)."""
    rows = [(t, dotted_label(t), s) for t, s in SPECIFICITY.items()]
    return spark.createDataFrame(rows, "pii_type string, dotted_label string, specificity int")
