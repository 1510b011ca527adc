"""The built-in pattern recognizers and how a caller adds more.

A recognizer is data: type, confidence, pattern, an optional Column validator and cheap
necessary conditions. Keywords at word starts and number shapes are checked in two short
strings that are cut out of a text in one pass each, whatever the number of recognizers;
other hints are checked with plain byte search.
A pattern only scans a text that passes its conditions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession

from veilframe.functions.checks import iban_ok, luhn_ok

MIN_CONFIDENCE = 0.5


@dataclass(frozen=True)
class Recognizer:
    pii_type: str
    confidence: float
    pattern: str
    words: tuple[str, ...] = ()      # any one (of a-z, 0-9) must begin where no letter a-z stands before, ignoring case
    folded: tuple[str, ...] = ()     # or any one of these must occur anywhere, ignoring case
    digits: str | None = None        # must match in the text's number runs
    digits_alone: bool = False       # the digits and the words are alternatives
    hints: tuple[str, ...] = ()      # any one must occur, case-sensitive
    counts: tuple[tuple[str, int], ...] = ()  # substrings that must occur at least n times
    guard: str | None = None         # cheap necessary regex, checked after the rest
    first: str | None = None         # class of the first character of any match
    ahead: str | None = None         # cheap test that holds where any match begins
    validator: Callable[[Column], Column] | None = None

    def spark_pattern(self) -> str:
        """The pattern with Unicode-aware classes, word boundaries and case folding.

        Unicode word boundaries are costly to test; a lookahead for the first character
        rejects most positions before that, without changing what matches.
        """
        if self.ahead is not None:
            return f"(?U){self.ahead}(?:{self.pattern})"
        if self.first is None:
            return "(?U)" + self.pattern
        return f"(?U)(?=[{self.first}])(?:{self.pattern})"


# Types, confidences and patterns, in the order that breaks ties.
RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer(
        "API_KEY", 0.95,
        r"(?i)\b(?:sk|sk-proj|sk-ant|sk-)[A-Za-z0-9_\-]{20,}\b",
        words=("sk",),
        first=r"sSſ",
    ),
    Recognizer(
        "EMAIL_ADDRESS", 0.90,
        r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        hints=("@",),
    ),
    Recognizer("US_SSN", 0.85, r"\b\d{3}-\d{2}-\d{4}\b", hints=("-",), digits=r"\d{3}-\d{2}-\d{4}", first=r"\d"),
    Recognizer(
        "CREDIT_CARD", 0.80, r"\b(?:\d[ -]*?){13,19}\b", digits=r"\d(?:[ -]*\d){12}", validator=luhn_ok,
        first=r"\d",
    ),
    Recognizer(
        "IBAN_CODE", 0.85, r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}[A-Z0-9]{0,30}\b",
        digits=r"\d{2}", guard=r"[ABCDEFGHIJKLMNOPQRSTUVWXYZ][A-Z]\d{2}[A-Z0-9]{4}", validator=iban_ok,
        first=r"A-Z",
    ),
    Recognizer(
        "IP_ADDRESS", 0.90,
        r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b",
        hints=(".",), digits=r"\d\.\d{1,3}\.\d{1,3}\.\d",
        first=r"\d",
    ),
    Recognizer(
        "PHONE_NUMBER", 0.70,
        r"\+\d{1,3}(?:[ -]?\d{2,4}){3,4}\b"
        r"|(?:\+?\d{1,3}[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}\b"
        r"|(?:\+?\d{1,3}[-.\s])?\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
        digits=r"\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}|\+\d(?:[ -]?\d){6}",
        first=r"\d+(",
    ),
    # Stack-safe form of
    # (?i)(?:(?:https?://)|(?:\b))(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?:/[^\s]*)?
    # Labels are taken possessively up to the last one that two letters follow.
    Recognizer(
        "URL", 0.50,
        r"(?i)(?:(?:https?://)|(?:\b))"
        r"(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.(?![A-Za-z]{2}))*+"
        r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.(?=[A-Za-z]{2}))++"
        r"[A-Za-z]{2,}(?:/[^\s]*)?",
        hints=(".",), guard=r"\.[A-Za-z\u017F\u212A]{2}",
        ahead=r"(?:(?<![A-Za-z0-9_\u0130\u0131\u017F\u212A])(?=[A-Za-z0-9\u0130\u0131\u017F\u212A][A-Za-z0-9\u0130\u0131\u017F\u212A-]*+\.)|(?=[hH][tT][tT][pP]))",
    ),
    Recognizer(
        "DATE_TIME", 0.60,
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
        r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b",
        digits=r"\d[/-]\d{1,2}[/-]\d|\d,?\s+\d{4}",
        guard=r"(?:^|[^\d])\d{1,2}[/-]\d{1,2}[/-]\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d",
        first=r"\dA-Z",
    ),
    Recognizer(
        "US_ZIP_CODE", 0.65,
        r"(?i)\b(?:zip(?:\s+code)?|postal(?:\s+code)?)\s*[:#-]?\s*\d{5}(?:-\d{4})?\b",
        words=("zip", "postal"), digits=r"\d{5}",
        first=r"zZpP",
    ),
    Recognizer("IDENTITY_TAX_ID", 0.80, r"\b\d{2}-\d{7}\b", hints=("-",), digits=r"\d{2}-\d{7}", first=r"\d"),
    Recognizer(
        "FINANCIAL_AMOUNT", 0.55,
        r"\$\s?\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\$\d{1,3}(?:\.\d{2})?\b"
        r"|\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?(?:USD|EUR|GBP|PHP|JPY)\b",
        words=("usd", "eur", "gbp", "php", "jpy"), folded=("$",), digits=r"\d", guard=r"\$|USD|EUR|GBP|PHP|JPY",
        first=r"\d$",
    ),
    Recognizer(
        "FINANCIAL_CRYPTO_WALLET", 0.85,
        r"\bbc1[ac-hj-np-z02-9]{8,87}\b|\b0x[a-fA-F0-9]{40}\b",
        words=("bc1", "0x"),
        first=r"b0",
    ),
    Recognizer(
        "CREDENTIAL_JWT", 0.90,
        r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
        words=("eyj",), hints=("eyJ",),
        first=r"e",
    ),
    Recognizer(
        "CREDENTIAL_PRIVATE_KEY", 0.95,
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        words=("begin",), hints=("-----BEGIN ",),
    ),
    Recognizer(
        "CREDENTIAL_PASSWORD", 0.85,
        r"(?i)\b(?:password|passwd|pwd)\s*(?:(?:[:=])|\bis\s+)\s*\S+",
        words=("passw", "pwd"),
        first=r"pP",
    ),
    # Possessive form of (?i)(?:[a-z_ ]+\s*=\s*[^;]+;\s*){3,}: the backtracking one overflows the
    # stack on long key=value texts. The lookbehind starts each run of words only once.
    Recognizer(
        "CREDENTIAL_CONNECTION_STRING", 0.80,
        r"(?i)(?<![a-z_ ])(?:[a-z_ ]++\s*+=[^;]++;\s*+){3,}+",
        hints=("=",), counts=(("=", 3), (";", 3)),
    ),
    Recognizer(
        "DEVELOPER_LOGIN_CREDENTIALS", 0.75,
        r"(?i)\b(?:login|username|user|account)\s*[:=]\s*\S+\s+(?:password|pass|pwd)\s*[:=]\s*\S+"
        r"|(?i)(?:login|username|user|account)\s*[:=]\s*\S+\s*/\s*(?:password|pass|pwd)\s*[:=]\s*\S+",
        words=("pass", "pwd"), guard=r"(?i)log[i\u0130\u0131]n|user|account",
        first=r"lLuUaA",
    ),
    Recognizer(
        "DEVICE_MAC_ADDRESS", 0.85,
        r"\b[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}\b"
        r"|\b[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}\b",
        hints=(":", "-"), guard=r"[:-][0-9A-Fa-f]{2}[:-]",
        first=r"0-9A-Fa-f",
    ),
    Recognizer(
        "DEVICE_IMEI", 0.75,
        r"\b(?:\d{15}|\d{2}[ -]?\d{6}[ -]?\d{6}[ -]?\d{1})\b",
        digits=r"\d{2}[ -]?\d{6}[ -]?\d{6}[ -]?\d",
        first=r"\d",
    ),
    Recognizer(
        "DEVELOPER_DEVICE_ID", 0.70,
        r"(?i)\b(?:device[ _-]?id|udid)\s*[:=]\s*[A-Za-z0-9_-]{8,}\b",
        words=("device", "udid"),
        first=r"dDuU",
    ),
    Recognizer(
        "HEALTHCARE_HEALTH_PLAN_ID", 0.70,
        r"(?i)\b(?:member[ _-]?id|health[ _-]?plan|insurance[ _-]?id|policy[ _-]?(?:no\.?|number)?)\s*[:#-]?\s*[A-Z0-9-]{6,}\b",
        words=("member", "health", "insurance", "policy"),
        guard=r"(?i)member[ _-]?[i\u0130\u0131]d|health[ _-]?plan|[i\u0130\u0131]nsurance[ _-]?[i\u0130\u0131]d|pol[i\u0130\u0131]cy",
        first=r"mMhHiI\u0130\u0131pP",
    ),
    Recognizer(
        "IDENTITY_PASSPORT", 0.80,
        r"(?i)\bpassport\s*(?:no\.?|number)?\s*[:#-]?\s*[A-Z0-9]{6,12}\b",
        words=("passport",),
        first=r"pP",
    ),
    Recognizer(
        "IDENTITY_NATIONAL_ID", 0.70,
        r"(?i)\b(?:national[ _-]?id|id\s*number|identity\s*(?:card|number))\s*[:#-]?\s*[A-Z0-9-]{5,15}\b",
        words=("national", "number", "idnumber", "identity"),
        guard=r"(?i)[i\u0130\u0131]d\s*number|nat[i\u0130\u0131]onal[ _-]?[i\u0130\u0131]d|[i\u0130\u0131]dent[i\u0130\u0131]ty\s*(?:card|number)",
        first=r"nNiI\u0130\u0131",
    ),
    Recognizer(
        "IDENTITY_DRIVERS_LICENSE", 0.75,
        r"(?i)\b(?:driver'?s?\s*licen[cs]e|licen[cs]e\s*(?:no\.?|number)?|dl\s*(?:no\.?|number)?)\s*[:#-]?\s*[A-Z0-9-]{4,12}\b",
        words=("licen", "driver", "dl"),
        first=r"dDlL",
    ),
    Recognizer(
        "HEALTHCARE_MEDICAL_RECORD", 0.75,
        r"(?i)\b(?:mrn|medical[ _-]?record|chart\s*(?:no\.?|number)?|patient[ _-]?id)\s*[:#-]?\s*[A-Z0-9-]{4,12}\b",
        words=("mrn", "medical", "chart", "patient"),
        first=r"mMcCpP",
    ),
    Recognizer(
        "FINANCIAL_BANK_ACCOUNT", 0.70,
        r"(?i)\b(?:account\s*(?:no\.?|number)?|bank[ _-]?account)\s*[:#-]?\s*\d{6,17}\b",
        words=("account", "bank"), digits=r"\d{6}",
        first=r"aAbB",
    ),
    Recognizer(
        "LEGAL_CASE_NUMBER", 0.75,
        r"(?i)\b(?:case\s*(?:no\.?|number)?|docket\s*(?:no\.?|number)?)\s*[:#-]?\s*[A-Z0-9-]{4,15}\b"
        r"|\b[A-Z0-9]{2}-[A-Z0-9]{3,12}\s+(?:case|docket)\b",
        words=("case", "docket"),
    ),
    Recognizer(
        "LOCATION_GPS_COORDINATES", 0.75,
        r"-?\d{1,3}\.\d{3,}\s*,\s*-?\d{1,3}\.\d{3,}",
        hints=(",",), digits=r"\.\d{3,}\s*,\s*-?\d{1,3}\.\d{3}",
        first=r"\d-",
    ),
    Recognizer(
        "ONLINE_USERNAME", 0.70,
        r"(?i)(?:^|\s)@[A-Za-z0-9_.]{3,30}\b|\b(?:username|user|login)\s*[:=]\s*[A-Za-z0-9_.-]{3,30}\b",
        words=("user", "login"), folded=("@",), guard=r"(?i)(?:^|\s)@|(?:user|name|log[i\u0130\u0131]n)\s*[:=]",
        ahead=r"(?=[@uUlL]|\s@)",
    ),
    Recognizer("ONLINE_URL", 0.85, r"\bhttps?://[^\s<>\"']+", words=("http",), hints=("://",), first=r"h"),
    Recognizer(
        "SPECIAL_RELIGION", 0.55,
        r"\b(?:Catholic|Protestant|Muslim|Jewish|Hindu|Buddhist|Sikh|Mormon|atheist|agnostic)\b",
        words=("catholic", "protestant", "muslim", "jewish", "hindu", "buddhist", "sikh", "mormon",
               "atheist", "agnostic"),
        first=r"A-Za",
    ),
    Recognizer(
        "SPECIAL_POLITICAL", 0.55,
        r"\b(?:Democratic Party|Republican Party|Socialist(?: Party)?|Communist(?: Party)?|Green Party|Libertarian(?: Party)?)\b",
        words=("democratic", "republican", "green", "socialist", "communist", "libertarian"),
        hints=(" Party", "Socialist", "Communist", "Libertarian"),
        first=r"A-Z",
    ),
    Recognizer(
        "SPECIAL_ORIENTATION", 0.55,
        r"\b(?:LGBTQ\+?|gay|lesbian|bisexual|transgender|queer|homosexual|heterosexual)\b",
        words=("lgbtq", "gay", "lesbian", "bisexual", "transgender", "queer", "homosexual", "heterosexual"),
        first=r"Lglbtqh",
    ),
    Recognizer(
        "SPECIAL_HEALTH_STATUS", 0.55,
        r"\b(?:HIV\+?|seropositive|hepatitis [BC]|terminal(?:ly)? (?:ill|illness)|hospice)\b",
        words=("hiv", "seropositive", "hepatitis", "terminal", "hospice"),
        first=r"Hsth",
    ),
    Recognizer(
        "HEALTHCARE_CONDITION", 0.60,
        r"(?i)\b(?:type 2? diabetes|diabetes mellitus|hypertension|congestive heart failure|chronic obstructive pulmonary disease"
        r"|COPD|asthma|cancer|epilepsy|depression|anxiety|arthritis|migraine|alzheimer'?s|parkinson'?s)\b",
        words=("diabetes", "hypertension", "congestive", "chronic", "copd", "asthma", "cancer", "epilepsy",
               "depression", "anxiety", "arthritis", "migraine", "alzheimer", "parkinson"),
        first=r"tTdDhHcCaAeEmMpP",
    ),
    Recognizer(
        "HEALTHCARE_MEDICATION", 0.60,
        r"\b\d+\s*(?:mg|mcg|g|units?|ml)\s+(?:of\s+)?[A-Z][a-zA-Z]+\b"
        r"|\b(?:metformin|lipitor|amoxicillin|ibuprofen|insulin|atorvastatin|lisinopril|omeprazole|levothyroxine)\b",
        words=("metformin", "lipitor", "amoxicillin", "ibuprofen", "insulin", "atorvastatin", "lisinopril",
               "omeprazole", "levothyroxine"),
        digits=r"\d\s*[mgu]", digits_alone=True,
        first=r"\dmlaio",
    ),
)


def custom_recognizer(
    pii_type: str,
    pattern: str,
    confidence: float,
    validator: Callable[[Column], Column] | None = None,
) -> Recognizer:
    """A user recognizer. ``validator`` maps the matched-text Column to a boolean Column."""
    if not pattern:
        raise ValueError("empty pattern")
    return Recognizer(pii_type, float(confidence), pattern, validator=validator)


def active_recognizers(
    recognizers: Iterable[Recognizer] = RECOGNIZERS,
    min_confidence: float = MIN_CONFIDENCE,
    enabled_types: Iterable[str] | None = None,
) -> list[Recognizer]:
    """Drop recognizers below the confidence floor or outside the enabled types.

    Done while the plan is built, so their patterns never run.
    """
    allowed = None if enabled_types is None else set(enabled_types)
    return [
        r for r in recognizers
        if r.confidence >= min_confidence and (allowed is None or r.pii_type in allowed)
    ]


def recognizer_for(pii_type: str) -> Recognizer:
    return next(r for r in RECOGNIZERS if r.pii_type == pii_type)


def pattern_error(spark: SparkSession, pattern: str | None) -> str | None:
    """What is wrong with a hand-written pattern for the engine that runs it; null if nothing."""
    if pattern is None:
        return "no pattern"
    try:
        spark.sql("select '' rlike :p", args={"p": "(?U)" + pattern}).collect()
    except PySparkException as error:
        return str(error).splitlines()[0]
    return None
