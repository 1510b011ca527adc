"""Key words and number runs: necessary conditions of the recognizers, each cut out in one pass."""

from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.recognizers import RECOGNIZERS, Recognizer, recognizer_for
from veilframe.operators import detect as D
from veilframe.plans.fixtures import SENTENCES

AWKWARD = [
    "id number: AB12345", "idnumber AB12345", "bankaccount 123456789", "bank_account 1234567", "driverslicense D1234567",
    "driver'slicence D1234567", "user:bob@user: carol login=dave", "@user_name x", "xlogin: a /pass: b", "PASſWORD: x", "äpassword: x",
    "SK12ABCDEFGH0123456789012", "sksk-aaaaaaaaaaaaaaaaaaaaaaaa", "+1 5551234567", "+15551234567", "5+1 555 123 4567", "(555) 123-4567x", "A+49 30 123456",
    "GB82WEST12345698765432", "1 GB82WEST12345698765432", "5mGB82WEST12345698765432", "10 mg  of Lipitor", "7g Aspirin", "1.5 units of Insulin",
    "5 EUR", "5EUR", "Europa 5 EUR, $ 1,000", "$5", "de:ad:be:ef:00:11", "DE-AD-BE-EF-00-11", "http://a.bc/x", "xhttp://a.bc y", "a-b.c-d.ee -x.yy _z.ww",
    "Ḱ.com ſ.com", "a.b.c.de", "x" * 70 + ".com", "policy policypassport passport AB1234567", "Green Party greenParty", "heterosexual homosexual",
    "0xabcdef0123456789abcdef0123456789abcdef01", "bc1bc1qxy2kgdygj 0x", "-----BEGIN PRIVATE KEY-----", "beginning -----BEGIN RSA PRIVATE KEY-----", "DLno. AB1234",
    "case23-CV-0987 AB-1234 docket", "zippostal 12345 zip 12345", "type diabetes type 2 diabetes", "", "İzip 94043 zıp 94043 K", "eyJ", "terminally ill HIV+ hepatitis B",
]


def test_no_match_is_lost(spark):
    """Guarded recognizers and bare patterns agree on texts alone, in upper case, and joined with each planted sentence."""
    texts = AWKWARD + [t.upper() for t in AWKWARD] + [f"{s} {t}{s}" for i, t in enumerate(AWKWARD) for s in SENTENCES[i % 5 :: 5]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    bare = [Recognizer(r.pii_type, r.confidence, r.pattern, validator=r.validator) for r in RECOGNIZERS]
    cols = ("id", "pii_type", "start", "end")
    a = {tuple(r) for r in D.explode_spans(D.find_spans(df, out="spans"), "id").select(*cols).collect()}
    b = {tuple(r) for r in D.explode_spans(D.find_spans(df, recognizers=bare, out="spans"), "id").select(*cols).collect()}
    # A dotless or dotted capital i stands for i in the engine's patterns only; the folded text has never matched it.
    odd = {i for i, t in enumerate(texts) if "ı" in t or "İ" in t}
    assert a <= b and {x for x in b - a if x[0] not in odd} == set()


def test_words_inside_words_do_not_start_a_pattern(spark):
    """Letters of a key word inside other words used to send a text through the pattern."""
    rows = [("IDENTITY_DRIVERS_LICENSE", "a handle, endlich"), ("DEVICE_MAC_ADDRESS", "well-known: yes"), ("IBAN_CODE", "in 1999"),
            ("PHONE_NUMBER", "no. 1234")]
    for kind, text in rows:
        rules = S.ranked([recognizer_for(kind)], "pattern")
        df = spark.createDataFrame([(text,)], "text string").withColumn("f", S.fold_case(F.col("text")))
        df = df.withColumns({"w": S.key_words(F.col("f"), rules), "r": S.number_runs(F.col("text"))})
        assert not df.select(S.could_match(rules[0].rec, F.col("text"), F.col("f"), F.col("w"), F.col("r"))).first()[0], kind
