"""Row functions as column expressions: they stay inside code generation.

Only ``fold_marks`` (compatibility decomposition, which Spark lacks) is an Arrow
function; ``normalize_names`` hands it names that are not ASCII and nothing else.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that decide results: legal suffixes, and synonyms of methods, entry types and expense classes.
LEGAL_SUFFIXES = ("INC", "INCORPORATED", "LLC", "LLP", "LP", "PLLC", "CO", "COMPANY", "CORP", "CORPORATION", "LTD", "LIMITED", "PC", "PA", "SC", "DBA")
METHODS = {
    "CHECK": ("check", "cheque", "chk", "chck", "paper check", "bill pay check"),
    "ACH": ("ach", "eft", "direct deposit", "bank transfer", "e-transfer", "electronic transfer", "bill.com ach"),
    "WIRE": ("wire", "wire transfer", "fedwire", "swift"),
    "CASH": ("cash", "petty cash", "currency"),
    "CREDIT_CARD": ("credit card", "creditcard", "cc", "card", "visa", "mastercard", "amex", "american express", "discover", "debit card", "bill.com card", "corporate card", "p-card", "purchasing card"),
    "TPSO": ("paypal", "stripe", "square", "venmo", "zelle business", "third party", "third-party network", "tpso", "gusto", "bill.com", "melio", "wise"),
}
# The reference numbers that may end a method's text, in the order in which they go.
METHOD_TAILS = (r"\s*#\s*\w+$", r"\s+(no|num|ref|reference)\.?\s*\w+$", r"\s+\d+$")
ENTRY_TYPES = {
    "REVERSAL": ("REVERSAL", "REVERSE", "REVERSED", "CREDIT_MEMO", "CREDIT"),
    "REFUND": ("REFUND", "REFUNDED", "RETURN"),
    "VOID": ("VOID", "VOIDED", "CANCELLED", "CANCELED"),
    "PAYMENT": ("PAYMENT", "PAYMENT_", "BILL_PAYMENT", "CHECK", "SPEND_MONEY"),
}
EXPENSE_CLASSES = {
    "SERVICES": ("SERVICES", "SERVICE", "CONTRACT_LABOR", "CONTRACTOR", "PROFESSIONAL_FEES", "SUBCONTRACTOR", "CONSULTING", "LABOR"),
    "MERCHANDISE": ("MERCHANDISE", "GOODS", "INVENTORY", "SUPPLIES", "MATERIALS", "PARTS"),
    "RENT": ("RENT", "LEASE", "RENTAL"),
    "REIMBURSEMENT": ("REIMBURSEMENT", "EXPENSE_REIMBURSEMENT", "MILEAGE", "TRAVEL_REIMBURSEMENT"),
}
DATE_FORMATS = {
    "QUICKBOOKS": ("MM/dd/yyyy", "M/d/yyyy"),
    "XERO": ("yyyy-MM-dd", "yyyy/MM/dd"),
    "SPREADSHEET": ("d-MMM-yy", "d-MMM-yyyy", "M/d/yy", "M/d/yyyy", "yyyy-MM-dd"),
    "CANONICAL": ("yyyy-MM-dd",),
}
#: What a text that a format fits must look like at least: a format that cannot fit costs a failed parse, an exception, on every row.
DATE_SHAPES = {
    "MM/dd/yyyy": r"/\+?[0-9]{4,}$", "M/d/yyyy": r"/\+?[0-9]{4,}$", "M/d/yy": "/[0-9]{2}$", "d-MMM-yy": "[A-Za-z]-[0-9]{2}$", "d-MMM-yyyy": r"[A-Za-z]-\+?[0-9]{4,}$", "yyyy-MM-dd": "[0-9]-[0-9]{2}-[0-9]{2}$", "yyyy/MM/dd": "[0-9]/[0-9]{2}/[0-9]{2}$",
}
EXCEL_FIRST, EXCEL_LAST = 32_874, 54_789
UNIT = "\x1f"


def _lookup(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in table.items():
        out = out.when(value.isin(*words), F.lit(name))
    return out


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


# -- text ---------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, once for each distinct text of a batch."""
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M")
    known = {x: fold(x) for x in s.dropna().unique()}
    return s.map(known.get).astype(object)


def name_norm(folded: Column) -> Column:
    """Normal form of a vendor name whose marks are folded: upper case, [A-Z0-9] tokens, runs of 2 to 4 single letters joined (longer runs stay), a leading THE and stacked legal suffixes dropped while a token stays."""
    c = F.trim(F.regexp_replace(F.upper(F.coalesce(folded, F.lit(""))), "[^A-Z0-9]+", " "))
    single = "(?<![^ ])(?<!(?<![^ ])[A-Z] )([A-Z]) ([A-Z])(?: ([A-Z]))?(?: ([A-Z]))?(?! [A-Z](?: |$))(?= |$)"
    c = F.regexp_replace(c, single, "$1$2$3$4")
    c = F.regexp_replace(c, "^THE (?=.)", "")
    return F.regexp_replace(c, f"(?<=[A-Z0-9])(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")


def normalize_names(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add ``out``, the normal form of ``raw``, to each row in one reading of ``df``, without a join: to Python an ASCII name is a null."""
    plain = F.octet_length(raw) == F.char_length(raw)
    folded = F.coalesce(F.when(plain, F.col(raw)), fold_marks(F.when(~plain, F.col(raw))))
    return df.withColumn(out, name_norm(folded))


def payment_method(raw: Column) -> Column:
    """Canonical method of a text as it stands, else of the text without the reference numbers at its end; what is unknown counts (it is not a card)."""
    text = F.regexp_replace(F.translate(F.lower(F.trim(raw)), "_", " "), r"\s+", " ")
    plain = F.trim(reduce(lambda c, tail: F.regexp_replace(c, tail, ""), METHOD_TAILS, text))
    found = F.coalesce(*[_lookup(c, METHODS) for c in (text, plain)])
    return F.when(blank(raw), "UNKNOWN").otherwise(F.coalesce(found, F.lit("UNKNOWN")))


def is_card_or_tpso(method: Column) -> Column:
    return method.isin("CREDIT_CARD", "TPSO")


def _code(raw: Column) -> Column:
    return F.translate(F.upper(F.trim(raw)), "- ", "__")


def entry_type(raw: Column, cents: Column) -> Column:
    by_sign = F.when(cents < 0, "REVERSAL").otherwise("PAYMENT")
    return F.when(blank(raw), by_sign).otherwise(F.coalesce(_lookup(_code(raw), ENTRY_TYPES), by_sign))


def expense_class(raw: Column) -> Column:
    return F.when(blank(raw), "SERVICES").otherwise(F.coalesce(_lookup(_code(raw), EXPENSE_CLASSES), F.lit("OTHER")))


def tin_digits(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")


def tin_status(raw: Column) -> Column:
    return F.when(blank(raw), "MISSING").when(F.length(tin_digits(raw)) != 9, "MALFORMED").otherwise("PRESENT")


def tin_kind(raw: Column, declared: Column) -> Column:
    d = F.upper(F.trim(declared))
    dash = F.instr(raw, "-")
    return F.when(d.startswith("E"), "EIN").when(d.startswith("S"), "SSN").when(dash == 3, "EIN").when(dash == 4, "SSN").otherwise("UNKNOWN")


def tin_mask(raw: Column) -> Column:
    """Last four digits of a malformed number, if it has so many."""
    d = tin_digits(raw)
    return F.when(raw.isNull(), None).when(F.length(d) >= 4, F.concat(F.lit(MASK), F.substring(d, -4, 4))).otherwise("***")


# The forms of a personal number and what stands for all but its last four digits. A dashed form has no digit or dash beside it, a bare one no digit.
NUMBER_FORMS = (r"(?<![\d-])\d{3}-\d{2}-(\d{4})(?![\d-])", r"(?<![\d-])\d{2}-\d{3}(\d{4})(?![\d-])", r"(?<!\d)\d{5}(\d{4})(?!\d)")
MASK = "***-**-"


def log_mask(text: Column) -> Column:
    """Personal numbers in free text: dashed SSN, dashed EIN, bare nine digits, in that order; the last four stay."""
    return reduce(lambda c, form: F.regexp_replace(c, form, f"{MASK}$1"), NUMBER_FORMS, text)


def redacted_line(*fields: Column) -> Column:
    """Fields joined by comma, masked, cut to 1024 characters."""
    c = log_mask(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]))
    return F.when(F.length(c) > 1024, F.concat(F.substring(c, 1, 1024), F.lit("..."))).otherwise(c)


# -- dates --------------------------------------------------------------------


def parse_date(raw: Column, dialect: str) -> Column:
    """The first format of the dialect that fits; the spreadsheet dialect also takes day serials. Impossible days are null (a lenient resolver would clamp them)."""
    text = F.trim(raw)
    found = F.coalesce(*[F.when(text.rlike(DATE_SHAPES[f]), F.try_to_timestamp(text, F.lit(f)).cast("date")) for f in DATE_FORMATS[dialect]])
    if dialect == "SPREADSHEET":
        n = F.when(text.rlike("^[0-9]{1,9}$"), text).try_cast("int")
        found = F.coalesce(found, F.when(n.between(EXCEL_FIRST, EXCEL_LAST), F.date_add(F.lit("1899-12-30").cast("date"), n)))
    return F.when(blank(raw), None).otherwise(found)


def filing_deadline(tax_year: Column) -> Column:
    """31 January of the next year, moved to Monday from a weekend."""
    d = F.make_date(tax_year + 1, F.lit(1), F.lit(31))
    return F.date_add(d, F.when(F.dayofweek(d) == 7, 2).when(F.dayofweek(d) == 1, 1).otherwise(0))


# -- money --------------------------------------------------------------------


def parse_amount(raw: Column) -> Column:
    """Signed decimal in any dialect, or null."""
    c = F.translate(raw, " −", " -")
    c = F.regexp_replace(c, r"\s+", "")
    negative = c.startswith("(") & c.endswith(")") & (F.length(c) >= 2)
    c = F.when(negative, F.regexp_extract(c, r"^\((.*)\)$", 1)).otherwise(c)
    c = F.replace(F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit("USD"), F.lit("")), F.lit(","), F.lit(""))
    value = F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c).try_cast("decimal(38,10)")
    return F.when(negative, -value).otherwise(value)


def exact_cents(amount: Column) -> Column:
    """Cents as long; null for a sub-cent amount (tell it from an unparseable one by ``amount``)."""
    scaled = amount.cast("decimal(36,10)") * 100
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def withholding_cents(raw: Column) -> Column:
    """Absolute cents; noise is 0."""
    return F.coalesce(F.abs(exact_cents(parse_amount(raw))), F.lit(0)).cast("long")


def format_cents(cents: Column) -> Column:
    return F.format_number(cents.cast("decimal(20,2)") / 100, 2)


def display_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def display_time(at: Column) -> Column:
    """To the minute."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def backoff_ms(attempt: Column, base: int = 1_000, factor: int = 2, cap: int = 60_000) -> Column:
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(float(factor)), attempt - 1)).cast("long")


def jittered_ms(longest: Column, fraction: Column) -> Column:
    """A delay from 1 up to below ``longest`` (full jitter), by a fraction in [0, 1), so that a run can be repeated."""
    return (F.lit(1) + F.floor(fraction * (F.greatest(longest, F.lit(2)) - 1))).cast("long")


def hash_fraction(seed: Column, key: Column, n: Column) -> Column:
    """A fraction in [0, 1) from the first 56 bits of a SHA-256: the same for the same arguments everywhere."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, key, n.cast("string")), 256), 1, 14), 16, 10).cast("double") / float(1 << 56)


# -- hashes -------------------------------------------------------------------


def fields_hash(*fields: Column) -> Column:
    """SHA-256 over fields that each end in a unit separator; null is empty."""
    return F.sha2(F.concat(*[x for f in fields for x in (F.coalesce(f.cast("string"), F.lit("")), F.lit(UNIT))]), 256)


def natural_id(parts: list[Column], ordinal: Column) -> Column:
    """H: and 16 hex digits, for rows without an id of their own."""
    return F.concat(F.lit("H:"), F.substring(F.sha2(F.concat(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), F.lit(":"), ordinal.cast("string")), 256), 1, 16))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC in two nested digests, as hex."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def tin_index(key: bytes, firm: Column, digits: Column) -> Column:
    return hmac_sha256(key, F.concat(firm.cast("string"), F.lit(":"), digits))


def name_index(key: bytes, firm: Column, name: Column) -> Column:
    return hmac_sha256(key, F.concat(firm.cast("string"), F.lit(":name:"), name))


def encrypt_tin(digits: Column, keys: dict[int, bytes], aad: Column) -> Column:
    """(key_version, sealed) under the newest of the versioned keys, bound to ``aad``."""
    newest = max(keys)
    return F.struct(F.lit(newest).alias("key_version"), F.aes_encrypt(digits, F.lit(keys[newest]), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad).alias("sealed"))


def decrypt_tin(box: Column, keys: dict[int, bytes], aad: Column) -> Column:
    """The digits, by the key that sealed them; null if that key is unknown or the binding differs."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for version, key in sorted(keys.items()):
        out = out.when(box["key_version"] == version, F.try_aes_decrypt(box["sealed"], F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))
    return out


def canonical_json(pairs: Column) -> Column:
    """A map of texts as JSON with sorted keys and no white space."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.lit(bytes.fromhex(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    nibble = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), nibble, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def batch_key(firm: Column, client: Column, year: Column, members: Column) -> Column:
    """b1. and 32 url-safe characters of a digest over the sorted members (array of struct id, generation, content hash)."""
    body = F.array_join(F.transform(F.array_sort(members), lambda m: F.concat_ws(UNIT, m["id"], m["generation"].cast("string"), m["content_hash"], F.lit(""))), "")
    digest = F.unhex(F.sha2(F.concat(F.concat_ws(UNIT, firm.cast("string"), client.cast("string"), year.cast("string"), F.lit("")), body), 256))
    return F.concat(F.lit("b1."), F.substring(F.translate(F.base64(digest), "+/=", "-_"), 1, 32))


def row_bits(hex_digest: Column) -> Column:
    """The leading 64 bits of a hex digest as a signed long."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, -10).cast("long")
