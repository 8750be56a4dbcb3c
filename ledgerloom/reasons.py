"""What each reason code says to a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (code, category, text), in the order of the gates and rules.
REASONS = (
    ("UNPARSEABLE_DATE", "IMPORT_REJECTION", "The date could not be read in this file's format."),
    ("UNPARSEABLE_AMOUNT", "IMPORT_REJECTION", "The amount is not a number."),
    ("SUB_CENT_AMOUNT", "IMPORT_REJECTION", "The amount has sub-cent precision."),
    ("MISSING_CLIENT_REF", "IMPORT_REJECTION", "No client reference."),
    ("UNKNOWN_CLIENT_REF", "IMPORT_REJECTION", "The client reference is not in this export's client list."),
    ("UNIDENTIFIABLE_VENDOR", "IMPORT_REJECTION", "Neither a vendor name nor a TIN was recorded."),
    ("RAGGED_ROW", "IMPORT_REJECTION", "The row does not match the file's column structure."),
    ("UNSUPPORTED_CURRENCY", "IMPORT_REJECTION", "Only USD is supported."),
    ("MISSING_REQUIRED_COLUMN", "IMPORT_REJECTION", "A required column is missing from this file."),
    ("DUPLICATE_KEY_IN_FILE", "IMPORT_REJECTION", "The same transaction id appeared twice in one file; the later copy was kept."),
    ("COUNTED", "PAYMENT_DISPOSITION", "Counted toward the threshold."),
    ("COUNTED_REVERSAL", "PAYMENT_DISPOSITION", "Reversal or refund; reduces the year's net."),
    ("EXCLUDED_OUT_OF_TAX_YEAR", "PAYMENT_DISPOSITION", "Paid outside the tax year."),
    ("EXCLUDED_VOID", "PAYMENT_DISPOSITION", "Voided before it settled; no money moved."),
    ("EXCLUDED_NON_SERVICES", "PAYMENT_DISPOSITION", "Not for services, so not nonemployee compensation."),
    ("EXCLUDED_CARD_TPSO", "PAYMENT_DISPOSITION", "Paid by card or third-party network; the processor reports this on Form 1099-K."),
    ("EXCLUDED_ZERO_AMOUNT", "PAYMENT_DISPOSITION", "Zero amount."),
    ("MISSING_TIN", "DETERMINATION_EXCEPTION", "A form is required but no TIN was collected. A W-9 is needed before this can be filed."),
    ("MALFORMED_TIN", "DETERMINATION_EXCEPTION", "The recorded TIN is not nine digits and cannot be used."),
    ("AMBIGUOUS_VENDOR_IDENTITY", "DETERMINATION_EXCEPTION", "One vendor name is recorded under more than one TIN; a person must decide which payments belong together."),
    ("NEGATIVE_REPORTABLE", "DETERMINATION_EXCEPTION", "Refunds exceed payments for the year, giving a negative reportable amount."),
    ("UNKNOWN_PAYMENT_METHOD", "DETERMINATION_EXCEPTION", "The payment method was not recognised; it has been counted toward the threshold."),
    ("INVALID_TIN_PREFIX", "DETERMINATION_EXCEPTION", "The TIN begins 000, which the IRS will reject."),
    ("DETERMINATION_CHANGED_AFTER_FILING", "DETERMINATION_EXCEPTION", "Newly imported data changes a vendor whose filing has already been transmitted."),
)


def reason_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "code string, category string, human_text string")
