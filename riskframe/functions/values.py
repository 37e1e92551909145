"""Dates, value parsing, quality flags, type sniffing, JSON and identifier checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import truthy, unpivot

# Date layouts tried in turn.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "MM/dd/yyyy",
    "dd MMM yyyy",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(value: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp of a text in any known layout; anything else is null."""
    text = F.trim(_col(value).cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def parse_number(value: Column | str) -> Column:
    return F.trim(_col(value).cast("string")).try_cast("double")


def quarter(date: Column | str) -> Column:
    return F.quarter(date)


def month_name(date: Column | str) -> Column:
    return F.date_format(date, "MMMM")


def weekday_name(date: Column | str) -> Column:
    return F.date_format(date, "EEEE")


def day_of_month(date: Column | str) -> Column:
    return F.dayofmonth(date)


def parsed_value(value: Column | str) -> Column:
    """What a text holds: ``{kind, boolean, number, date}`` with at most one value set.

    Tried in the order boolean, integer, float, date; kind is 'text' otherwise.
    """
    text = F.trim(_col(value).cast("string"))
    low = F.lower(text)
    is_bool = low.isin("true", "false")
    integer = text.rlike(r"^[+-]?\d+$")
    number = F.when(~is_bool, text.try_cast("double"))
    date = F.when(~is_bool & number.isNull(), parse_date(text, DATE_FORMATS[:3]))
    kind = (
        F.when(text.isNull(), None)
        .when(is_bool, "boolean")
        .when(number.isNotNull() & integer, "integer")
        .when(number.isNotNull(), "float")
        .when(date.isNotNull(), "date")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(is_bool, low == "true").alias("boolean"),
        number.alias("number"),
        date.alias("date"),
    )


# Texts that stand for a missing value.
MISSING_TEXTS = ("nan", "other", "")


def _missing(value: Column) -> Column:
    text = value.cast("string")
    return text.isNull() | text.isin(*MISSING_TEXTS)


def flag(kind: str, value: Column | str) -> Column:
    """0/1 quality flag.

    invalid_date, zero_or_negative, missing, has_value, is_true, is_false
    """
    v = _col(value)
    number = F.when(v.cast("string").isNotNull(), parse_number(v))
    test = {
        "invalid_date": lambda: parse_date(v).isNull() | parse_number(v).isNotNull(),
        "zero_or_negative": lambda: ~F.coalesce(number > 0, F.lit(False)),
        "missing": lambda: _missing(v),
        "has_value": lambda: F.when(number.isNotNull(), number > 0).otherwise(
            ~_missing(v) & (F.lower(F.trim(v.cast("string"))) != "false")
        ),
        "is_true": lambda: truthy(v) | F.coalesce(number == 1, F.lit(False)),
        "is_false": lambda: (F.lower(F.trim(v.cast("string"))) == "false") | F.coalesce(number == 0, F.lit(False)),
    }[kind]()
    return F.coalesce(test, F.lit(False)).cast("int")


def differs(value: Column | str, usual: str, missing: str = "0") -> Column:
    """1 where a value differs from its usual one; what a missing value gives is stated per flag."""
    return F.coalesce((_col(value).cast("string") != usual).cast("int"), F.lit(int(missing)))


# The business quality flags, as output: (column, kind) or, for
# "differs", output: (column, "differs", usual value, flag of a missing value if not 0).
BUSINESS_FLAGS: dict[str, tuple[str, ...]] = {
    "RoundAmountInvoice": ("FMP2P001", "differs", "No Round Amount"),
    "RoundAmountPayment": ("FMP2P022", "differs", "No Round Amount", "1"),
    "CreditDebit": ("InvoiceDebitOrCreditIndicator", "differs", "H-Credit"),
    "InvoiceOnHoliday": ("FMP2P018", "differs", "Working Day"),
    "PaymentOnHoliday": ("FMP2P021", "differs", "Working Day", "1"),
    "ValidInvoiceDescription": ("InvoiceDescription", "missing"),
    "ValidPaymentTerms": ("PaymentTerms", "missing"),
    "ValidInvoiceVendorCurrency": ("InvoiceVendorCurrency", "missing"),
    "ValidPaymentMethod": ("PaymentMethod", "missing"),
    "ValidVendorTaxID": ("VendorTaxID", "missing"),
    "ValidBankBranch": ("BankBranch", "missing"),
    "ValidPaymentCompanyCode": ("PaymentCompanyCode", "missing"),
    "ValidPaymentDescription": ("PaymentDescription", "missing"),
    "ValidVendorCountry": ("VendorCountry", "missing"),
    "ValidPaymentStatus": ("PaymentStatus", "missing"),
    "ValidInvoiceCountry": ("InvoiceCountry", "missing"),
    "ValidRemitCountry": ("RemitCountry", "missing"),
    "ValidPayeeName": ("PayeeName", "missing"),
    "ValidPaymentCurrencyCode": ("PaymentCurrencyCode", "missing"),
    "ValidBankAccount": ("BankAccount", "missing"),
    "ValidVendorCategory": ("VendorCategory", "missing"),
    "ValidPaymentFiscalYear": ("PaymentFiscalYear", "missing"),
    "ValidInvoiceFiscalYear": ("InvoiceFiscalYear", "missing"),
    "ValidPaymentTermDescription": ("PaymentTermDescription", "missing"),
    "ValidInvoiceCompanyCode": ("InvoiceCompanyCode", "missing"),
    "ValidInvoiceType": ("InvoiceType", "missing"),
    "ValidPaymentDate": ("PaymentDate", "invalid_date"),
    "ValidInvoiceAuthorizedDate": ("InvoiceAuthorizedDate", "invalid_date"),
    "ValidPaymentInvoiceDate": ("PaymentInvoiceDate", "invalid_date"),
    "ValidInvoicePaymentDate": ("InvoicePaymentDate", "invalid_date"),
    "ValidScheduledPayDate": ("ScheduledPayDate", "invalid_date"),
    "ValidInvoiceDate": ("InvoiceDate", "invalid_date"),
    "ValidPaymentCreatedDate": ("PaymentCreatedDate", "invalid_date"),
    "ValidPaymentApprovedDate": ("PaymentApprovedDate", "invalid_date"),
    "ValidPaymentClearedDate": ("PaymentClearedDate", "invalid_date"),
    "ValidPaymentDueDate": ("PaymentDueDate", "invalid_date"),
    "ValidInvoiceCapturedOn": ("InvoiceCapturedOn", "invalid_date"),
    "DuplicateInvoiceFMP2P006": ("FMP2P006", "has_value"),
    "DuplicateInvoiceFMP2P007": ("FMP2P007", "has_value"),
    "DuplicatePaymentFMP2P039": ("FMP2P039", "has_value"),
    "InvoiceTestsHits": ("INV_Tests_Failed_Count", "has_value"),
    "PaymentTestHits": ("PMT_Tests_Failed_Count", "has_value"),
    "TestsFailedCount": ("TestsFailedCount", "has_value"),
    "KeywordInPaymentDesc": ("FMP2P033", "has_value"),
    "SequentialInvoiceNumber": ("FMP2P016", "has_value"),
    "SingleInvoiceVendor": ("FMP2P014", "is_true"),
    "SinglePaymentVendor": ("FMP2P026", "is_true"),
    "DifferentVendorPayee": ("FMP2P029", "is_true"),
    "DifferentPaymentCurrencyForVendor": ("FMP2P032", "is_true"),
    "NonMasterVendorInvoice": ("FMP2P012", "is_true"),
    "OutlierPayment": ("FMP2P040", "is_true"),
    "OutlierInvoice": ("FMP2P013", "is_true"),
}


def quality_flags(df: DataFrame, rules: Mapping[str, tuple[str, ...]] = BUSINESS_FLAGS) -> DataFrame:
    """Every flag whose column exists, in one projection (the flags only)."""
    out = []
    for name, (column, kind, *usual) in rules.items():
        if column in df.columns:
            out.append((differs(column, *usual) if kind == "differs" else flag(kind, column)).alias(name))
    return df.select(*out)


def as_zero_one(value: Column | str) -> Column:
    """True/'true' to 1, null to null, everything else to 0."""
    v = _col(value)
    return F.when(v.isNull(), None).when(F.lower(v.cast("string")) == "true", 1).otherwise(0)


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill each named column's nulls with its constant."""
    return df.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit(values[c])).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns]
    )


def is_json(text: Column | str) -> Column:
    """Whether a text is a whole JSON value; null is not."""
    return F.coalesce(F.try_parse_json(_col(text)).isNotNull(), F.lit(False))


def json_validity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Valid count and share per column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_json(c)).alias(c) for c in columns])
    long = unpivot(counts, ["rows"], columns, "column_name", "valid")
    return long.withColumn("share", F.col("valid") / F.col("rows"))


def single_quoted(document: Column, schema) -> Column:
    """Double quotes inside the text fields of a (nested) column become single ones."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StringType):
        return F.replace(document, F.lit('"'), F.lit("'"))
    if isinstance(schema, T.ArrayType):
        return F.transform(document, lambda x: single_quoted(x, schema.elementType))
    if isinstance(schema, T.MapType):
        return F.transform_values(document, lambda _, v: single_quoted(v, schema.valueType))
    if isinstance(schema, T.StructType):
        fields = [single_quoted(document[f.name], f.dataType).alias(f.name) for f in schema.fields]
        return F.when(document.isNotNull(), F.struct(*fields))
    return document


# Fixed value: hexadecimal form of an identifier, after dropping the optional
# "urn:", "uuid:", braces and hyphens.
_HEX32 = "^[0-9a-fA-F]{32}$"


def is_identifier(value: Column | str) -> Column:
    """Whether a text is a well-formed UUID (any version)."""
    text = F.regexp_replace(F.regexp_replace(_col(value).cast("string"), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", "")
    return F.coalesce(F.replace(text, F.lit("-"), F.lit("")).rlike(_HEX32), F.lit(False))


def malformed_identifiers(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_identifier(column))


def sniff_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type of each text column from its values, all columns in one aggregation.

    DATETIME if every value parses as a date and none is a plain number, BOOLEAN if
    all are true/false, NUMERIC if all parse as numbers, else STRING; empty is STRING.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = list(columns or df.columns)
    known = {"boolean": "BOOLEAN", "timestamp": "DATETIME", "date": "DATETIME", "timestamp_ntz": "DATETIME"}
    fixed = {c: "NUMERIC" if fields[c] not in known else known[fields[c]] for c in names if fields[c] != "string"}
    text = [c for c in names if c not in fixed]
    stats = []
    for i, c in enumerate(text):
        v = F.trim(F.col(f"`{c}`"))
        number = parse_number(v)
        stats.append(F.count(v).alias(f"n{i}"))
        stats.append(F.count_if(v.isNotNull() & number.isNull()).alias(f"bad_number{i}"))
        stats.append(F.count_if(v.isNotNull() & (parse_date(v).isNull() | v.rlike(r"^\d*\.?\d*$"))).alias(f"bad_date{i}"))
        stats.append(F.count_if(v.isNotNull() & ~F.lower(v).isin("true", "false")).alias(f"bad_bool{i}"))
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *stats)
    entries = []
    for c in names:
        if c in fixed:
            kind = F.lit(fixed[c])
        else:
            i = text.index(c)
            kind = (
                F.when(F.col(f"n{i}") == 0, "STRING")
                .when(F.col(f"bad_date{i}") == 0, "DATETIME")
                .when(F.col(f"bad_bool{i}") == 0, "BOOLEAN")
                .when(F.col(f"bad_number{i}") == 0, "NUMERIC")
                .otherwise("STRING")
            )
        entries.append(F.struct(F.lit(c).alias("column_name"), kind.alias("kind")))
    return counts.select(F.inline(F.array(*entries)))


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to their sniffed type."""
    kinds = {r["column_name"]: r["kind"] for r in sniff_types(df).collect()}
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if fields[c] == "string":
            col = {
                "DATETIME": lambda x: parse_date(x),
                "BOOLEAN": lambda x: F.lower(F.trim(x)) == "true",
                "NUMERIC": lambda x: parse_number(x),
            }.get(kinds[c], lambda x: x)(col)
        out.append(col.alias(c))
    return df.select(*out)


_INTEGERS = ((8, "byte"), (16, "short"), (32, "int"), (64, "long"))


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer type that holds each whole-number column.

    The bounds of all columns come from one aggregation; doubles keep their width,
    as narrowing them would change values.
    """
    whole = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("smallint", "int", "bigint")]
    if not whole:
        return df
    bounds = df.agg(*[F.min(f"`{c}`").alias(f"lo_{c}") for c in whole], *[F.max(f"`{c}`").alias(f"hi_{c}") for c in whole]).first()
    casts = {}
    for c in whole:
        low, high = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if low is not None:
            casts[c] = next(name for bits, name in _INTEGERS if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1))
    return df.select(*[F.col(f"`{c}`").cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns])
