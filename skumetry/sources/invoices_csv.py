"""Invoice lines from CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.schemas import PRICE, TRANSACTIONS

# Header names of the invoice file, in column order.
HEADER = {
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
}
ENCODING = "ISO-8859-1"
TIMESTAMP_FORMATS = ("M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")

#: The forms a file may be in, for the vote. Each group holds the orders of day and month that
#: one text can be read in.
CANDIDATE_FORMATS = (
    ("M/d/yyyy H:mm", "d/M/yyyy H:mm"),
    ("M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss"),
    ("M/d/yyyy", "d/M/yyyy"),
    ("M-d-yyyy H:mm", "d-M-yyyy H:mm"),
    ("d.M.yyyy H:mm",),
    ("yyyy-MM-dd HH:mm:ss",),
    ("yyyy-MM-dd'T'HH:mm:ss",),
    ("yyyy-MM-dd",),
)

REJECTED = "_rejected"


class AmbiguousDates(ValueError):
    """Both orders of day and month fit a file's dates equally well."""

_TYPES = {"Quantity": T.IntegerType(), "UnitPrice": PRICE}
FILE_SCHEMA = T.StructType([T.StructField(h, _TYPES.get(h, T.StringType())) for h in HEADER])


def parse_timestamp(text, formats: Sequence[str] = TIMESTAMP_FORMATS):
    """First format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def format_votes(texts: DataFrame, column: str, candidates: Sequence[Sequence[str]] = CANDIDATE_FORMATS) -> DataFrame:
    """``form``, ``format``, ``fits``: how many texts each format reads, counted over the whole table in one pass."""
    formats = [(number, f) for number, group in enumerate(candidates) for f in group]
    counts = texts.agg(*[F.count(F.try_to_timestamp(F.col(column), F.lit(f))).alias(str(i)) for i, (_, f) in enumerate(formats)])
    votes = F.array(*[
        F.struct(F.lit(number).alias("form"), F.lit(f).alias("format"), F.col(str(i)).alias("fits")) for i, (number, f) in enumerate(formats)
    ])
    return counts.select(F.inline(votes))


def infer_formats(texts: DataFrame, column: str, candidates: Sequence[Sequence[str]] = CANDIDATE_FORMATS) -> tuple[str, ...]:
    """The formats that a file's dates are in: of each form that occurs the order of day and month with most votes.

    All texts vote, so a few odd rows do not decide. Raises ``AmbiguousDates`` if both orders of
    a form read equally many texts, as when no day is beyond 12. Without any date the declared
    formats are returned.
    """
    by_form: dict[int, list[tuple[int, str]]] = {}
    for row in format_votes(texts, column, candidates).collect():  # a row for each format
        by_form.setdefault(row.form, []).append((row.fits, row.format))
    chosen = []
    for votes in by_form.values():
        votes.sort(key=lambda v: -v[0])
        if not votes[0][0]:
            continue
        if len(votes) > 1 and votes[0][0] == votes[1][0]:
            raise AmbiguousDates(f"{votes[0][0]} dates fit both {votes[0][1]!r} and {votes[1][1]!r}; name the format")
        chosen.append(votes[0])
    return tuple(f for _, f in sorted(chosen, key=lambda v: -v[0])) or TIMESTAMP_FORMATS


def _scan(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The file's columns and ``_rejected``, the text of a row that does not fit them."""
    return (
        spark.read.schema(T.StructType([*FILE_SCHEMA.fields, T.StructField(REJECTED, T.StringType())]))
        .option("header", True)
        .option("encoding", ENCODING)
        .option("enforceSchema", False)
        # Quotes inside a quoted text are doubled, as spreadsheets write them; a backslash is a character.
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", REJECTED)
        .option("columnPruning", False)
        .csv(path)
    )


def file_profile(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of a file, and how many of them have a cell that does not parse or too few or many cells."""
    # The reader parses, and so rejects, only cells of columns that are read: all typed ones are.
    no_quantity, no_price = F.col("Quantity").isNull(), F.col("UnitPrice").isNull()
    rejected = F.col(REJECTED).isNotNull()
    return _scan(spark, path, multi_line).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(rejected & no_quantity) + F.count_if(rejected & ~no_quantity & no_price) + F.count_if(rejected & ~no_quantity & ~no_price)).alias("rejected_rows"),
    )


def read_invoices(
    spark: SparkSession, path: str, formats: Sequence[str] | None = TIMESTAMP_FORMATS, multi_line: bool = False
) -> DataFrame:
    """Transactions from Latin-1 CSV with a header, with a declared schema.

    ``formats=None`` lets the file's own dates choose (``infer_formats``), at the cost of a pass over it.

    A cell that does not parse becomes null, and cleaning later rejects a row that lacks its
    quantity, price or date; ``file_profile`` counts such rows. ``multi_line`` is for files with
    line breaks inside quoted texts; such a file is read by one task, so it is off by default.
    """
    named = _scan(spark, path, multi_line).drop(REJECTED).withColumnsRenamed(HEADER)
    if formats is None:
        formats = infer_formats(named, "invoice_date")
    return named.withColumn("invoice_date", parse_timestamp(F.col("invoice_date"), formats)).select(
        *TRANSACTIONS.fieldNames()
    )
