import csv
import datetime as dt
import warnings
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry import Policy, StockPlan, schemas
from skumetry.operators import cleaning, rationalise
from skumetry.sources import invoices_csv, order_tables, outputs
from skumetry.sources.order_tables import OrderTables
from skumetry.sources.rollup_store import RollupStore

SF_DIR = "/root/testdata/sf0.001"

CSV = """InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365,85123A,"CAFÉ LANTERN, WHITE",6,12/1/2010 8:26,2.55,17850,United Kingdom
C536379,22423,POSTAGE £5,-1,12/13/2010 18:05,27.50,,France
536370,22423,,x,yesterday,1.25,12583,France
"""


@pytest.fixture()
def invoice_file(tmp_path):
    path = tmp_path / "invoices.csv"
    path.write_bytes(CSV.encode("latin-1"))
    return str(path)


def test_csv_scan(spark, invoice_file):
    data = invoices_csv.read_invoices(spark, invoice_file)
    assert data.columns == schemas.TRANSACTIONS.fieldNames()
    assert [f.dataType for f in data.schema] == [f.dataType for f in schemas.TRANSACTIONS]
    rows = {r.invoice_no: r for r in data.collect()}
    first = rows["536365"]
    assert first.description == "CAFÉ LANTERN, WHITE"
    assert first.invoice_date == dt.datetime(2010, 12, 1, 8, 26)
    assert (first.quantity, first.unit_price) == (6, Decimal("2.55"))
    assert rows["C536379"].description == "POSTAGE £5" and rows["C536379"].customer_id is None
    broken = rows["536370"]
    assert (broken.quantity, broken.invoice_date, broken.description) == (None, None, None)
    nulls = {r.column_name: r.violations for r in
             cleaning.null_violations(data, ["quantity", "invoice_date"]).collect()}
    assert nulls == {"quantity": 1, "invoice_date": 1}


@pytest.mark.parametrize("text, expected", [
    ("12/9/2011 12:50", dt.datetime(2011, 12, 9, 12, 50)),
    ("2011-12-09 12:50:00", dt.datetime(2011, 12, 9, 12, 50)),
    ("2011-12-09", dt.datetime(2011, 12, 9)),
    ("9th of December", None),
])
def test_timestamp_formats(spark, text, expected):
    data = spark.createDataFrame([(text,)], "t string")
    assert data.select(invoices_csv.parse_timestamp(F.col("t"))).first()[0] == expected


def test_order_tables_give_transactions(spark):
    data = OrderTables(spark, SF_DIR).transactions()
    assert [(f.name, f.dataType) for f in data.schema] == [(f.name, f.dataType) for f in schemas.TRANSACTIONS]
    assert data.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    nulls = cleaning.null_violations(data, data.columns).agg(F.sum("violations")).first()[0]
    assert nulls == 0


def test_order_tables_join_only_what_is_asked_for(spark):
    narrow = OrderTables(spark, SF_DIR).transactions(("stock_code", "quantity"))
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    full = OrderTables(spark, SF_DIR).transactions().select("stock_code", "quantity")
    assert narrow.exceptAll(full).isEmpty() and full.exceptAll(narrow).isEmpty()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_outputs_round_trip(spark, lines, tmp_path, fmt):
    data = lines.weekly({"SKU001": [5, 6, 7], "SKU002": [1, 9, 30], "SKU003": [4]})
    plan = StockPlan(data)
    tables = plan.outputs()
    assert set(tables) == set(outputs.OUTPUT_TABLES)
    assert [len(tables[n].columns) for n in outputs.OUTPUT_TABLES] == [18, 7, 19, 10, 2]
    outputs.save_outputs(tables, str(tmp_path), fmt)
    outputs.save_outputs(tables, str(tmp_path), fmt)
    loaded = outputs.load_outputs(spark, str(tmp_path), {n: t.schema for n, t in tables.items()}, fmt)
    for name, table in tables.items():
        assert loaded[name].exceptAll(table).isEmpty() and table.exceptAll(loaded[name]).isEmpty(), name


def test_missing_output_is_empty_and_warned_about(spark, tmp_path):
    with pytest.warns(UserWarning, match="weekly_demand not found"):
        table = outputs.load_table(spark, str(tmp_path), "weekly_demand", schemas.WEEKLY_DEMAND)
    assert table.isEmpty() and table.columns == schemas.WEEKLY_DEMAND.fieldNames()


def test_empty_master_stops(spark, tmp_path):
    with warnings.catch_warnings(), pytest.raises(outputs.EmptyMaster):
        warnings.simplefilter("ignore")
        outputs.load_outputs(spark, str(tmp_path), {"sku_master": schemas.sku_master(Policy())})


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    from skumetry import session

    df = spark.range(3)
    assert sorted(r.id for r in session.written(df).collect()) == [0, 1, 2]
    folder = spark.conf.get("spark.checkpoint.dir")
    assert any(folder in f for f in session.written(df).inputFiles())


@pytest.mark.parametrize("part", [1, 211_631_616, 211_631_617, 20_000_000_000])
def test_every_part_key_is_kept_and_years_stay_apart(spark, part):
    rows = [(part, dt.date(1992, 5, 1)), (part, dt.date(2002, 5, 1)), (part + 1, dt.date(1992, 5, 1))]
    data = spark.createDataFrame(rows, "p long, d date").select(order_tables.seasonal_code(F.col("p"), F.col("d")).alias("stock_code"))
    codes = [r.stock_code for r in data.collect()]
    assert len(set(codes)) == 3
    kept = data.where(F.col("stock_code").rlike(order_tables.CODE_PATTERN))
    assert kept.count() == 3


def test_odd_codes_drop_a_line_or_stop_the_run(spark, lines):
    data = lines({"stock_code": "1234567"}, {"stock_code": "12345"})
    assert cleaning.clean_transactions(data, Policy()).count() == 1
    assert cleaning.clean_transactions(data, Policy(code_pattern=order_tables.CODE_PATTERN)).count() == 2
    with pytest.raises(Exception, match="outside the policy's pattern: 1234567"):
        cleaning.clean_transactions(data, Policy(stop_at_odd_code=True)).collect()


def test_texts_are_counted_before_the_part_join(spark):
    source = OrderTables(spark, SF_DIR)
    counted = source.text_counts(("invoice_no", "stock_code", "quantity", "unit_price"), lambda df: df)
    plain = source.transactions(("stock_code", "description")).groupBy("stock_code", "description").agg(F.count(F.lit(1)).alias("n_lines"))
    assert counted.exceptAll(plain).isEmpty() and plain.exceptAll(counted).isEmpty()


QUOTED = """InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365,85123A,"HEART ""LOVE"", LARGÉ",6,12/1/2010 8:26,2.55,17850,United Kingdom
536366,85123B,"ENDS IN \\",6,12/1/2010 8:26,2.55,17850,United Kingdom
536367,85123C,"TWO
LINES",6,12/1/2010 8:26,2.55,17850,United Kingdom
536368,85123D,PLAIN,six,12/1/2010 8:26,2.55,17850,United Kingdom
"""


def test_quoted_texts(spark, tmp_path):
    path = str(tmp_path / "quoted.csv")
    (tmp_path / "quoted.csv").write_bytes(QUOTED.encode("latin-1"))
    rows = {r.stock_code: r for r in invoices_csv.read_invoices(spark, path, multi_line=True).collect()}
    assert rows["85123A"].description == 'HEART "LOVE", LARGÉ' and rows["85123A"].customer_id == "17850"
    assert rows["85123B"].description == "ENDS IN \\" and rows["85123B"].quantity == 6
    assert rows["85123C"].description == "TWO\nLINES" and len(rows) == 4
    assert tuple(invoices_csv.file_profile(spark, path, multi_line=True).first()) == (4, 1)
    assert invoices_csv.file_profile(spark, path).first().rejected_rows > 1


def test_written_csv_is_standard(spark, tmp_path):
    texts = ['say "hi", you', "back\\slash\\", "two\nlines", "É", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "StockCode int, description string").coalesce(1)
    outputs.save_table(table, str(tmp_path), "texts", "csv")
    file = next((tmp_path / "texts").glob("part-*.csv"))
    with file.open(newline="", encoding="utf-8") as handle:
        assert [r["description"] for r in csv.DictReader(handle)] == [t or "" for t in texts]
    back = outputs.load_table(spark, str(tmp_path), "texts", table.schema, "csv", multi_line=True)
    assert back.exceptAll(table).isEmpty() and table.exceptAll(back).isEmpty()


def test_files_are_written_in_order(spark, lines, tmp_path):
    plan = StockPlan(lines.weekly({f"SKU{i:03d}": [1 + i % 7, 9 * (i % 2), 90 * (i % 5)][: 1 + i % 3] for i in range(60)}))
    tables = plan.outputs() | {
        "rationalisation_summary": plan.rationalisation_summary(),
        "rationalise_candidates": rationalise.rationalise_candidates(plan.rationalisation_list),
    }
    for name, order in outputs.FILE_ORDER.items():
        outputs.save_table(tables[name], str(tmp_path), name, "csv")
        rows = []
        for file in sorted((tmp_path / name).glob("part-*.csv")):
            with file.open(newline="", encoding="utf-8") as handle:
                rows += list(csv.DictReader(handle))
        numbers = {"total_revenue", "Annual Revenue (£)", "sku_count"}
        keys = [tuple((-float(r[c]) if falls else float(r[c])) if c in numbers else r[c] for c, falls in order) for r in rows]
        assert keys == sorted(keys) and len(rows) == tables[name].count(), name
    assert "Sort [" not in plan.rationalisation_list._jdf.queryExecution().optimizedPlan().toString()


def small_run(spark, value):
    return {name: spark.createDataFrame([(f"{name}-{value}", value)], "name string, value int") for name in outputs.OUTPUT_TABLES}


RUN_SCHEMAS = {name: T.StructType().add("name", "string").add("value", "integer") for name in outputs.OUTPUT_TABLES}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_run_leaves_the_former_one_readable(spark, tmp_path, monkeypatch, fmt):
    folder = str(tmp_path)
    monkeypatch.setattr(outputs, "FILE_ORDER", {})
    with pytest.raises(outputs.EmptyMaster):
        outputs.load_run(spark, folder, RUN_SCHEMAS)
    first = outputs.save_run(spark, small_run(spark, 1), folder, fmt)
    save, calls = outputs.save_table, []

    def failing(df, *args):
        calls.append(args)
        if len(calls) > 3:
            raise OSError("disk full")
        return save(df, *args)

    monkeypatch.setattr(outputs, "save_table", failing)
    with pytest.raises(OSError):
        outputs.save_run(spark, small_run(spark, 2), folder, fmt)
    monkeypatch.setattr(outputs, "save_table", save)
    assert outputs.runs(spark, folder) == [first]
    assert {r.value for t in outputs.load_run(spark, folder, RUN_SCHEMAS).values() for r in t.collect()} == {1}
    third = outputs.save_run(spark, small_run(spark, 3), folder, fmt)
    assert outputs.runs(spark, folder) == [first, third]
    assert {r.value for t in outputs.load_run(spark, folder, RUN_SCHEMAS).values() for r in t.collect()} == {3}
    assert {r.value for t in outputs.load_run(spark, folder, RUN_SCHEMAS, first).values() for r in t.collect()} == {1}


def test_a_run_with_an_empty_master_is_no_run_to_report_on(spark, tmp_path):
    outputs.save_run(spark, {"sku_master": spark.createDataFrame([], "StockCode string, total_revenue double")}, str(tmp_path))
    with pytest.raises(outputs.EmptyMaster):
        outputs.load_run(spark, str(tmp_path), {"sku_master": T.StructType().add("StockCode", "string")})


def dates(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "day string")


def test_dates_vote_on_their_format(spark):
    month_first = dates(spark, "12/1/2010 8:26", "1/2/2011 9:00", "1/13/2011 9:00", None, "n/a")
    day_first = dates(spark, "1/12/2010 8:26", "13/1/2011 9:00", "31/1/2011 9:00", "12/31/2011 9:00")
    assert invoices_csv.infer_formats(month_first, "day") == ("M/d/yyyy H:mm",)
    assert invoices_csv.infer_formats(day_first, "day") == ("d/M/yyyy H:mm",)
    mixture = dates(spark, "2010-12-01 08:26:00", "2010-12-02 08:26:00", "13/1/2011 9:00", "24.12.2010 8:00")
    assert invoices_csv.infer_formats(mixture, "day") == ("yyyy-MM-dd HH:mm:ss", "d/M/yyyy H:mm", "d.M.yyyy H:mm")
    assert invoices_csv.infer_formats(dates(spark, None, "soon"), "day") == invoices_csv.TIMESTAMP_FORMATS


def test_a_tie_of_day_and_month_is_an_error(spark):
    with pytest.raises(invoices_csv.AmbiguousDates, match="2 dates fit both"):
        invoices_csv.infer_formats(dates(spark, "1/2/2011 9:00", "3/4/2011 9:00"), "day")
    with pytest.raises(invoices_csv.AmbiguousDates):
        invoices_csv.infer_formats(dates(spark, "13/2/2011 9:00", "2/13/2011 9:00"), "day")


def test_a_day_first_file(spark, tmp_path):
    path = tmp_path / "days.csv"
    path.write_text("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                    "1,85123A,X,1,3/2/2011 8:26,1.00,1,UK\n2,85123A,X,1,28/2/2011 8:26,1.00,1,UK\n", encoding="latin-1")
    found = [str(r.invoice_date) for r in invoices_csv.read_invoices(spark, str(path), formats=None).orderBy("invoice_no").collect()]
    assert found == ["2011-02-03 08:26:00", "2011-02-28 08:26:00"]


@pytest.fixture()
def odd_orders(spark, tmp_path):
    """Order tables with repeated keys, nulls and returned lines."""
    line = "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
    day = dt.datetime(1995, 3, 1)
    rows = [
        (1, 7, 2.0, 10.0, "N", day), (1, 7, 2.0, 10.0, "N", day), (1, 7, 3.0, 9.0, "R", day), (2, 7, 1.0, 4.0, None, day),
        (3, 7, 1.0, 4.5, "A", day + dt.timedelta(days=200)), (None, 7, 1.0, 4.5, "A", day), (3, 8, 5.0, 5.0, "N", day + dt.timedelta(days=400)),
        (2, 9, 0.0, 5.0, "N", day), (2, None, 1.0, 5.0, "N", day), (2, 8, 1.0, 5.0, "N", None), (4, 8, 1.0, 5.0, "N", day),
    ]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 11), (1, 12), (1, 11), (2, 11), (3, None), (None, 13)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(7, "red"), (7, "red"), (7, "green"), (8, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    return OrderTables(spark, str(tmp_path))


def _same(one, other):
    return one.columns == other.columns and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


@pytest.mark.parametrize("semantics", ["sql", "script"])
def test_order_tables_reduce_lines_as_a_table_of_transactions(odd_orders, semantics):
    policy = Policy(semantics=semantics, code_pattern=order_tables.CODE_PATTERN, stop_at_odd_code=True)
    by_number = StockPlan(odd_orders, policy)
    plain = StockPlan(odd_orders.transactions(("invoice_no", "stock_code", "quantity", "unit_price", "invoice_date", "customer_id", "description")), policy)
    # A line has no customer of its own, so repeated orders give repeated lines: only sets and counts of lines once each compare.
    lines = StockPlan(odd_orders.transactions(("invoice_no", "stock_code", "quantity", "unit_price", "invoice_date")), policy)
    assert _same(by_number.week_rollup, lines.week_rollup)
    assert _same(by_number.buyers, plain.buyers)
    assert _same(by_number.buyer_pairs_of(), plain.buyer_pairs_of().distinct())
    assert _same(by_number.descriptions, plain.descriptions)
    codes = plain.buyers.select("stock_code").where("n_invoices > 1")
    assert _same(by_number.buyers_of(codes), plain.buyers_of(codes)) and not codes.isEmpty()


def test_dated_lines_add_up_to_all(spark, odd_orders, tmp_path):
    policy = Policy(code_pattern=order_tables.CODE_PATTERN, stop_at_odd_code=True)
    store = RollupStore(spark, f"{tmp_path}/store")
    store.add(StockPlan(odd_orders.dated(lambda day: day < "1995-06-15"), policy), "early")
    for _ in range(2):
        store.add(StockPlan(odd_orders.dated(lambda day: ~(day < "1995-06-15")), policy), "late")
    refreshed, whole = StockPlan(store, policy), StockPlan(odd_orders, policy)
    for name in ("week_rollup", "buyers", "descriptions", "demand_stats"):
        assert _same(getattr(refreshed, name), getattr(whole, name)), name


def test_lines_are_grouped_by_numbers_and_no_row_is_doubled(odd_orders):
    plan = StockPlan(odd_orders, Policy(code_pattern=order_tables.CODE_PATTERN))
    for table in (plan.week_rollup, plan.buyers, plan.text_counts_of()):
        steps = table._jdf.queryExecution().executedPlan().toString().splitlines()
        first = next(step for step in reversed(steps) if "Aggregate" in step)
        assert "code_number" in first and "conv(" not in first, first
        assert not any("Expand" in step for step in steps)
