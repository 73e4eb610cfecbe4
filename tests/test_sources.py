import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate, sampling, scoring
from ledgerlens.plans import catalog
from ledgerlens.plans.catalog import test_score as score_of
from ledgerlens.session import new_folder
from ledgerlens.sources import adapter, config, readers, writers

from .conftest import SF

HEADER = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud"


def test_csv_rows_with_extra_fields_are_skipped_and_others_kept(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("\n".join([
        HEADER,
        "1,PAYMENT,10.5,C1,20,9.5,M1,0,0,0,0",
        "2,TRANSFER,5,C2,5,0,C9,0,0,1,0,surplus",
        "3,DEBIT,7,C3,9",
        "x,CASH_IN,oops,C4,1,1,C5,1,1,0,0",
        "1,PAYMENT,10.5,C1,20,9.5,M1,0,0,0,0",
        '4,"DE,BIT",7,C3,9,2,C1,0,7,0,0',
    ]))
    rows = readers.read_transactions(spark, str(path))
    got = rows.collect()
    assert len(got) == 5 and len({r.txn_id for r in got}) == 5
    by_name = {r.nameOrig: r for r in got}
    assert by_name["C4"].step is None and by_name["C4"].amount is None and by_name["C4"].isFraud == 0
    assert any(r.type == "DE,BIT" for r in got)
    assert rows.select("amount").count() == 5 and dict(rows.dtypes)["amount"] == "double"
    fraud, rest = readers.read_split(spark, str(path))
    assert fraud.count() == 0 and rest.count() == 5


def test_keys_are_stable_and_unique_for_many_copies(spark, monkeypatch):
    monkeypatch.setattr(readers, "_COPIES_PER_TASK", 7)
    df = spark.range(100).select(F.when(F.col("id") < 40, 1).otherwise(F.col("id")).alias("v"), F.lit("x").alias("w"))
    one = {(r.txn_id, r.v) for r in readers.with_key(df).collect()}
    two = {(r.txn_id, r.v) for r in readers.with_key(df.repartition(5)).collect()}
    assert one == two and len({k for k, _ in one}) == 100


def test_missing_path(spark):
    with pytest.raises(FileNotFoundError):
        readers.validate_source(spark, "/tmp/definitely-not-here.csv")


def test_requests_take_defaults(spark):
    rows = readers.read_requests(spark, [{"amount": 181000}, {"type": "PAYMENT", "step": 7, "amount": None}]).orderBy("txn_id").collect()
    assert (rows[0].step, rows[0].type, rows[0].amount, rows[0].newbalanceDest) == (1, "TRANSFER", 181000.0, 10000.0)
    assert (rows[1].step, rows[1].type, rows[1].amount) == (7, "PAYMENT", 10000.0)


def test_requests_from_json_lines(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"amount": 5.0}\n{"txn_id": "a", "step": 3}\n')
    rows = {r.step: r for r in readers.read_requests(spark, str(path)).collect()}
    assert rows[3].txn_id == "a" and rows[1].amount == 5.0 and len(rows[1].txn_id) == 32


def test_form_parsing(spark):
    form = spark.createDataFrame(
        [("", "abc", " 12.5 "), ("0", "NaN", ""), ("7 hours", "1e3", "-2"), (None, None, None)],
        "step string, amount string, oldbalanceOrg string")
    got = [tuple(r) for r in scoring.parse_form(form).collect()]
    assert got == [(1, 0.0, 12.5), (1, 0.0, 0.0), (7, 1000.0, -2.0), (1, 0.0, 0.0)]


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data:\n  max_training_rows: 50\n  unknown: 1\nimbalance:\n  method: smote\n")
    loaded = config.load_config(str(path))
    assert loaded.data.max_training_rows == 50 and loaded.imbalance.method == "smote" and loaded.data.test_size == 0.2


def test_sinks(spark, tx, tmp_path):
    writers.write_augmented(tx.limit(50), str(tmp_path / "aug"))
    back = readers.read_transactions(spark, str(tmp_path / "aug"))
    assert back.count() == 50 and "nameOrig" not in back.columns
    metrics = evaluate.metrics(score_of(tx), "m", digits=6)
    writers.write_results({"metrics": metrics}, str(tmp_path / "res"))
    assert readers.read_columns(spark, str(tmp_path / "res" / "metrics"), ["model"]).first().model == "m"
    assert spark.read.json(str(tmp_path / "res" / "json" / "metrics")).first().tp == metrics.first().tp
    writers.write_report(evaluate.evaluation_report(metrics), str(tmp_path / "report"))
    assert "PERFORMANCE METRICS" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())


@pytest.mark.parametrize("split_bytes", [700, 1 << 20])
def test_file_order_over_many_splits(spark, tmp_path, split_bytes):
    header = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud"
    want = []
    for name in ("b.csv", "a.csv", "c.csv"):
        lines = [header]
        for i in range(120):
            line = f"{i % 9},PAYMENT,{i}.5,C{i},1,2,M{name}{i % 40},3,4,{i % 2},0"
            lines.append(line + ",one,field,too,many" if i % 11 == 5 else line if i % 13 else line.rsplit(",", 2)[0])
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    for name in ("a.csv", "b.csv", "c.csv"):  # a plain reader of lines
        for line in (tmp_path / name).read_text().splitlines()[1:]:
            if line.count(",") <= 10:
                want.append((int(line.split(",")[0]), float(line.split(",")[2]), line.split(",")[6]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = readers.read_in_file_order(spark, str(tmp_path))
        got = [tuple(r) for r in rows.orderBy("file_row").select("step", "amount", "nameDest", "file_row").collect()]
        assert got == [(*r, i) for i, r in enumerate(want)]
        assert rows.select("txn_id").distinct().count() == len(want)
        rest = sampling.skip_rows(rows, 100, "file_row").orderBy("file_row").select("step", "amount", "nameDest").collect()
        assert [tuple(r) for r in rest] == want[100:]
        legit = sampling.load_fraud_preserving(rows, 10**6, start_row=300, order="file_row").where("isFraud = 0")
        assert legit.agg({"file_row": "min"}).first()[0] >= 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lineitem_rows_are_shuffled_once(spark):
    """Orders meet customers before lineitem; few suppliers are broadcast whatever the threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = adapter.transactions_view(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Orders, customers, orders with customers, lineitem.
    assert plan.count("Exchange hashpartitioning") == 4


def test_files_of_the_written_log_follow_its_rows(tx, monkeypatch):
    want = {tuple(r) for r in catalog.file_row_offset(tx).collect()}
    paths = []
    monkeypatch.setattr(catalog, "FILE_ROWS", 500, raising=False)
    monkeypatch.setattr(catalog, "new_folder", lambda spark, name: paths.append(new_folder(spark, name)) or paths[-1])
    assert {tuple(r) for r in catalog.file_row_offset(tx).collect()} == want
    assert len({r[0] for r in tx.sparkSession.read.text(paths[0]).select(F.input_file_name()).collect()}) >= 10
