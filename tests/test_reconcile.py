import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.schemas import RECORD
from ledgerloom.sources import adapters, generate, sinks

AT = "2031-07-09 12:00:00"


def record(seq, ref, amount=5000, type="transfer", status="settled", currency="NGN", late=0):
    return (seq, ref, amount, type, status, currency, late)


def side(spark, rows):
    df = spark.createDataFrame(rows, "seq long, reference string, amount_minor long, type string, status string, currency string, late long")
    df = df.withColumn("initiated_at", F.timestamp_seconds(F.unix_timestamp(F.lit(AT)) + F.col("late")))
    for f in RECORD.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*RECORD.fieldNames(), "seq")


def by_category(df):
    return {r["category"]: r["n"] for r in reconcile.summary(df).collect()}


def test_one_of_each(spark):
    inside = [record(1, "same", 1234), record(2, "more", 777), record(3, "ours", 50), record(4, "owed", 901, status="timed_out"), record(5, "back", 42, status="failed"), record(6, "back", 42, type="reversal")]
    outside = [record(1, "same", 1234), record(2, "more", 1000), record(3, "theirs", 8), record(4, "same", 1234)]
    got = reconcile.classify(side(spark, inside), side(spark, outside))
    assert by_category(got) == {"matched": 1, "amount_mismatch": 1, "unmatched_external": 1, "duplicate": 1, "pending_reversal": 1, "unmatched_internal": 2}
    lines = sinks.text_report(got, "in.jsonl", "out.csv")
    assert lines.startswith("Reconciliation report\n  internal:   in.jsonl\n") and "  [amount_mismatch] ref=more internal=7.77 external=10.00 delta=+223\n" in lines
    assert "  [pending_reversal] ref=owed amount=9.01 status=timed_out\n" in lines and "    unmatched_internal   2\n" in lines
    report = json.loads(sinks.json_report(got, "a", "b"))
    assert list(report["by_category"]) == sorted(report["by_category"]) and report["matched_count"] == 1 and len(report["exceptions"]) == 6


def plain(inside, outside):
    """Category and amounts of each outcome, by a loop over rows in order."""
    last, first, out = {}, {}, []
    done = {r for _, r, _, type, status, *_ in inside if type == "reversal" and status == "settled"}
    for row in inside:
        if row[3] != "reversal":
            last[row[1]] = row
    for row in outside:
        if row[1] in first:
            out.append(("duplicate", row[1], None, row[2]))
        else:
            first[row[1]] = row
    for ref, row in first.items():
        mine = last.pop(ref, None) if ref is not None else None
        kind = "unmatched_external" if mine is None else "matched" if mine[2] == row[2] else "amount_mismatch"
        out.append((kind, ref, mine and mine[2], row[2]))
    for ref, row in last.items():
        out.append(("pending_reversal" if row[4] == "failed" and ref not in done else "unmatched_internal", ref, row[2], None))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(4))
def test_blank_references(spark, seed):
    rng = random.Random(seed)
    refs = [None, "", "", "a", "b", "c"]
    inside = [record(i, rng.choice(refs), rng.randint(1, 2), rng.choice(["transfer", "reversal"]), rng.choice(["settled", "failed"])) for i in range(rng.choice([0, 5, 40]))]
    outside = [record(i, rng.choice(refs), rng.randint(1, 2)) for i in range(rng.choice([1, 40]))]
    got = reconcile.classify(side(spark, inside), side(spark, outside))
    rows = got.select("category", "reference", "internal.amount_minor", F.col("external.amount_minor").alias("e")).collect()
    assert sorted(str(tuple(r)) for r in rows) == plain(inside, outside)


def test_blank_references_meet_in_no_window(spark):
    rows = side(spark, [record(1, "", 5)])
    plan = reconcile.blank_ranked(rows).join(reconcile.blank_index(rows).drop("i"), "reference")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_reports_written_by_executors(spark, tmp_path):
    inside, outside = generate.fixture(spark, 30, 4, 5)
    got = reconcile.classify(inside, outside, 120)
    sinks.write_text_report(got.repartition(5), f"{tmp_path}/report", "a", "b")
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == sinks.text_report(got, "a", "b")
    sinks.write_exceptions_json(got, f"{tmp_path}/exceptions")
    assert spark.read.json(f"{tmp_path}/exceptions").count() == 20


def test_newest_run_and_requests_once(spark, tmp_path):
    from ledgerloom.schemas import RUNS

    at = lambda h: __import__("datetime").datetime(2031, 1, 1, h)
    runs = [("z", "i", "e", "completed", 1, 0, '{"input_fingerprint":"p"}', "", at(1)), ("a", "i", "e", "completed", 1, 0, '{"input_fingerprint":"p"}', "", at(2)), ("b", "i", "e", "failed", 1, 0, '{"input_fingerprint":"p"}', "", at(3))]
    assert [tuple(r) for r in sinks.newest_completed(spark.createDataFrame(runs, RUNS)).collect()] == [("p", "a")]
    asked = spark.createDataFrame([("r1", 5, "NGN", "reverse"), ("r2", 6, "NGN", "reverse")], "reference string, amount_minor long, currency string, action string")
    path = f"{tmp_path}/asked"
    assert [sinks.append_requests(asked.limit(n), path, f) for n, f in ((1, "p"), (2, "p"), (2, "p"), (2, "q"))] == [1, 1, 0, 2]
    assert spark.read.parquet(path).count() == 4


def test_files_of_a_folder_are_read_by_name(spark, tmp_path):
    head = "reference,amount_minor\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(head + "R,1\n")
    (tmp_path / "in/b.csv").write_text(head + "R,2\n" + "".join(f"X{i},3\n" for i in range(2000)))
    (tmp_path / "in/c.csv").write_text(head + "R,4\n")
    rows = adapters.read_external(spark, f"{tmp_path}/in", "csv")
    ordered = [r["amount_minor"] for r in rows.where("reference = 'R'").orderBy("seq").collect()]
    assert ordered == [1, 2, 4] and rows.select("seq").distinct().count() == 2003
    assert [r["reference"] for r in rows.where("amount_minor = 3").orderBy("seq").limit(3).collect()] == ["X0", "X1", "X2"]
    one = adapters.fingerprint(spark, f"{tmp_path}/in")
    assert len(one) == 64 and one == adapters.fingerprint(spark, f"{tmp_path}/in")
    (tmp_path / "in/c.csv").write_text(head + "R,5\n")
    assert one != adapters.fingerprint(spark, f"{tmp_path}/in")


def test_quirks(spark):
    # Last internal row counts; status is not compared; window and currency disagreements are mismatches of delta 0.
    inside = [record(1, "A", 1), record(2, "A", 2), record(3, "B", status="failed"), record(4, "C"), record(5, "D"), record(6, "E", type="fee"), record(7, "", 9)]
    outside = [record(1, "A", 2), record(2, "B"), record(3, "C", late=601), record(4, "D", currency="USD"), record(5, "E"), record(6, "", 9), record(7, "F", late=600)]
    got = {r["reference"]: (r["category"], r["delta_minor"], r["reason"]) for r in reconcile.classify(side(spark, inside), side(spark, outside), 600).collect()}
    assert got == {"A": ("matched", None, None), "B": ("matched", None, None), "C": ("amount_mismatch", 0, "window"), "D": ("amount_mismatch", 0, "currency"), "E": ("matched", None, None), "": ("matched", None, None), "F": ("unmatched_external", None, None)}
    close = lambda w: by_category(reconcile.classify(side(spark, [record(1, "A")]), side(spark, [record(1, "A", late=600)]), w))
    assert close(600) == {"matched": 1} and close(599.999) == {"amount_mismatch": 1} and close(0) == {"matched": 1}


@pytest.mark.parametrize("count,per,seed", [(50, 4, 42), (30, 3, 99)])
def test_every_planted_discrepancy_is_found(spark, count, per, seed):
    inside, outside = generate.fixture(spark, count, per, seed)
    got = reconcile.classify(inside, outside, 120)
    assert by_category(got) == {"matched": count + per, **{c: per for c in ("amount_mismatch", "duplicate", "pending_reversal", "unmatched_external", "unmatched_internal")}}
    for r in reconcile.exceptions(got).collect():
        assert r["reference"].split("/")[0] == r["category"]
    reports = {sinks.json_report(reconcile.classify(inside.repartition(k), outside.repartition(7 - k), 120), "a", "b") for k in (1, 3, 5)}
    assert len(reports) == 1


def test_files_and_runs(spark, tmp_path):
    inside, outside = generate.fixture(spark, 20, 2, 1)
    sinks.write_json_lines(inside.coalesce(1), f"{tmp_path}/in")
    sinks.write_fixed_csv(outside.orderBy("seq").coalesce(1), f"{tmp_path}/out")
    read_in, read_out = adapters.read_ledger_json(spark, f"{tmp_path}/in"), adapters.read_external(spark, f"{tmp_path}/out", "nibss")
    got = reconcile.classify(read_in, read_out, 120)
    assert by_category(got) == by_category(reconcile.classify(inside, outside, 120))
    root = f"{tmp_path}/runs"
    first, wrote = sinks.persist(got, root, "in", "out", "f1")
    assert wrote and sinks.persist(got, root, "in", "out", "f1") == (first, False)
    assert sinks.persist(got, root, "in", "out", "f2")[1]
    # Exceptions of a run without its marker do not count.
    sinks.exception_rows(got, "lost").write.mode("append").parquet(f"{root}/exceptions")
    assert sinks.run_exceptions(spark, root).groupBy("run_id").count().collect()[0]["count"] == 10
    assert sinks.run_exceptions(spark, root).select("run_id").distinct().count() == 2


def test_strict_readers(spark, tmp_path):
    head = "session_id,source_account,beneficiary_account,amount_kobo,currency,status,transaction_date"

    def fixed(*lines, header=head):
        path = tmp_path / f"{random.random()}.csv"
        path.write_text("\n".join([header, *lines]) + "\n")
        return adapters.read_external(spark, str(path), "nibss").collect()

    (ok,) = fixed(" NIP-001 , CUST-001 ,CUST-002, 5000 ,NGN,00,2026-05-31T10:00:00Z", header=head.upper())
    assert (ok["reference"], ok["source"], ok["amount_minor"], ok["status"]) == ("NIP-001", "CUST-001", 5000, "settled")
    for bad in ("A,B,C,notanumber,NGN,00,2026-05-31T10:00:00Z", "A,B,C,5,NGN,odd,2026-05-31T10:00:00Z", "A,B,C,5,NGN,00,2026-05-31", "A,B,C,5,NGN,00", "A,B,C,5,NGN,00,2026-05-31T10:00:00Z,more"):
        with pytest.raises(Exception, match="malformed row"):
            fixed(bad)
    with pytest.raises(adapters.MalformedRow):
        fixed("x", header="a,b")
    with pytest.raises(adapters.MalformedRow):
        fixed("x", header=head.replace("currency", "money"))
    with pytest.raises(ValueError, match="unknown external format"):
        adapters.read_external(spark, "x", "xml")
    free = tmp_path / "free.csv"
    free.write_text("extra, Amount_Minor ,REFERENCE\nz,5,R1\nz,6,R2,more\n")
    rows = adapters.read_external(spark, str(free), "csv").orderBy("seq").collect()
    assert [(r["reference"], r["amount_minor"], r["status"], r["currency"], r["initiated_at"]) for r in rows] == [("R1", 5, "settled", "", None), ("R2", 6, "settled", "", None)]
    free.write_text("reference\nR1\n")
    with pytest.raises(adapters.MalformedRow):
        adapters.read_external(spark, str(free), "csv")
    lines = tmp_path / "ledger.jsonl"
    lines.write_text('{"reference":"R1","amount_minor":5,"type":"transfer","status":"settled","currency":"NGN"}\n{"reference":"R2","amount_minor":5.5,"type":"transfer","status":"settled"}\nnot json\n')
    with pytest.raises(Exception, match="malformed row"):
        adapters.read_ledger_json(spark, str(lines)).collect()
    kept = adapters.read_ledger_json(spark, str(lines), quarantine=True).collect()
    assert [r["malformed"] for r in sorted(kept, key=lambda r: r["seq"])] == [False, True, True]


def test_fingerprint(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b").write_bytes(b"")
    want = hashlib.sha256(b"x" * 3_000_000 + b"\0" + b"\0").hexdigest()
    assert adapters.fingerprint(spark, str(tmp_path / "a"), str(tmp_path / "b")) == want


def test_command_line(spark, tmp_path):
    import io

    from ledgerloom.cli import arguments, run

    inside, outside = generate.fixture(spark, 10, 1, 3)
    sinks.write_json_lines(inside.coalesce(1), f"{tmp_path}/in")
    sinks.write_fixed_csv(outside.coalesce(1), f"{tmp_path}/out")
    (a,), (b,) = (list((tmp_path / x).glob("part-*")) for x in ("in", "out"))
    args = ["--internal", str(a), "--external", str(b), "--runs", f"{tmp_path}/runs", "--feedback", f"{tmp_path}/asked", "--format", "json"]
    out, err = io.StringIO(), io.StringIO()
    run(arguments(args), out, err)
    assert json.loads(out.getvalue())["matched_count"] == 11 and "kept" in err.getvalue()
    run(arguments(args), io.StringIO(), err)
    assert "nothing written" in err.getvalue()
    assert spark.read.parquet(f"{tmp_path}/asked").count() == 1  # a repeated run asks for nothing again
    run(arguments([*args, "--format", "text", "--report", f"{tmp_path}/report"]), out, err)
    assert (tmp_path / "report/_SUCCESS").exists()
    with pytest.raises(SystemExit):
        arguments(["--internal", "x"])
