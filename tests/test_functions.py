from pyspark.sql import functions as F

from ledgerloom.functions import money, rail, text
from ledgerloom.functions.rail import Chaos
from ledgerloom.operators import lifecycle
from ledgerloom.schemas import EDGES, STATE_OF_STATUS, TERMINAL


def values(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    return [tuple(r) for r in spark.createDataFrame(rows, names).select(*columns).collect()]


def test_money(spark):
    cases = {0: "0.00", 5: "0.05", 99: "0.99", 100: "1.00", 123456: "1234.56", -5: "-0.05", -250: "-2.50", 2**62: "46116860184273879.04"}
    assert values(spark, [(k,) for k in cases], money.formatted(F.col("c0"))) == [(v,) for v in cases.values()]
    texts = ["5", "-7", "+3", "12.5", "", "x", "1e3", "99999999999999999999", " 4"]
    assert [r[0] for r in values(spark, [(t,) for t in texts], money.strict_integer(F.col("c0")))] == [5, -7, 3, None, None, None, None, None, None]


def test_sums_raise_instead_of_wrapping(spark):
    import pytest

    with pytest.raises(Exception, match="OVERFLOW"):
        spark.sql("select sum(x) from values (9223372036854775807L), (1L) t(x)").collect()


def test_text(spark):
    tokens = ["00", " success ", " Settled\t", "", None, "01", "91", "declined", "reversed", "Timeout", "nonsense"]
    assert [r[0] for r in values(spark, [(t, 1) for t in tokens], text.status_of_token(F.col("c0")))] == ["settled"] * 5 + ["pending", "failed", "failed", "reversed", "timed_out", None]
    times = ["2026-05-31T10:00:00Z", "2026-05-31T11:00:00+01:00", "2026-05-31", "2026-05-31 10:00:00", ""]
    assert [r[0] for r in values(spark, [(t,) for t in times], text.format_rfc3339(text.parse_rfc3339(F.col("c0"))))] == ["2026-05-31T10:00:00Z"] * 2 + [None] * 3
    merged = spark.sql("select map('a', '1', 'b', '2') m, map('b', '3') n").select(text.merge_metadata(F.col("m"), F.col("n"))).first()[0]
    assert merged == {"a": "1", "b": "3"}


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_rail_hash(spark):
    refs = [f"chaos-{i}" for i in range(60)] + ["", "é", "O-0"]
    got = values(spark, [(r,) for r in refs], rail.u01(42, F.col("c0"), "decline"), rail.u01(-1, F.col("c0"), "x"))
    for r, (a, b) in zip(refs, got, strict=True):
        assert a == fnv((42).to_bytes(8, "little") + r.encode() + b"\0decline") / 2**64
        assert b == fnv((-1).to_bytes(8, "little", signed=True) + r.encode() + b"\0x") / 2**64
    assert got[-1][0] == 0.7064580638109832


def test_published_outcome_split(spark):
    """60 references, seed 42: 40 settled, 14 reversed, 6 held."""
    rows = spark.range(60).select("id", F.concat(F.lit("chaos-"), F.col("id").cast("string")).alias("reference"), F.lit(5000).cast("long").alias("amount_minor"), F.lit("A").alias("source"), F.lit("B").alias("destination"))
    done = lifecycle.driven(lifecycle.rail_outcomes(rows, Chaos()))
    assert {r["status"]: r["n"] for r in lifecycle.outcome_split(done).collect()} == {"settled": 40, "reversed": 14, "manual_review": 6}
    # Order and partitioning do not matter.
    again = lifecycle.driven(lifecycle.rail_outcomes(rows.orderBy(F.desc("id")).repartition(7), Chaos()))
    assert sorted(map(str, done.select("id", "status").collect())) == sorted(map(str, again.select("id", "status").collect()))


def test_edges(spark):
    names = sorted({*EDGES, *TERMINAL})
    pairs = [(a, b) for a in names for b in names]
    got = values(spark, pairs, lifecycle.legal(F.col("c0"), F.col("c1")), lifecycle.is_terminal(F.col("c0")))
    for (a, b), (ok, end) in zip(pairs, got, strict=True):
        assert ok == (b in EDGES.get(a, ())) and end == (a in TERMINAL)
    assert sum(r[0] for r in got) == 9
    assert set(STATE_OF_STATUS) == set(names)


def test_draws_of_nulls_and_batches(spark):
    rows = spark.range(25_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("r"))
    got = rows.select("r", rail.draws(3, F.col("r"), "a", "b").alias("d")).collect()
    for x in got[::997]:
        want = None if x["r"] is None else [fnv((3).to_bytes(8, "little") + x["r"].encode() + b"\0" + n) / 2**64 for n in (b"a", b"b")]
        assert x["d"] == want


def test_verdicts_of_asking(spark):
    said = [(["unknown", "success", "declined"],), (["unknown", None, "declined"],), (["unknown", "unknown", "unknown", "success"],), ([],)]
    got = spark.createDataFrame(said, "v array<string>").select(lifecycle.queried(F.col("v"), 3)).collect()
    assert [r[0] for r in got] == ["success", "declined", "unknown", "unknown"]


def test_events_without_a_handler_raise(spark):
    import pytest

    t = spark.createDataFrame([(1, "pending")], "id long, status string")
    e = spark.createDataFrame([("1", "nonsense")], "aggregate_id string, event_type string")
    with pytest.raises(Exception, match="no handler"):
        lifecycle.dispatched(t, e, F.lit(True), F.lit("success"), F.lit("success")).collect()
