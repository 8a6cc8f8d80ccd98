import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seismark.config import CostConfig, LabelConfig, ModelConfig, SignalConfig
from seismark.operators import alignment, backtest, cleaning, drawdown, features, forest, intensity, labels, quality_gate, retrain, signals
from seismark.plans import registry
from seismark.plans.context import Context
from seismark.sources import bars as source

SF = "/root/testdata/sf0.001"
DAY = dt.date(2021, 1, 4)


def series(spark, closes, symbol="A"):
    rows = [(symbol, DAY + dt.timedelta(i), *[float(c)] * 4, 100) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "dt").collect()]


def test_constant_growth(spark):
    d = features.slope_accel(series(spark, [100 * math.exp(0.01 * i) for i in range(12)]))
    assert column(d, "slope")[:4] == [None] * 4
    assert column(d, "slope")[-1] == pytest.approx(1.0) and column(d, "accel")[-1] == pytest.approx(0, abs=1e-9)


def test_quadratic_accel_and_zero_price(spark):
    d = features.slope_accel(series(spark, [100 * math.exp(0.002 * i * i) for i in range(10)]))
    assert column(d, "accel")[-1] == pytest.approx(0.4)
    gone = column(features.slope_accel(series(spark, [0.0 if i == 5 else 10.0 for i in range(12)])), "slope")
    assert gone[5:10] == [None] * 5 and gone[10] == pytest.approx(0)


def test_future_does_not_change_the_past(spark):
    bars = source.from_lineitem(spark, SF).filter("symbol IN ('Brand#1', 'Brand#2')")
    cut = dt.date(1999, 1, 1)
    bent = bars.withColumn("close", F.when(F.col("dt") >= F.lit(cut), F.col("close") * 7).otherwise(F.col("close")))
    past = lambda b: features.precursors(cleaning.flagged(b)).filter(F.col("dt") < F.lit(cut)).orderBy("symbol", "dt").collect()
    assert past(bars) == past(bent)


def test_labels(spark):
    b = series(spark, [100.0, 90, 80, 95, 100, 100])
    d = labels.label_days(b, LabelConfig(horizon=4))
    assert column(d, "fwd_dd")[0] == pytest.approx(-0.2) and column(d, "fwd_dd")[-1] is None
    flags = spark.createDataFrame([("A", DAY + dt.timedelta(i), i, i in (0, 4, 10, 21)) for i in range(25)], "symbol string, dt date, pos int, hit boolean")
    assert [r.dt.day for r in labels.onsets(flags, "hit", 10).orderBy("dt").collect()] == [4, 14, 25]


def test_state_machine_acts_on_the_next_bar():
    c, state, seen = SignalConfig(), signals.START, []
    for t in range(30):
        held = state[0]
        state, action = signals.step(state, t == 5, False, False, 0.0, False, c)
        seen.append((held, action))
    assert seen[5] == (True, "EXIT") and seen[6][0] is False
    assert [i for i, (_, a) in enumerate(seen) if a == "ENTER"] == [25]


def test_watch_opens_stands_down_and_confirms():
    c = SignalConfig()
    state, _ = signals.step(signals.START, False, True, False, 0.0, False, c)
    assert state[2] == 5
    assert signals.step(state, False, False, False, 1.0, False, c)[0][2] == 0
    assert signals.step(state, False, False, True, -1.0, False, c)[1] == "EXIT_WATCH"


def test_drawdown_literal(spark):
    e = spark.createDataFrame([(DAY + dt.timedelta(i), float(v)) for i, v in enumerate([100, 120, 90, 110, 130])], "dt date, equity double")
    s = drawdown.stats(e).first()
    day = lambda i: DAY + dt.timedelta(i)
    assert (s.max_drawdown, s.max_dd_start, s.max_dd_trough, s.max_dd_recovered) == (-0.25, day(1), day(2), day(4))
    assert (s.days_under_water, s.longest_underwater, s.time_to_recover) == (2, 2, 2)


def test_tax_classes_and_years(spark):
    sales = spark.createDataFrame([(dt.date(2024, 3, 31), 100.0, 364), (dt.date(2024, 4, 1), -50.0, 364), (dt.date(2024, 8, 1), 200_000.0, 365)], "sold_on date, gain double, holding_days int")
    t = {r.fy: r for r in backtest.capital_gains(sales).collect()}
    assert t[2023].tax == pytest.approx(15) and t[2024].stcg_gain == -50 and t[2024].tax == pytest.approx(75_000 * 0.125)


def test_sleeve_identities(spark):
    d = series(spark, [10.0, 11, 12]).select("symbol", "dt", "close", F.lit(True).alias("in_position"), F.lit(1.0).alias("vol_ratio"))
    fold = backtest.sleeves(d, 1000.0, CostConfig())
    rows = fold.orderBy("dt").collect()
    assert [r.side for r in rows] == ["buy", None, None] and rows[0].qty == 99 and rows[-1].cash > 0
    assert backtest.open_lots(fold, d).first().gain == pytest.approx((12 - rows[0].price) * 99)


def test_gate_blocks_bad_bars(spark):
    bars = cleaning.flagged(series(spark, [10.0, 10, 30, 30]))
    audit = cleaning.audit(series(spark, [10.0, 10, 30, 30]).withColumn("seq", F.lit(0)))
    table = quality_gate.checks(bars, audit)
    assert not table.filter("name = 'no_unadjusted_corporate_actions'").first().passed
    with pytest.raises(RuntimeError):
        quality_gate.enforce(table)


def test_forest_is_reproducible_and_finds_outliers(spark, tmp_path):
    rows = [("A", DAY + dt.timedelta(i), *[math.sin(i * (k + 1)) for k in range(10)]) for i in range(400)] + [("B", DAY, *[9.0] * 10), ("C", DAY, *[None] + [0.0] * 9)]
    from seismark.config import FEATURE_COLUMNS

    f = spark.createDataFrame(rows, "symbol string, dt date, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    one = forest.fit(f, ModelConfig(trees=30, samples=64))
    one.save(str(tmp_path / "m"))
    again = forest.Forest.load(spark, str(tmp_path / "m"))
    assert (again.scale == one.scale).all() and len(one.scale) == 401 and again.samples == one.samples
    a, b = (forest.score(f, m).orderBy("symbol", "dt").collect() for m in (one, again))
    assert a == b
    scores = {r.symbol: r.score for r in a}
    assert scores["C"] is None and scores["B"] > max(r.score for r in a if r.symbol == "A")
    scored = intensity.ecdf(forest.score(f, one), forest.score(f, one)).filter("symbol = 'A'")
    assert scored.agg(F.avg("intensity")).first()[0] == pytest.approx(0.5, abs=0.03)
    own = {(r.symbol, r.dt): r.intensity for r in a}
    assert all(own[r.symbol, r.dt] == pytest.approx(r.intensity) for r in scored.collect())
    without = forest.fit(f, ModelConfig(trees=30, samples=64), exclude_dates=f.filter("symbol = 'B'").select("dt"))
    assert len(without.scale) == 399


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        signals.reentry("nonsense")
    with pytest.raises(ValueError):
        retrain.training_slice(spark.createDataFrame([], "symbol string, dt date"), "2020-01-01", "nonsense")


def test_csv_source_and_sinks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "ABC.csv").write_text("date,open,high,low,close,volume,adjusted_close\n02-01-2020,1,2,1,2,10,2\n03-01-2020,2,2,2,2,0,2\n")
    raw = source.read_csv(spark, str(tmp_path / "raw"))
    assert [(r.symbol, r.dt.day, r.adj_close) for r in raw.orderBy("dt").collect()] == [("ABC", 2, 2.0), ("ABC", 3, 2.0)]
    done = cleaning.clean(raw)
    source.write_parquet(done, str(tmp_path / "out"), "symbol")
    assert source.read_if_there(spark, str(tmp_path / "out"), done.schema).count() == 2
    assert source.read_if_there(spark, str(tmp_path / "none"), done.schema).count() == 0


def test_entry_and_calendar(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    c = Context(spark, SF)
    assert alignment.grid(c.bars, c.days).count() == c.days.count() * c.bars.select("symbol").distinct().count()


def test_streamed_signals_equal_batch(spark, tmp_path):
    from seismark.streaming import replay

    rows = [("A", DAY + dt.timedelta(i), 0.995 if i in (4, 40) else 0.5, "AcceleratingDecline" if i < 8 else "Flat", -0.2) for i in range(60)]
    frame = spark.createDataFrame(rows, "symbol string, dt date, intensity double, phase string, slope_z double")
    inputs = signals.prepared(frame)
    for k in range(3):
        inputs.filter(F.pmod(F.floor(F.datediff("dt", F.lit(DAY)) / 20), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    out = replay.run(spark, [str(tmp_path / f"in/b{k}") for k in range(3)], str(tmp_path / "out"), str(tmp_path / "state"))
    same = lambda d: [(r.dt, r.in_position, r.action) for r in d.orderBy("dt").collect()]
    assert same(out) == same(signals.generate(frame))


def test_forest_trees_draw_from_all_rows(spark):
    c = ModelConfig(trees=60, samples=16)
    rows = spark.createDataFrame([("A", DAY + dt.timedelta(i), float(i)) for i in range(3000)], "symbol string, dt date, x double")

    def samples(r):
        numbers, by_tree = forest.numbered(r, ("x",)), {}
        assert numbers.total == 3000
        for d in forest.draw(numbers.frame, {"k": numbers.spans()}, [("k", t, 16) for t in range(60)]).collect():
            by_tree.setdefault(d.tree, []).append(d.x)
        return {t: sorted(v) for t, v in by_tree.items()}

    drawn = samples(rows)
    assert set(drawn) == set(range(60)) and all(len(set(v)) == len(v) == 16 for v in drawn.values())
    assert len({x for v in drawn.values() for x in v}) > 20 * 16
    assert drawn == samples(rows.repartition(7, "x"))
    assert {r.tree for r in forest.fit(rows, c, ("x",)).nodes.collect()} == set(range(60))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.date() if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_market_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in found.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()) == want


def test_slices_and_walk_forward(spark):
    from seismark.config import FEATURE_COLUMNS, RetrainConfig

    days = [dt.date(2018, 1, 1) + dt.timedelta(i) for i in range(0, 1200, 3)]
    rows = [(f"S{s}", d, *[math.sin(i * (k + 1) + s) if k or i % 5 else None for k in range(10)]) for s in range(4) for i, d in enumerate(days)]
    f = spark.createDataFrame(rows, "symbol string, dt date, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    market = spark.createDataFrame([(d, float(i % 100)) for i, d in enumerate(days)], "dt date, dispersion double")
    c, m = RetrainConfig(rolling_years=1, min_train_rows=50), ModelConfig(trees=5, samples=16)
    schedule = spark.createDataFrame([(dt.date(2020, 3, 1), dt.date(2020, 4, 1)), (dt.date(2020, 4, 1), dt.date(2020, 5, 1))], "as_of date, block_end date")
    for scheme in c.schemes:
        frame, spans = retrain._numbered_slices(f, ["2020-03-01", "2020-04-01"], scheme, market, c, 0)
        for as_of, got in spans.items():
            numbers = {int(a) + k for a, n in got for k in range(int(n))}
            mine = frame.filter(F.col("key") == as_of) if scheme == "ewma" else frame
            held = {(r.symbol, r.dt) for r in mine.filter(F.col("g").isin(sorted(numbers))).collect()}
            want = retrain.training_slice(f, as_of, scheme, market, c).dropna()
            assert held == {(r.symbol, r.dt) for r in want.collect()} and all(d < dt.date.fromisoformat(as_of) for _, d in held)
        done = retrain.walk_forward(f, schedule, scheme, market, c, m).collect()
        assert {str(r.as_of) for r in done} == {"2020-03-01", "2020-04-01"} and all(r.as_of <= r.dt for r in done)
        assert all((r.score is None) == (r.intensity is None) for r in done) and any(r.score for r in done)
    assert retrain.walk_forward(f, schedule, "rolling", market, RetrainConfig(min_train_rows=10**6), m).count() == 0


def test_index_threshold_windows_and_strict_load(spark):
    from seismark.config import WindowConfig

    b = series(spark, [100.0, 94, 94, 94, 94, 94], "IDX").unionByName(series(spark, [100.0, 94, 94, 94, 94, 94], "A"))
    crashed = {r.symbol for r in labels.label_events(b, index_symbol="IDX").filter("kind = 'crash'").collect()}
    assert crashed == {"IDX"} and LabelConfig().crash < LabelConfig().index_crash
    with pytest.raises(ValueError):
        WindowConfig(train_end="2021-06-01")
    assert WindowConfig().backtest_years == pytest.approx(5.43, abs=0.01)
    raw = b.withColumn("seq", F.lit(0))
    with pytest.raises(LookupError):
        cleaning.load_symbol(raw, "NONE")
    with pytest.raises(ValueError):
        cleaning.load_symbol(raw, "A")
    assert cleaning.load_symbol(raw, "A", strict=False).count() == 6
    assert cleaning.unknown_symbols(raw, [" idx ", "B"]) == ["B"] and cleaning.universe(raw, ["idx"], usable_only=False).count() == 6
    audit, table = cleaning.audit(raw), quality_gate.checks(cleaning.flagged(b), cleaning.audit(raw))
    assert audit.count() == 2 and not table.filter("name = 'universe_size'").first().passed
    failed = {r.name for r in table.filter("severity = 'ERROR' AND NOT passed").collect()}
    if failed <= set(quality_gate.WHOLE_UNIVERSE):
        quality_gate.enforce(table, small_universe=True)


def test_csv_order_in_splits(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    lines = [f"{d:02d}-01-2020,1,1,1,{p},5,1" for p in range(1, 400) for d in (2, 3)]
    (tmp_path / "raw" / "ABC.csv").write_text("date,open,high,low,close,volume,adjusted_close\n" + "\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        raw = source.read_csv(spark, str(tmp_path / "raw"))
        assert raw.rdd.getNumPartitions() > 3
        assert {r.close for r in cleaning.dedupe(raw).collect()} == {399.0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dashboard_page(spark):
    from seismark.operators import report

    symbols = spark.createDataFrame([("A", -0.3, -0.2), ("B", -0.3, -0.3), ("C", -0.2, -0.4)], "symbol string, bh_max_drawdown double, strategy_max_drawdown double")
    sides = {r.symbol: r.side for r in report.scatter_chart(symbols).collect()}
    assert sides == {"A": "shallower", "B": "unchanged", "C": "deeper"}
    flat = spark.createDataFrame([(DAY + dt.timedelta(i), float(v)) for i, v in enumerate([1, 2, 1])], "dt date, equity double")
    portfolio = report.portfolio_chart(flat, flat.withColumn("equity", F.lit(1.0)))
    assert [(r.strategy_dd, r.benchmark_dd) for r in portfolio.orderBy("dt").collect()] == [(0, 0), (0, 0), (-0.5, 0)]
    many = spark.range(700).select(F.format_string("<s%d>", "id").alias("symbol"))
    payload = spark.createDataFrame([("A", 1), ("B", 2), ("C</script>", 3)], "symbol string, sessions int")
    page = report.dashboard("T & T", {"cagr": 0.1234, "trades": 3, "costs": 1234567.0}, portfolio, symbols, report.scheme_chart({"x": flat}), symbols, many, payload)
    assert "T &amp; T" in page and "12.34%" in page and "Rs 1,234,567" in page and "The first 500 of 700 rows." in page
    assert "&lt;s1&gt;" in page and "C</script>" not in page and page.count("<section") == 5 and page.count("<circle") == 3
    with pytest.raises(ValueError):
        report.dashboard("", {}, portfolio, symbols, report.scheme_chart({"x": flat}), symbols, many, payload.unionByName(payload.select(F.concat("symbol", F.lit("2")).alias("symbol"), "sessions")))
