"""Every query of the catalog against its SQL, and the driver's entry points without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = sorted(columns, key=lambda c: (want[c].dtype == float, c))
    got, want = (x[columns].sort_values(order, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_series_of_any_length_are_whole(spark, tmp_path):
    rows = [(n, i, float((i * 7 + n) % 10) + i / 8) for n in (1, 2, 3, 11, 12, 13, 40) for i in range(n)]
    pd.DataFrame([(k, u, pd.Timestamp(2024, 1, 1) + pd.Timedelta(i, "h"), v) for k, (u, i, v) in enumerate(rows)], columns=["event_id", "user_id", "ts", "value"]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    pd.DataFrame([(k, u, pd.Timestamp(2024, 1, 1) + pd.Timedelta(i, "h"), v) for k, (u, i, v) in enumerate(rows)], columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]).to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name, key in (("seq_level_samp_whole", "user_id"), ("seq_robust_whole", "o_custkey")):
        got, want = (x.sort_values(key, ignore_index=True) for x in (catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df()))
        assert list(got[key]) == [1, 2, 3, 11, 12, 13, 40]
        pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False, rtol=0, atol=1e-9)
    got = catalog.QUERIES["seq_level_samp_whole"](spark, str(tmp_path)).toPandas().set_index("user_id")
    assert got["last"].to_dict() == {u: v for u, i, v in rows if i == u - 1} and got["std"].isna().to_dict()[1] and (got.positive_steps + got.negative_steps <= got.index - 1).all() and got.positive_steps[40] + got.negative_steps[40] == 39


def test_entry_without_optional_parts(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for f in (root / "tessera").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
