"""The sources whose schema is to be found out are read record by record; no file is held as one value."""

from types import SimpleNamespace

from loomcast.plans import engine, record_queries
from loomcast.plans.store import ship

SF = "/root/testdata/sf0.001"


def test_no_source_is_one_value(spark, monkeypatch):
    ship(spark)
    taken = []
    monkeypatch.setattr(engine, "transform_cells", lambda cells, *_: taken.append(cells) or SimpleNamespace())
    record_queries._unforced(spark, SF)
    plan = taken[0]._jdf.queryExecution().analyzed().toString()
    assert "collect_list" not in plan
    n = taken[0].select("source_id", "rec").distinct().count()
    assert n == spark.read.parquet(f"{SF}/customer.parquet").count() + spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert {r.format for r in taken[0].select("format").distinct().collect()} == {"json"}
