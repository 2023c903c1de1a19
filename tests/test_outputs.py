"""Bundles of tables: places, manifests, inputs that are missing or change."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import outputs as O


def test_a_bundle_is_written_once_and_verified(spark, tmp_path):
    root = str(tmp_path / "out")
    tables = {"a": spark.range(5), "b": spark.range(3).withColumn("x", F.lit("y"))}
    made = {r["name"]: (r["rows"], r["columns"]) for r in O.write(spark, root, "run1", tables, {"in": spark.range(9)}).collect()}
    assert made == {"a": (5, "id"), "b": (3, "id,x")}
    with pytest.raises(FileExistsError):
        O.write(spark, root, "run1", tables)
    O.write(spark, root, "run2", {"a": spark.range(2)})
    assert O.write(spark, root, "run2", {"a": spark.range(4)}, replace=True).first()["rows"] == 4
    assert {r["name"]: r.sound for r in O.verify(spark, root, "run1").collect()} == {"a": True, "b": True}
    spark.range(1).write.mode("append").parquet(f"{root}/run1/a")
    assert {r["name"]: r.sound for r in O.verify(spark, root, "run1").collect()} == {"a": False, "b": True}


def test_missing_inputs_are_all_named(spark, tmp_path):
    (tmp_path / "there").mkdir()
    O.require(spark, [str(tmp_path / "there")])
    with pytest.raises(O.MissingInput, match="gone1.*gone2"):
        O.require(spark, [str(tmp_path / "gone1"), str(tmp_path / "there"), str(tmp_path / "gone2")])
    with pytest.raises(O.MissingInput):
        O.verify(spark, str(tmp_path), "no-run")


@pytest.mark.parametrize("run, names", [("r", ["a", "a"]), ("..", ["a"]), ("r", ["a/b"]), ("r", [""]), ("a/b", ["x"])])
def test_places_stay_within_their_run(run, names):
    with pytest.raises(ValueError):
        O.places("/x", run, names)
    assert O.places("/x/", "r", ["a"]) == {"a": "/x/r/a"}


def test_an_input_that_changes_leaves_no_manifest(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(path)

    class Moving:
        """A table that grows when its rows are read a second time."""

        reads = 0

        def __getattr__(self, name):
            if name == "agg":
                Moving.reads += 1
                if Moving.reads == 2:
                    spark.range(1).write.mode("append").parquet(path)
            return getattr(spark.read.parquet(path), name)

    with pytest.raises(O.ChangedInput, match="moving"):
        O.write(spark, root, "run", {"a": spark.range(2)}, {"moving": Moving()})
    assert not O.exists(spark, f"{root}/run/manifest")


def test_bands_and_states_are_counted_with_those_unknown(spark):
    card = spark.createDataFrame([("A", "Healthy", "online"), ("B", None, "full_outage"), ("C", "Healthy", "full_outage")], "station_id string, health_band string, status string")
    got = {(r.category, r.value): r.n for r in O.distribution(card).collect()}
    assert got == {("health_band", "Healthy"): 2, ("health_band", "none"): 1, ("status", "online"): 1, ("status", "full_outage"): 2, ("active_outage", "yes"): 2}
