"""Queries that write their own files deal them to as many tasks as there are rows for."""

from pathlib import Path

import pytest
from kinfold.catalog.queries import queries
from kinfold.session import intermediates

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "most"), [("read_sources", 3), ("stream_gate", 3)])
def test_files_are_not_of_a_fixed_number(spark, name, most):
    """Before, a source had three files and a batch one, whatever their size."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "7")
    spark.conf.set(names[1], "false")
    try:
        before = intermediates(spark)
        queries()[name](spark, FOLDER).count()
        made = [Path(p) for p in intermediates(spark) if p not in before]
        folders = [f for p in made for f in ([*p.iterdir()] if p.name.startswith("sources") else [p / "in"]) if f.is_dir()]
        counts = [len([*f.glob("part-*.json")]) for f in folders]
        assert counts and max(counts) > most and all(c in (0, 7, 21) for c in counts)
    finally:
        for n, value in old.items():
            spark.conf.set(n, value)
