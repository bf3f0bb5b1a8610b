"""Counts of distinct publications by cohort and window, without the pairs of cohorts and publications."""

import json
import random
from datetime import datetime

import pytest

from gridloom.plans import registry
from tests.conftest import Compared

NAME = "c_20_dataset_exposure"
CELLS = "row_id long, dataset_key string, cell_id string, first_seen_at timestamp"
PAGES = "row_id long, dataset_key string, pages_json string"


def tables(spark, path, cells, pages):
    """The two tables of the query: cells (key, cell, year), pages (key, [(id, year)])."""
    at = [(i, k, c, y and datetime(y, 6, 1)) for i, (k, c, y) in enumerate(cells)]
    texts = [(i, k, None if p is None else json.dumps([{"id": a, "year": y} for a, y in p])) for i, (k, p) in enumerate(pages)]
    spark.createDataFrame(at, CELLS).coalesce(1).write.parquet(f"{path}/w/cells")
    spark.createDataFrame(texts, PAGES).coalesce(1).write.parquet(f"{path}/w/pages")
    for part, name in (("cells", "gbif_dataset_cells"), ("pages", "dataset_literature_cache")):
        next((path / "w" / part).glob("*.parquet")).rename(path / f"{name}.parquet")
    return str(path)


def held(spark, sf):
    Compared(sf).same(registry.queries()[NAME](spark, sf), registry.oracle_sql()[NAME])


def shuffled(spark):
    """Records that shuffles of this session wrote so far."""
    py = spark.sparkContext
    py._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = py._jsc.sc().statusStore().stageList(None, False, False, py._gateway.new_array(py._jvm.double, 0), py._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("seed", range(3))
def test_publications_of_several_datasets_and_years_count_once(spark, tmp_path, seed):
    r = random.Random(seed)
    keys = ["a", "b", "c", "{D}", "d", "urn:uuid:a", " B ", "", None]
    cells = [(r.choice(keys), r.choice(["1_1", "1_2", "2_1", None]), r.choice([None, *range(2010, 2020)])) for _ in range(150)]
    pages = [(r.choice(keys), r.choice([None, [(r.choice(["p", "q", "s", "t", "u", None]), r.choice([None, *range(2008, 2026)])) for _ in range(r.randrange(5))]])) for _ in range(60)]
    held(spark, tables(spark, tmp_path, cells, pages))


def test_publications_without_an_id_give_a_row_of_zero(spark, tmp_path):
    sf = tables(spark, tmp_path, [("a", "1_1", 2012), ("b", "1_1", 2012), ("b", "2_2", 2015)], [("a", [(None, 2013)]), ("b", [(None, 2013), ("p", 2020)])])
    held(spark, sf)
    rows = {(x["cell_id"], x["window"]): x["n_publications"] for x in registry.queries()[NAME](spark, sf).collect()}
    assert rows == {("1_1", 3): 0, ("1_1", 5): 0, ("1_1", 10): 1, ("2_2", 5): 1, ("2_2", 10): 1}


def test_a_large_dataset_is_not_paired_with_its_publications(spark, tmp_path):
    n = 1000
    cells = [("a", f"{i}_0", 2012 + i % 3) for i in range(n)] + [("b", f"{i}_0", 2012) for i in range(0, n, 2)]
    pages = [("a", [(f"p{i}", 2012 + i % 9)]) for i in range(n)] + [("b", [(f"q{i}", 2013), (f"q{i}", 2016)]) for i in range(n)]
    # the same publications in two large datasets
    pages += [(k, [(f"r{i}", 2014)]) for i in range(n) for k in "ab"]
    sf = tables(spark, tmp_path, cells, pages)
    before = shuffled(spark)
    df = registry.queries()[NAME](spark, sf)
    df.collect()
    assert shuffled(spark) - before < 10 * (len(cells) + len(pages))
    held(spark, sf)
