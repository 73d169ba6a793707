"""What bounds memory and state calls: joins that aren't sent, lists cut before they are joined, similarities held in slices."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

import __spark_entry__ as entry
from shelfloom.operators import ivf, matching
from shelfloom.streaming import keyed

D = "/root/testdata/sf0.001"


def test_hash_keys_are_not_broadcast(spark):
    df = spark.range(1, 400).selectExpr("id as k", "xxhash64(id) as h")
    pairs = matching.hamming_pairs(df, "k", "h", 6)
    pairs.collect()
    assert "SortMergeJoin" in pairs._jdf.queryExecution().executedPlan().toString()
    near = matching.hamming_near(df, df.filter("k % 3 = 0"), "h", 4)
    near.collect()
    assert "SortMergeJoin" in near._jdf.queryExecution().executedPlan().toString()


def test_similarities_are_held_in_slices():
    random = np.random.default_rng(4)
    vectors = lambda n: pa.array(random.normal(size=(n, 4)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    rows = pa.table({"key": pa.array(range(20_000)), "vector": vectors(20_000)})
    asked = pa.table({"query": pa.array(range(500)), "asked": vectors(500)})
    tracemalloc.start()
    found = ivf._hits(0.5, 10)(rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 500 and peak < 40e6


def test_lists_are_cut_before_they_meet_products(spark):
    plan = entry.queries()["product_search"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(p_name#\d+, engine#\d+", plan) and "windowspecdefinition(product_key" in plan


class _State:
    """A state variable that counts its calls."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "updateValue"):
                self.kept[args[0] if name == "updateValue" else None] = args[-1]
            elif name == "clear":
                self.kept.clear()
            return {"containsKey": lambda: args[0] in self.kept, "exists": lambda: None in self.kept, "get": lambda: self.kept[None], "listTimers": list}.get(name, lambda: None)()

        return call


def test_an_item_is_looked_up_once_a_batch():
    list_of, until = _State(), _State()
    one = keyed.Blacklist(10.0)
    one.handle, one.items, one.until = _State(), list_of, until
    batch = lambda rows: iter([pd.DataFrame(rows, columns=["at", "event_id", "item", "rejects"])])
    run = lambda rows: pd.concat(one.handleInputRows(("u",), batch(rows), None))["blocked"].tolist()
    assert run([(2.0, 2, 7, False), (1.0, 1, 7, True), *[(3.0, i, 7, False) for i in range(3, 90)], (4.0, 99, 8, False)]) == [True] * 88 + [False]
    assert list_of.calls <= 3 and list_of.kept.keys() == {(7,)}
    assert run([(5.0, 100, 7, False), (12.0, 101, 7, False), (13.0, 102, 8, True), (14.0, 103, 7, False), (14.0, 104, 8, False)]) == [True, False, False, True]
    assert list_of.kept.keys() == {(8,)} and until.kept[None] == (23.0,)


def test_a_vectors_length_is_taken_once(spark):
    plan = entry.queries()["sku_match"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert above.count("zip_with") + above.count("zipwith") < 3 and "norm#" in above
