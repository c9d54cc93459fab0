from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import pricing
from gaugework.sources.prices import read_price_history
from helpers import frame, rows

HISTORY = "instance_type string, az string, product string, ts timestamp_ntz, SpotPrice string"
DAY = dt.datetime(2024, 1, 1)


def record(kind, zone, price, minute=0, product="Linux/UNIX"):
    return (kind, zone, product, DAY + dt.timedelta(minutes=minute), price)


def test_average_takes_the_latest_records_of_one_product(spark):
    data = [record("c4", "a", "1.0", i) for i in range(1000)] + [record("c4", "a", "100", -1)]
    data += [record("c4", "b", "0.2"), record("c4", "b", "9", product="Windows"), record("c4", "c", "9", product="Windows")]
    history = frame(spark, data, HISTORY).repartition(8)
    every = {(r["instance_type"], r["az"]): r["price"] for r in pricing.avg_price(history).collect()}
    assert every == {("c4", "a"): pytest.approx(1100 / 1001), ("c4", "b"): 0.2}
    got = {(r["instance_type"], r["az"]): r["price"] for r in pricing.avg_price(history, latest=1000).collect()}
    assert got == {("c4", "a"): 1.0, ("c4", "b"): 0.2}  # the 1001st record and the empty group play no part


@pytest.mark.parametrize("p", [0, 30, 50, 100])
def test_percentile_is_linear_and_inclusive(spark, p):
    prices = {"x": [1.0, 2.0, 4.0, 10.0], "y": [3.0], "z": [2.0, 2.0, 5.0]}
    data = [(k, f"z{i}", v) for k, vs in prices.items() for i, v in enumerate(vs)]
    got = rows(pricing.filter_price_percentile(frame(spark, data, "instance_type string, az string, price double"), p).select("instance_type", "az"))
    assert got == sorted([(k, f"z{i}") for k, vs in prices.items() for i, v in enumerate(vs) if v <= np.percentile(vs, p)], key=repr)


def test_bids_round_half_up_in_decimals(spark):
    df = frame(spark, [("a", 0.0625), ("b", 0.03125), ("c", 0.1)], "az string, price double")
    assert rows(pricing.create_bids(df, 1).select("az", "bid")) == [("a", "0.063"), ("b", "0.031"), ("c", "0.100")]
    assert rows(pricing.create_bids(df).select("az", "bid")) == [("a", "0.125"), ("b", "0.063"), ("c", "0.200")]
    assert rows(pricing.create_bids(df, 1.5).select("az", "bid"))[2] == ("c", "0.150")


@pytest.mark.parametrize("parts", [1, 64])
def test_zone_choice(spark, parts):
    data = [(f"t{i}", f"z{j}", float((i * j) % 5)) for i in range(20) for j in range(6)]
    df = frame(spark, data, "instance_type string, az string, price double").repartition(parts)
    chosen = rows(pricing.choose_zone(df, seed=1))
    assert len(chosen) == 20 and set(chosen) <= set(data)
    assert chosen == rows(pricing.choose_zone(df.repartition(3), seed=1)) and len({z for _, z, _ in chosen}) > 1
    assert chosen != rows(pricing.choose_zone(df, seed=2))
    cheapest = rows(pricing.choose_zone(df, order=[F.col("price"), F.col("az")]))
    assert cheapest == sorted((min((r for r in data if r[0] == f"t{i}"), key=lambda r: (r[2], r[1])) for i in range(20)), key=repr)


def test_deployment_filter(spark):
    df = frame(spark, [(8, "c4.2xlarge"), (8, "m4.2xlarge"), (4, "c4.2xlarge"), (8, "c4.large")], "nodes int, instance_type string")
    assert rows(pricing.deployment_filter(df, (8, 8), ["c4"], ["2xlarge"])) == [(8, "c4.2xlarge")]


def test_cost_counts_each_workload_and_each_deployment_once(spark):
    deployments, workloads = [(8, "0.340"), (4, "0.063")], 3
    cost = sum((n + 1) * (float(b) / 2 * 1.2) * 2 for (n, b), _ in itertools.product(deployments, range(workloads)))
    got = pricing.cost_estimate(frame(spark, deployments, "nodes int, bid string"), workloads).first()
    assert (got["cost"], got["instances"]) == (pytest.approx(cost), 9 + 5)


def test_price_files(spark, tmp_path):
    df = frame(spark, [record("c4", "a", "0.0312"), record("c4", "a", "n/a")], HISTORY)
    for kind in ("json", "parquet"):
        df.write.format(kind).save(str(tmp_path / kind))
        got = read_price_history(spark, str(tmp_path / kind), kind)
        assert sorted(str(r["price"]) for r in got.collect()) == ["0.031200", "None"]
