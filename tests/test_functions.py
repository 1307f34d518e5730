"""Ordered helpers against plain windows and Python; text, digest and median helpers."""
from __future__ import annotations

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions import canon, quantiles, text
from auditframe.functions.ordered import latest, neighbour, positions, running_sums, with_chunks
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(7)
    # One hot key holds most rows; order values are sparse.
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}", o, rnd.choice([None, 1, 2, 5])) for o in rnd.sample(range(5000), 600)]
    return spark.createDataFrame(data, "key STRING, o BIGINT, v INT").cache()


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("back", [False, True])
def test_neighbour_equals_plain_window(sample, size, back):
    plain = Window.partitionBy("key").orderBy("o")
    fn = F.lag if back else F.lead
    want = sample.select("key", "o", fn("v").over(plain).alias("n"))
    got = neighbour(sample, ["key"], "o", F.col("v"), "n", back=back, size=size)
    assert rows(got, "key", "o", "n") == rows(want, "key", "o", "n")


@pytest.mark.parametrize("size", [1, 33, 10_000])
def test_running_sums_and_positions_equal_plain_window(sample, size):
    plain = Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = sample.select("key", "o", F.coalesce(F.sum("v").over(plain), F.lit(0)).alias("s"), F.count("*").over(plain).alias("p"))
    got = positions(running_sums(sample, ["key"], "o", {"s": F.col("v")}, size=size), ["key"], "o", "p", size=size)
    assert rows(got, "key", "o", "s", "p") == rows(want)
    everything = positions(sample, [], "o", "p", size=size)
    assert [r.p for r in everything.orderBy("o").collect()] == list(range(1, 601))


def test_results_do_not_depend_on_partitioning(sample):
    once = neighbour(sample, ["key"], "o", F.col("v"), "n", size=50)
    again = neighbour(sample.repartition(13, "v"), ["key"], "o", F.col("v"), "n", size=50)
    assert rows(once, "key", "o", "n") == rows(again, "key", "o", "n")


def test_shared_chunks_give_the_same_and_save_a_shuffle(sample):
    def chained(df):
        return running_sums(neighbour(df, ["key"], "o", F.col("v"), "n", size=50), ["key"], "o", {"s": F.col("n")}, size=50)

    shared = chained(with_chunks(sample, "o", 50))
    assert rows(shared, "key", "o", "n", "s") == rows(chained(sample), "key", "o", "n", "s")


def test_latest_keeps_the_last_row(make):
    d = make("k INT, o INT, v STRING", (1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None))
    assert rows(latest(d, ["k"], "o", "v")) == [(1, "c"), (2, None)]


@pytest.mark.parametrize("n", [1, 2, 5, 4000, 4001])
def test_exact_median(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([0.0, rnd.random() * 1e6, -3.5]) for _ in range(n)]
    d = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None), ("b", 4.0)], "k STRING, v DOUBLE")
    got = dict(rows(quantiles.exact_median(d, ["k"], "v", "m"), "k", "m"))
    assert got == {"a": statistics.median(values), "b": 2.5}
    assert quantiles.exact_median(d.where("k = 'a'"), [], "v", "m").collect()[0].m == statistics.median(values)


def test_canonical_json_and_digest(make):
    d = make("b INT, a STRING, c ARRAY<INT>", (1, "é\"x", [2, 1]), (None, None, None))
    fields = {"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}
    got = [r[0] for r in d.select(canon.digest(fields)).collect()]
    want = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in ({"b": 1, "a": "é\"x", "c": [2, 1]}, {"a": None, "b": None, "c": None})]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_scalar_helpers(make):
    d = make("t STRING", ("a  b\n",), ("  ",), (None,))
    assert [r[0] for r in d.select(canon.normal_text(F.col("t"))).collect()] == ["a b", None, None]
    stamps = make("t STRING", ("2036-01-01T00:00:00Z",), ("2036-01-01T00:00:00",), ("nonsense Z",))
    assert [r[0] is not None for r in stamps.select(canon.iso_timestamp(F.col("t"))).collect()] == [True, False, False]
    urls = make("t STRING", ("https://User@Host.example:8443/x?y",), ("none",))
    assert [r[0] for r in urls.select(canon.url_host(F.col("t"))).collect()] == ["host.example", None]
    names = make("t STRING", ("episode_a_b_r2_v1",), ("other",))
    path = canon.id_to_path(F.col("t"))
    assert rows(names.select(path, canon.path_to_id(path))) == [("episodes_v2/a_b_r2.v1.json", "episode_a_b_r2_v1"), (None, None)]
    halves = make("x DOUBLE", (0.5,), (1.5,), (2.5,))
    assert [r[0] for r in halves.select(canon.half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0]
    maps = make("m MAP<STRING,STRING>", ({"b": " x  y", "a": "1"},))
    assert maps.select(canon.qualifier_key(F.col("m")), canon.map_key(F.col("m"))).collect()[0] == ("a=1;b=x y", '{"a":"1","b":" x  y"}')


@pytest.mark.parametrize("keep", [True, False])
def test_shingles(make, keep):
    d = make("i INT, t STRING", (1, "A b c, d"), (2, "a b"), (3, "..."), (4, "a b c a b c"))
    got = rows(text.shingle_rows(d, "i", "t", 3, keep_short=keep))
    want = [(1, "a b c"), (1, "b c d"), (4, "a b c"), (4, "b c a"), (4, "c a b")] + ([(2, "a b")] if keep else [])
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("body", "finish", "reason"),
    [
        ('{"a": 1}', "stop", None), ('```json\n{"a": 1}\n```', "stop", None), ("```\n[1]\n```", "stop", None), ('{"a": 1} {"b": 2}', "stop", "invalid_json"),
        ('{"a": 1', "stop", "invalid_json"), ("", "stop", "invalid_json"), (None, "stop", "invalid_response"), ('{"a": 1}', "length", "response_token_limit"),
        ("```{}```", "stop", "invalid_json"), ("1] [2", "stop", "invalid_json"), ('1}{"b":2', "stop", "invalid_json"),
    ],
)
def test_parse_reply(make, body, finish, reason):
    d = make("b STRING, f STRING", (body, finish))
    assert d.select(text.parse_reply(F.col("b"), F.col("f")).alias("p")).select("p.reason").collect()[0][0] == reason
