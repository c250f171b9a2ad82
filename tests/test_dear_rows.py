"""Costly work on rows of a small file: all cores take part, and only keys are dealt."""

import random
import re

import pytest
from pyspark.sql import functions as F

from indicata import lists
from indicata.functions import brands
from indicata.functions.text import holds_any
from indicata.operators import mail
from indicata.plans import queries as core

SF = "/root/testdata/sf0.001"


def test_messages_are_not_dealt(spark):
    """Keys are dealt; headers stay on their order's row."""
    plan = core._mails(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan or "Repartition" in plan
    assert core._mails(spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


@pytest.mark.parametrize("name", ["mail_verdicts", "mail_hops", "relay_hops", "mail_flow", "auth_records", "checks"])
def test_all_cores_take_part(spark, name):
    assert core.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_records_need_no_origin(spark):
    """What the records of a message don't need is not computed for them."""
    plan = core.QUERIES["auth_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "localhost" not in plan


def test_words_are_found_anywhere():
    """Words are looked for from their endings, and found exactly where a text holds them."""
    words = [p for _, _, parts in mail.GATEWAYS for p in parts] + ["click.", "a.b.c", "b.c"]
    rng = random.Random(3)
    for word in words:
        assert re.search(holds_any([word]), f"x{word}y") and not re.search(holds_any([word]), word[1:]) and not re.search(holds_any([word]), word[:-1])
    for _ in range(3000):
        text = "".join(rng.choice(["a", ".", "b.c", "com", ".com", rng.choice(words)[rng.randint(0, 3) :]]) for _ in range(rng.randint(0, 6)))
        some = rng.sample(words, rng.randint(1, 8))
        assert bool(re.search(holds_any(some), text)) == any(w in text for w in some), (some, text)


@pytest.mark.parametrize("name, step", [("lookup_feeds", "lookup"), ("enriched_hosts", "enrich")])
def test_an_indicator_is_looked_up_once(spark, tmp_path, monkeypatch, name, step):
    """However many orders ask for it: 3000 orders of three customers have few indicators."""
    spark.createDataFrame([(k,) for k in range(3)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id as o_orderkey", "id div 10 % 3 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    looked_up, real = [], getattr(core, step)
    monkeypatch.setattr(core, step, lambda rows, *args, **kwargs: looked_up.append(rows.count()) or real(rows, *args, **kwargs))
    assert core.QUERIES[name](spark, str(tmp_path)).count() == 3000
    assert len(looked_up) == 1 and looked_up[0] <= 30


def test_near_tokens_are_compared(spark):
    """The cheap test before the edit distance lets every token pass that is one or two edits from a brand."""
    rng, rows = random.Random(5), set()
    for brand in lists.BRANDS:
        for _ in range(60):
            token = brand
            for _ in range(rng.randint(1, 2)):
                k, sign = rng.randint(0, len(token)), rng.choice("abeimnost019")
                token = rng.choice([token[:k] + sign + token[k:], token[:k] + token[k + 1 :], token[:k] + sign + token[k + 1 :]])
            rows.add((token, brand))
    near = spark.createDataFrame(sorted(rows), "t string, b string").where("t <> b and length(t) >= 5 and length(b) >= 4 and levenshtein(t, b) / greatest(length(t), length(b)) < 0.25")
    assert near.count() > 2000 and near.where(~brands._may_be_near(F.col("t"), lists.BRANDS)).count() == 0
    far = spark.createDataFrame([("u10110",), ("err1011",), ("bad10110",), ("zzzzzzzzz",)], "t string")
    assert far.where(brands._may_be_near(F.col("t"), lists.BRANDS)).count() == 0
