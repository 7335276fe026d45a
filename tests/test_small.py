"""Functions that no query shows."""

import base64

from pyspark.sql import functions as F

from tessella.operators import answers, layout, trust
from tessella.sources import corpus


def test_ledger_reads_by_offset_then_place(spark):
    rows = [("c", None, 0), ("b", 5, 1), ("a", 5, 0), ("d", 2, 9)]
    assert [r.id for r in answers.ledger(spark.createDataFrame(rows, "id string, char_start long, seq int")).collect()] == ["d", "a", "b", "c"]


def test_report_is_saved(spark, tmp_path):
    corpus.save_report(spark.createDataFrame([("dangling", 0, "PASS")], "check string, found long, verdict string"), f"{tmp_path}/report")
    assert any(tmp_path.iterdir())


def test_did_document_has_the_key():
    key = bytes(range(32))
    doc = trust.did_document("example.org", key)
    (method,) = doc["verificationMethod"]
    assert doc["id"] == "did:web:example.org" and method["controller"] == doc["id"] and doc["assertionMethod"] == [method["id"]]
    assert base64.urlsafe_b64decode(method["publicKeyJwk"]["x"] + "=") == key


def test_tampering_changes_one_character(spark):
    rows = spark.createDataFrame([("12.8 percent", "0f"), ("abc", "00"), ("…", ""), ("9", "zz")], "t string, s string")
    got = [tuple(r) for r in rows.select(trust.tampered(F.col("t")), trust.tampered_signature(F.col("s"))).collect()]
    assert got == [("22.8 percent", "00"), ("Abc", "01"), ("….", "0"), ("0", "z0")]


def test_alignment_of_few_or_equal_nodes(spark):
    ddl = "id string, x double, y double, r double"
    old = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 4.0, 0.0, 1.0), ("c", 0.0, 3.0, 1.0)], ddl)
    weights = old.select("id", F.lit(1.0).alias("w"))
    same = layout.alignment(old, old, weights).first()
    assert (round(same.rotation, 9), round(same.scale, 9), same.mirror, round(same.mean_drift, 9)) == (0, 1, False, 0)
    turned = layout.alignment(old, old.select("id", (-F.col("y")).alias("x"), F.col("x").alias("y")), weights).first()
    assert round(turned.rotation, 6) == -1.570796 and not turned.mirror
    one = layout.alignment(old, old.where("id = 'a'"), weights).first()
    assert tuple(one) == (0.0, 1.0, 0.0, 0.0, False, 0.0, 0.0)
