from conftest import SMALL

from assaylens.plans.registry import Q


def test_brand_without_parts_is_missing(spark, tmp_path):
    """A panel brand that no part has is missing; one without line items is not."""
    for name in ("customer", "orders"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    part.where("p_brand <> 'Brand#2'").write.parquet(f"{tmp_path}/part.parquet")
    unsold = part.where("p_brand = 'Brand#3'").selectExpr("p_partkey AS l_partkey")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lines.join(unsold, "l_partkey", "left_anti").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.feature for r in Q["panel_missing"](spark, str(tmp_path)).collect()) == ["Brand#2", "Brand#98", "Brand#99"]
    assert sorted(r.feature for r in Q["panel_missing"](spark, SMALL).collect()) == ["Brand#98", "Brand#99"]
