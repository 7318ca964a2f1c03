"""Rows of an uploaded list: cells, the site's own object, or the reason why there is nothing."""

from radiolake.operators import params as P

OBJECT = "object string, site_id string, sector_num int, site_level boolean"


def plan(spark, kpi, per_sector):
    objects = spark.createDataFrame(
        [("c1", "A", 1, False), ("c2", "A", 2, False), ("c2", "A", 2, False), ("A", "A", 0, True),
         ("B", "B", 0, True), ("d1", "D", 1, None)], OBJECT)
    long = spark.createDataFrame(
        [("c1", "prb", 1.0), ("c1", "prb", 2.0), ("c2", "prb", None), ("A", "flow", 3.0), ("B", "flow", 4.0),
         ("B", "prb", 5.0)], "object string, kpi string, value double")
    wanted = spark.createDataFrame(
        [("A", 1), ("A", 1), ("A", 2), ("A", 3), ("A", None), ("B", 1), ("C", 1), ("D", 1), (None, 1)],
        "site_id string, sector_num int")
    return {(r["site_id"], r["sector_num"]): (r["cells"], r["site_only"], r["missing"])
            for r in P.plan_for_list(wanted, objects, long, kpi, per_sector).collect()}


def test_by_sector(spark):
    assert plan(spark, "prb", True) == {
        ("A", 1): (["c1"], False, ""), ("A", 2): ([], False, P.NO_DATA), ("A", 3): ([], False, P.NO_SECTOR),
        ("A", None): ([], False, P.NO_NUMBER), ("B", 1): ([], False, P.NOT_SPLIT), ("C", 1): ([], False, P.NO_SITE),
        ("D", 1): ([], False, P.NO_DATA)}


def test_by_site(spark):
    assert plan(spark, "prb", False) == {
        ("A", None): (["c1"], False, ""), ("B", None): (["B"], True, ""), ("C", None): ([], False, P.NO_SITE),
        ("D", None): ([], False, P.NO_DATA)}
    assert plan(spark, "flow", False)[("A", None)] == (["A"], True, "")
    assert plan(spark, "flow", True)[("A", 1)] == ([], False, P.NO_DATA)
    assert plan(spark, "flow", True)[("B", 1)] == ([], False, P.NOT_SPLIT)
