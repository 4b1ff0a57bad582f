"""Unicode forms of redirect paths."""

from fleetlens.operators import redirects as R


def test_composed_columns(spark):
    rows = [(1, "cafe\u0301", None), (2, None, "e\u0301"), (3, "plain", "caf\u00e9"), (3, "plain", "caf\u00e9"), (4, "", "A\u030a")]
    got = R.composed(spark.createDataFrame(rows, "id int, a string, b string"), ["a", "b"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, "caf\u00e9", None), (2, None, "\u00e9"), (3, "plain", "caf\u00e9"), (3, "plain", "caf\u00e9"), (4, "", "\u00c5")], key=repr)
    assert R.composed(spark.createDataFrame([], "a string"), ["a"]).collect() == []


def test_match_across_forms(spark):
    old = spark.createDataFrame([("/Cafe\u0301/",), ("/caf%C3%A9/x%3Fy",), ("/cafe",)], "url string")
    new = spark.createDataFrame([("https://n.test/caf\u00e9", " ", " "), ("/cafe%CC%81/x%3Fy/", " ", " ")], "url string, slug string, title string")
    got = {r.source: (r.target, r.strategy) for r in R.match(old, new).collect()}
    assert got["/Cafe\u0301/"] == ("https://n.test/caf\u00e9", "exact_path")
    assert got["/caf%C3%A9/x%3Fy"] == ("/cafe%CC%81/x%3Fy/", "exact_path")
    assert got["/cafe"][1] != "exact_path"
