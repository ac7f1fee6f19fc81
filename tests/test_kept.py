from codeloom.sources.kept import Kept


def test_built_once_for_a_state_of_the_sources(spark, tmp_path):
    source = tmp_path / "in"
    at = f"file://{source}"
    rows = lambda *r: spark.createDataFrame(r, "k string, n long")
    rows(("a", 1), ("b", 2), ("b", 3)).write.parquet(f"{at}/t.parquet")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{at}/t.parquet")

    def kept():
        return Kept(spark, at)

    for _ in range(3):
        t = kept().table("t", build, by="k")
        assert sorted((r["k"], r["n"]) for r in t.collect()) == [("a", 1), ("b", 2), ("b", 3)]
    assert len(built) == 1
    k = kept()
    assert sorted(r["n"] for r in k.lookup(k.table("t", build, by="k"), "k", ["b", "none"]).collect()) == [2, 3]
    assert k.lookup(t, "k", []).count() == 0 and k.prune() == 0
    # the sources change: built anew, and what was kept before can be dropped
    rows(("c", 9)).write.mode("append").parquet(f"{at}/t.parquet")
    assert kept().table("t", build, by="k").count() == 4 and len(built) == 2
    assert kept().prune() == 1 and kept().table("t", build, by="k").count() == 4 and len(built) == 2
