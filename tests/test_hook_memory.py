"""The stand-in for a model takes Arrow arrays, and null texts have no answer."""

from newsmill.plans import catalog


def test_stand_in_takes_arrow_arrays(spark, tmp_path):
    texts = ["abc", "abcd", "abcde", "\u00e9\u4e2d\U0001F680", "", None]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: (r.action, r.severity, r.confidence, r.decided_by) for r in catalog.QUERIES["j2_model_decisions"](spark, str(tmp_path)).collect()}
    model, rules = ("deliver", "high", 1.0, "model"), ("digest", "low", 0.5, "rules")
    assert got == {0: model, 1: rules, 2: rules, 3: model, 4: model, 5: rules}
