"""Keywords of every script against plain Python."""

from collections import Counter

import __spark_entry__


def test_keywords_of_every_script(spark, tmp_path):
    def words(text):
        return {w.lower() for w in "".join(c if c.isalnum() else " " for c in text or "").split()}

    texts = ["L'\u00e9t\u00e9 \u00e0 Gen\u00e8ve, \u00c9T\u00c9!", "Stra\u00dfe \u4f60\u597d \u043c\u0438\u0440 x1", None, "...", "plain words"]
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = list(enumerate(texts + given))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    queries = __spark_entry__.queries()
    totals, windows = Counter(), Counter()
    for k, t in rows:
        totals.update(words(t))
        windows.update((k // 10, w) for w in words(t))
    found = queries["keyword_totals"](spark, str(tmp_path)).collect()
    assert {r.keyword: r.keyword_count for r in found if r.keyword is not None} == totals
    assert totals["\u00e9t\u00e9"] == 1 and totals["\u043c\u0438\u0440"] == 1 and None in {r.keyword for r in found}
    found = queries["keyword_window"](spark, str(tmp_path)).where("keyword is not null").collect()
    assert Counter((r.keyword, r.keyword_count) for r in found) == Counter((w, n) for (_, w), n in windows.items())
