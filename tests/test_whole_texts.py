from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import text
from citelake.plans import texts


def test_long_texts_are_indexed_whole(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{k % 1700}" for k in range(2000))
    index = {}
    for k, w in enumerate(long.split(" ")):
        index.setdefault(w, []).append(k)
    rows = spark.createDataFrame([(index,)], "i map<string, array<int>>")
    whole, first = rows.select(text.text_of_inverted_index(F.col("i")), text.text_of_inverted_index(F.col("i"), 1500)).first()
    assert whole == long and first == long[:1500]
    spark.createDataFrame([(1, long), (2, "short one")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all(r["same"] for r in texts.inverted_index_rebuild(spark, str(tmp_path)).collect())
    rebuild = text.text_of_inverted_index
    # a rebuilt text that lacks words after the first 1,500 is told from the document
    cut = lambda i: F.array_join(F.slice(F.split(rebuild(i), " "), 1, 1500), " ")
    monkeypatch.setattr(text, "text_of_inverted_index", cut)
    assert {r["doc_id"]: r["same"] for r in texts.inverted_index_rebuild(spark, str(tmp_path)).collect()} == {1: False, 2: True}
