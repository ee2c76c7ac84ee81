"""Inputs whose own columns have the names that operators use for themselves."""

from collections import Counter

from graphloom.llm.jaccard import keep_one_similar
from graphloom.llm.linedup import remove_boilerplate
from graphloom.llm.mixing import mix

OWN = "stay__id string, stay__of int, join__salt string, line__of string, line__id int, line__gone string"


def frame(spark):
    rows = [(k, f"shared line\nown {k % 4} words of this text", "en", f"s{k}", 1, "i", k, "j", "o", 7, "g") for k in range(12)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {OWN}")


def test_columns_pass_through(spark):
    df = frame(spark)
    names = [c.split(" ")[0] for c in OWN.split(", ")]
    before = {r["doc_id"]: tuple(r[c] for c in names) for r in df.collect()}
    for out, n in ((keep_one_similar(df), 4), (remove_boilerplate(df, min_sites=5), 12), (mix(df), 12)):
        rows = out.collect()
        assert len(rows) == n and all(tuple(r[c] for c in names) == before[r["doc_id"]] for r in rows)
        assert Counter(out.columns).most_common(1)[0][1] == 1
    assert sorted(r["doc_id"] for r in keep_one_similar(df).collect()) == [0, 1, 2, 3]
