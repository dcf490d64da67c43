"""The tuple protocol: only used fields are cleaned, odd records give no row."""

from pyspark.sql import functions as F

from corpusloom.operators import graph_build as gb


def test_only_used_fields_are_kept(spark, monkeypatch):
    text = '("entity"<|>a&amp;b<|> term <|> what\tit is <|>more<|>and more)##("relationship"<|>x<|>y<|>goes to<|>Near | next<|>0.5)##()##(<|>)##("entity"<|>q)<|COMPLETE|>'
    kept = []
    plain_cut = gb.cut
    monkeypatch.setattr(gb, "cut", lambda df: kept.append(plain_cut(df)) or kept[-1])
    nodes, edges = gb.parse_extraction_tuples(spark.createDataFrame([("c1", 7, text), ("c2", 8, None)], "chunk_id string, ord long, response string"))
    assert [(r["entity_name"], r["entity_type"], r["description"], r["source_id"]) for r in nodes.collect()] == [("A&B", "TERM", "whatit is", "c1")]
    assert [(r["src"], r["dst"], r["weight"], r["description"]) for r in edges.collect()] == [("X", "Y", 0.5, "goes to")]
    lists = [c for c, t in kept[0].dtypes if t == "array<string>"]
    assert kept[0].agg(F.max(F.greatest(*[F.size(c) for c in lists]))).first()[0] == 2
