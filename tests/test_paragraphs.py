"""Choice of paragraphs near a title, and that each is scored once."""

from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.operators import pages

QUERY = "harbour opens new ferry line"
FAR = "Quite unlike words about gardens, bread, music, and the price of zinc number {}."
NEAR = "The harbour opens new ferry line to the islands this spring, says report {}."


def test_near_paragraphs_else_the_best(spark):
    mixed = "\n".join([FAR.format(0), NEAR.format(1), FAR.format(2), NEAR.format(3), NEAR.format(4)])
    none = "\n".join(FAR.format(i) for i in range(4))
    df = spark.createDataFrame([(1, mixed), (2, none), (3, ""), (4, None)], "doc_id bigint, text string")
    out = pages.relevant_paragraphs(df, "doc_id", tx.paragraphs(F.col("text")), F.lit(QUERY), t=0.2, most=2, fallback=3)
    got = {(r.doc_id, r.pos, r["rank"]) for r in out.collect()}
    scores = {r.pos: r.score for r in out.collect() if r.doc_id == 2}
    assert {g for g in got if g[0] != 2} == {(1, 1, 1), (1, 3, 2)}
    assert len(scores) == 3 and sorted(scores, key=lambda p: (-scores[p], p)) == [p for _, p, _ in sorted((g for g in got if g[0] == 2), key=lambda g: g[2])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan
