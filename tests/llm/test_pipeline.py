import corpus_pipeline as cp
from reviewlens.llm import common, part_enum, registry, secret_ledger

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages_take_effect(spark):
    docs = common.documents(spark, SF)
    columns, out = docs.columns, []
    for name, stage in cp.STAGES:
        docs = common.stage(stage(spark, docs, SF), "test")
        out.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns, name
    kept, single, clean, mixed, packed = out
    labels = common.labels(spark, SF)
    good = common.documents(spark, SF).join(labels.where("quality = 1"), "doc_id").where("size(split(text, '[ \\n]+')) >= 25")
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()
    # one of each group of near copies, and none of another group gone
    groups = part_enum.cluster(kept, cp.NEAR)
    assert single.count() == groups.select("component_id").distinct().count()
    assert part_enum.cluster(single, cp.NEAR).where("doc_id <> component_id").count() == 0
    assert clean.count() == single.count()
    assert secret_ledger.Ledger(spark, common.stage_path(spark, "again")).scan(clean).count() == 0
    assert mixed.select("doc_id").distinct().join(clean, "doc_id", "left_anti").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()


def test_empty_tables(spark):
    docs = common.documents(spark, SF).where("1 = 0")
    for _, stage in cp.STAGES:
        docs = common.stage(stage(spark, docs, SF), "test")
        assert docs.count() == 0
