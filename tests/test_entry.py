import os

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    rows = e.entry(spark).collect()
    assert rows and all(r["n_lines"] > 0 for r in rows)


def rounded(rows):
    return sorted((tuple("~" if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(k for k in e.oracle_sql() if not k.startswith("op")))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = con.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rounded(got.select(*columns).collect()) == rounded(want.select(", ".join(columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["edit_clone", "edit_push_text", "following_elements"])
def test_node_tables_are_not_broadcast(spark, name):
    """By the files' sizes every table of sf0.001 would be; behind a parse those sizes tell nothing."""
    plan = e.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_documents_and_nodes_of_rules_have_no_size(spark):
    """validate_all joins them with each other; only declarations may be broadcast."""
    from sylvara.plans.queries import _order_attributes

    t = _order_attributes(spark, DATA)
    assert t.few_types and all(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bitLength() > 50 for x in (t.nodes, t.docs))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_rules_of_declarations_are_no_part_of_the_plan_of_nodes(spark):
    """validate_all's plan would else be that of all rules, which takes the driver's memory; few types need no exchange."""
    from sylvara.operators import dtd
    from sylvara.plans.queries import _order_attributes

    plan = e.queries()["validate_all"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "required" in plan and not any(rule in plan for rule in ("notation_unique", "mixed_unique", "deterministic", "choices_unique"))
    assert "Exchange" not in dtd.first_attdefs(_order_attributes(spark, DATA).attdef)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["parameter_entities", "expansion_guards"])
def test_work_in_python_is_dealt_out(spark, name):
    """One file of one split, but as many tasks as the session deals out."""
    assert e.queries()[name](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["to_xml_laid_out"])
def test_layout_needs_no_join(spark, name):
    assert "Join" not in e.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_many_document_types_are_not_broadcast(spark, monkeypatch):
    """to_xml_with_dtd has a document type for each document."""
    from sylvara.sources import xml

    monkeypatch.setattr(xml, "TYPE_BYTES", 1000)
    plan = e.queries()["to_xml_with_dtd"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["dangling_idref", "required_missing", "attribute_edits", "idrefs_all_or_nothing"])
def test_nodes_are_not_dealt_by_document_type(spark, name):
    """All documents have one type; whatever the threshold, its few declarations are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = e.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [dtd_id" not in plan and "BroadcastHashJoin [dtd_id" in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_elements_are_not_dealt_by_name_for_defaults(spark):
    """attr_defaults_relational has one document type of one element, so a shuffled join would put all nodes into one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = e.queries()["attr_defaults_relational"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [name" not in plan and "BroadcastHashJoin [name" in plan
