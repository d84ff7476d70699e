"""A sample of the queries against DuckDB; the driver runs them all."""

import pytest

import __spark_entry__ as entry

SAMPLE = """agg_top_queries agg_unique ins_engagement ins_follow_ups trend_zero_ma call_incidents log_bursts kw_strict kw_any_terms kw_collapsed search_full lex_brand_ambiguous lex_synonym_groups
hyb_tail_cap vec_topk vec_blocks q_spell etl_server_rows txt_normalize txt_spelling eval_compare q_entity_status life_diff eval_golden_finish""".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(str([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    expected = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
