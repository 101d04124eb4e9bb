"""What SQL gives on large tables and small ones do not show: rounding of large numbers, ties, growth with copies."""


from lakefold.operators import entity
from lakefold.plans import labels
from tests.compare import rows


def test_parsed_fields_of_large_keys_round_as_sql(spark, tmp_path):
    keys = (545684, 662898, 780112, 897326, 915547)
    part = spark.createDataFrame([(k, "hot ring", "Brand#21", "LARGE", k % 50 + 1, 900.0 + k % 1000 / 10) for k in keys], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    import duckdb

    part.coalesce(1).write.parquet(str(tmp_path / "part"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part/*.parquet')")
    want = c.execute(labels.BOOK.oracles["parsed_fields"]).fetchdf()

    class Given:
        pass

    given = Given()
    given.part = part
    assert rows(labels.parsed_fields(given).toPandas()) == rows(want)


def test_merged_fields_of_equal_lookups_take_the_smallest_value(spark):
    given = [(1, 7, "f", v, 0.5, "s") for v in ("9", "10", "8")]
    schema = "record_id int, lookup int, field string, value string, confidence double, source string"
    for order in (given, given[::-1], given[1:] + given[:1]):
        rows_ = entity.merge_fields(spark.createDataFrame(order, schema).coalesce(1)).collect()
        assert [r.value for r in rows_] == ["10"]
