import pytest
from pyspark.sql import types as T

from arbora.sources.ddl import DdlError, parse


def test_columns_and_types():
    (t,) = parse("CREATE TABLE t (x INT, y VARCHAR, z BIGINT, p DECIMAL, q DECIMAL(10, 2), w TIMESTAMP, d DATE, v VARCHAR(20))")
    assert t.name == "t" and t.primary_key == () and t.properties == {}
    assert [f.dataType for f in t.schema] == [T.IntegerType(), T.StringType(), T.LongType(), T.DoubleType(), T.DecimalType(10, 2), T.TimestampNTZType(), T.DateType(), T.StringType()]


def test_primary_keys():
    assert parse("CREATE TABLE t (x INT, y INT, PRIMARY KEY (x))")[0].primary_key == ("x",)
    assert parse("CREATE TABLE t (x INT, y INT, CONSTRAINT k PRIMARY KEY (x, y))")[0].primary_key == ("x", "y")
    with pytest.raises(DdlError):
        parse("CREATE TABLE t (x INT, PRIMARY KEY (nope))")
    with pytest.raises(DdlError):
        parse("CREATE TABLE t (x INT, PRIMARY KEY (x), PRIMARY KEY (x))")


def test_properties_and_several_tables():
    a, b = parse("CREATE TABLE a (x INT) WITH ('path' = 'd/a.dat', 'cardinality' = '12'); CREATE TABLE IF NOT EXISTS `b c` (y INT);")
    assert a.path == "d/a.dat" and a.cardinality == 12
    assert b.name == "b c" and b.if_not_exists and b.cardinality == 0


@pytest.mark.parametrize("bad", ["CREATE VIEW v", "CREATE TABLE t (x NONSENSE)", "CREATE TABLE t (x INT) WITH (a = 'b')", "CREATE TABLE t (x INT", "CREATE TABLE t (x INT, X INT)", "CREATE TABLE t (x INT) #"])
def test_errors(bad):
    with pytest.raises(DdlError):
        parse(bad)
