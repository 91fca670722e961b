from pyspark.sql import types as T

from logloom.functions.predicates import Fields, Ref

SCHEMA = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType()), T.StructField("b", T.BooleanType()), T.StructField("a", T.ArrayType(T.StringType())), T.StructField("path", T.StringType())])


def holds(spark, row, make):
    df = spark.createDataFrame([row], SCHEMA)
    return df.select(make(Fields(df.schema)).alias("x")).first().x


FULL, NULL = ("7", 7, True, ["x", "yz"], "/p"), (None,) * 5


def test_null_is_false_but_for_negations(spark):
    for make in (lambda f: f.equal("s", "7"), lambda f: f.not_equal("s", "8"), lambda f: f.less("n", 9), lambda f: f.is_in("s", ["7"]), lambda f: f.contains("s", "7"), lambda f: f.matches("s", "7"), lambda f: f.truthy("b"), lambda f: f.present("s"), lambda f: f.equal("a", "x")):
        assert holds(spark, FULL, make) is True
        assert holds(spark, NULL, make) is False
    for make in (lambda f: f.not_in("s", ["8"]), lambda f: ~f.contains("s", "q"), lambda f: ~f.matches("a", "q")):
        assert holds(spark, FULL, make) is True
        assert holds(spark, NULL, make) is True


def test_coercion(spark):
    true = [
        lambda f: f.equal("s", 7), lambda f: f.equal("n", "7"), lambda f: f.equal("s", Ref("n")), lambda f: f.at_least("s", 7), lambda f: f.contains("a", "x yz"), lambda f: f.starts_with("b", "tr"),
        lambda f: f.is_in("a", ["yz", "q"]), lambda f: f.equal("filepath", "/p"), lambda f: f.ends_with("s", ["8", "7"]), lambda f: f.missing("no_such"),
    ]
    false = [lambda f: f.equal("b", "true"), lambda f: f.less("b", 5), lambda f: f.equal("n", "seven"), lambda f: f.greater("a", 0), lambda f: f.not_equal("no_such", 1), lambda f: f.truthy("no_such")]
    for make in true:
        assert holds(spark, FULL, make) is True
    for make in false:
        assert holds(spark, FULL, make) is False


def test_what_is_no_number_compares_false(spark):
    for text in ("1d", "nan", "", "1_000", "0x10"):
        row = (text, 1, True, [], "")
        assert holds(spark, row, lambda f: f.less("s", 1e9)) is False
        assert holds(spark, row, lambda f: f.at_least("s", -1e9)) is False
