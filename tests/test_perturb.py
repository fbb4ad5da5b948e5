"""Laws of the seeded changes, the generators and the comparisons."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence import tag
from whence.functions import mutations as M
from whence.operators import codependence as C
from whence.operators import compare as D
from whence.operators import generate as G
from whence.operators import perturb as P
from whence.operators.frame import Source
from whence.sources.schemas import schema


@pytest.fixture
def people(rows):
    data = [(i, f"name {i}", str(i * 1.5), i % 7) for i in range(300)]
    return Source("people", rows(data, "id long, name string, amount string, k long"), ("id",))


@pytest.mark.parametrize("change", [P.scramble_text(), P.offset_numbers(), P.mixed(3), P.blanks(0.4)])
def test_changes_do_not_depend_on_partitions(people, change):
    cells = lambda n: as_set(P.perturb(P.with_rid(people).repartition(n), ["name", "amount"], change))
    assert cells(1) == cells(7)


def test_scrambling_keeps_length_and_never_adds_a_comma(people):
    out = P.perturb(P.with_rid(people), ["name"], P.scramble_text(0.5)).collect()
    assert all(len(r["before"]) == len(r["after"]) and "," not in r["after"] for r in out)
    changed = sum(a != b for r in out for a, b in zip(r["before"], r["after"]))
    total = sum(len(r["before"]) for r in out)
    assert 0.4 < changed / total < 0.6


def test_seeds_differ(people):
    a = as_set(P.perturb(P.with_rid(people), ["name"], P.scramble_text(seed=1)))
    b = as_set(P.perturb(P.with_rid(people), ["name"], P.scramble_text(seed=2)))
    assert a != b


@pytest.mark.parametrize(
    "text, want", [("12", "12.0"), ("12.7", "12"), ("x", "x"), ("", ""), ("1.2.3", "1.2.3"), ("-4", "-4")]
)
def test_number_format(spark, text, want):
    assert spark.range(1).select(M.change_format(F.lit(text))).first()[0] == want


@pytest.mark.parametrize("text, want", [("5", "12"), ("1.5", "8.5"), ("abc", "abc"), ("-3", "4"), ("0.10", "7.1")])
def test_offset(spark, text, want):
    assert spark.range(1).select(M.offset_number(F.lit(text), F.lit(7).cast("bigint"))).first()[0] == want


def test_delimiters_and_dropped_fields(people):
    df = P.with_rid(people).select("rid", F.lit("a,b,c,d").alias("line"))
    out = df.select(
        M.break_delimiter(F.col("line"), M.draw("rid", "x")).alias("broken"), M.drop_fields(F.col("line"), F.col("rid"), "d").alias("dropped")
    ).distinct()
    broken = {r["broken"] for r in out.collect()}
    assert broken == {"a~b,c,d", "a,b~c,d", "a,b,c~d"}
    assert {len(r["dropped"].split(",")) for r in out.collect()} == {2, 3}
    assert people.df.select(M.break_delimiter(F.lit("alone"), F.lit(5))).first()[0] == "alone"


def test_declared_ranges_hold(rows):
    df = rows([(i, 50) for i in range(100)], "id long, age int")
    out = P.perturb(P.with_rid(Source("p", df, ("id",))), ["age"], P.by_schema({"age": ("numerical", (0, 9))}))
    assert {int(r["after"]) for r in out.collect()} <= set(range(10))


def test_categories_from_schema_and_from_data(rows):
    declared = P.declared_categories(schema("trips"))
    assert declared["mode"] == ("other", None) and declared["time"] == ("numerical", None)
    df = rows([("1", "a", None), ("2.5", "3", None)], "n string, t string, e string")
    assert as_set(P.infer_category(df)) == {("n", "numerical"), ("t", "other"), ("e", "other")}


def test_consistent_keys_keep_the_join(rows):
    people = tag(rows([(i, i % 50) for i in range(200)], "id long, k long"), "a", ["id"])
    other = tag(rows([(i, i % 80) for i in range(200)], "oid long, j long"), "b", ["oid"])
    relation = C.join_groups(people, other, ("k", "j"), "k", None)
    a = P.perturb_consistently(people.sources["a"], relation, "k")
    b = P.perturb_consistently(other.sources["b"], relation, "j")
    before = people.df.join(other.df, F.col("k") == F.col("j")).count()
    assert a.join(b, F.col("new_k") == F.col("new_j")).count() == before
    # Different old keys stay different; cells outside the groups keep their text.
    assert a.select("k").distinct().count() == a.select("new_k").distinct().count()
    assert b.where("j >= 50 AND new_j <> cast(j AS string)").count() == 0
    assert b.where("j < 50 AND new_j = cast(j AS string)").count() < 20


def test_copies_of_a_group_join_among_themselves(rows):
    a = tag(rows([(i, i % 5) for i in range(20)], "id long, k long"), "a", ["id"])
    b = tag(rows([(i, i % 10) for i in range(20)], "oid long, j long"), "b", ["oid"])
    relation = C.join_groups(a, b, ("k", "j"), "k", None)
    group = C.pick_group(relation)
    out = P.duplicate_group(a.sources["a"], group, 3)
    picked = group.where("ds = 'a'").count()
    assert out.count() == 20 + 3 * picked
    assert out.select("rid").distinct().count() == out.count()
    assert P.extend_groups(relation, group, 3).count() == relation.count() + 3 * group.count()


def test_unguided_pass_replaces_the_guided_one(rows):
    a = tag(rows([(i, i % 5, "x") for i in range(20)], "id long, k long, t string"), "a", ["id"])
    b = tag(rows([(i, i % 5, "y") for i in range(20)], "oid long, j long, u string"), "b", ["oid"])
    relation = C.join_groups(a, b, ("k", "j"), "k", None)
    spec = {"a": (a.sources["a"], "k", ["t"])}
    guided = P.perturb_together(spec, relation, C.pick_group(relation), 1, unguided_share=0.0)["a"]
    wild = P.perturb_together(spec, relation, C.pick_group(relation), 1, unguided_share=1.0)["a"]
    assert guided.where("col = 'k'").select("before", "after").distinct().count() == 5
    assert as_set(guided) != as_set(wild)


def test_random_copies(people):
    out = P.duplicate_rows(P.with_rid(people).select("rid"), 0.5, 3)
    assert out.where("copy_no = 0").count() == 300
    assert 300 < out.count() < 900


@pytest.mark.parametrize("name", sorted(G.GENERATORS))
def test_generators_are_repeatable(spark, name):
    few, many = (sorted(map(tuple, G.generate(spark, name, 200, p, 4).collect())) for p in (1, 6))
    assert few == many and len(few) == 200


def test_trips_last_at_least_one(spark):
    assert G.generate(spark, "trips", 500).where("time < 1").count() == 0


def test_diff_counts_copies(rows):
    a = rows([(1,), (1,), (2,), (None,)], "x int")
    b = rows([(1,), (3,), (None,)], "x int")
    assert as_set(D.diff_outputs(a, b)) == {(1, "a", 1), (2, "a", 1), (3, "b", 1)}
    assert D.same_output(a, a) and not D.same_output(a, b)
    with pytest.raises(ValueError):
        D.diff_outputs(a, b.withColumnRenamed("x", "y"))


def test_fault_rules_split_rows(rows):
    df = rows([(1, 0.0), (2, 5.0), (3, None)], "id int, d double")
    rules = {"zero": F.col("d") == 0, "large": F.col("d") > 4}
    good, bad = D.split_faulty(df, rules)
    assert as_set(good.select("id")) == {(3,)}
    assert as_set(bad.select("id", "rules").withColumn("rules", F.array_join("rules", ","))) == {(1, "zero"), (2, "large")}


def test_failure_summary_counts_what_was_known(rows):
    df = rows([("a", 1), ("a", 2), ("b", 2), ("c", 5)], "rule string, batch int")
    out = {r["rule"]: (r["n"], r["first_batch"], r["known"]) for r in D.failure_summary(df, ["rule"], "batch").collect()}
    assert out == {"a": (2, 1, 1), "b": (1, 2, 2), "c": (1, 5, 3)}


def test_coverage_of_nothing(rows):
    df = rows([], "x int")
    assert tuple(D.coverage(df, {"p": F.col("x") > 0}).first()) == (0, 0, 1)
