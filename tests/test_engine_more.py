"""Sessions, chains, events, typing and names of the record engine; random operations against a list model."""

import random
import warnings

import pytest

from recordloom.errors import MissingDataset
from recordloom.functions.values import POS
from recordloom.operators import text as X
from recordloom.plans.engines import Facade, FilterEngine, SearchEngine, SortEngine
from recordloom.sources import store as stores
from recordloom.sources.store import Store, with_positions

USERS = [(1, "Vasyl", "Kyiv", 25), (2, "Vlad", "Lviv", 30), (3, "Ivan", "Kyiv", 30), (4, "Oleh", "Odesa", 20), (5, "Viktor", "Lviv", 35)]
SCHEMA = "id int, name string, city string, age int"


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, SCHEMA)


def ids(result):
    return [r.id for r in result.collect()]


def test_own_columns_keep_their_names(spark):
    rows = [(1, 7, "a", "x"), (2, 5, "b", "y")]
    data = spark.createDataFrame(rows, "id int, _pos int, _id string, __id string")
    f = FilterEngine(data, keys=["id"])
    assert f.filter([{"field": "_pos", "values": [5]}]).frame().columns == data.columns
    assert ids(f.filter([{"field": "_pos", "values": [5]}])) == [2] and ids(f.filter([{"field": "__id", "exclude": ["y"]}])) == [1]
    assert ids(SearchEngine(data, silent=True, keys=["id"]).search("b")) == [2]
    assert [r._pos for r in f.store.rows().collect()] == [7, 5]


def test_float_and_binary_literals(spark):
    data = spark.createDataFrame([(1, 0.1, b"ab"), (2, 2.5, b"c"), (3, None, None)], "id int, x float, y binary")
    f = FilterEngine(data, keys=["id"])
    assert ids(f.filter([{"field": "x", "values": [0.1, 1e300]}])) == [1] and ids(f.filter([{"field": "x", "exclude": [2.5]}])) == [1, 3]
    assert ids(f.filter([{"field": "y", "values": [b"ab", bytearray(b"zz")]}])) == [1] and ids(f.filter([{"field": "y", "exclude": [b"c"]}])) == [1, 3]


def test_empty_dataset_is_an_error(users):
    for engine, call in ((SortEngine, lambda e: e.sort([{"field": "age"}])), (FilterEngine, lambda e: e.filter([{"field": "age", "values": [1]}]))):
        with pytest.raises(MissingDataset):
            call(engine())
        with pytest.raises(MissingDataset):
            call(engine(users.limit(0)))
        held = engine(users, keys=["id"])
        held.clear_indexes().clear_data()
        with pytest.raises(MissingDataset):
            call(held)
    assert SortEngine(users, keys=["id"]).sort(users.limit(0), [{"field": "age"}]).collect() == []


def test_results_chain_to_their_owner(users):
    f = Facade(users, keys=["id"], search={"fields": ["name"], "silent": True})
    found = f.search("v")
    assert found.add([{"id": 6, "name": "Vira", "city": "Kyiv", "age": 1}]) is f and f.search("vira").origin().count() == 6
    f.filter([{"field": "id", "values": [6]}]).update("id", {"id": 6, "name": "Nina", "city": "Lviv", "age": 2})
    assert ids(f.search("nina").sort([{"field": "age"}])) == [6]
    f.sort([{"field": "age"}]).delete("id", [6, 2])
    assert [r.id for r in f.origin().collect()] == [1, 5, 3, 4]
    kept = f.search("v").clear_indexes("search")
    assert set(ids(kept)) == {1, 5, 3}
    assert kept.clear_data("search") is kept and f.origin().count() == 0
    assert kept.data(users, ["id"]) is f and f.origin().count() == 5
    s = FilterEngine(users, keys=["id"])
    assert s.filter([{"field": "id", "values": [1]}]).delete("id", 1) is s and s.origin().count() == 4


def test_events_say_what_moved(users, spark):
    store, seen = Store(users, ["id"]), []
    store.subscribe(seen.append)
    store.add([{"id": 6, "name": "F", "city": "X", "age": 1}])
    store.update("id", {"id": 6, "name": "G", "city": "X", "age": 1})
    store.delete("id", 2)
    store.delete("id", [1, 5])
    store.clear()
    store.replace(users, ["id"])
    assert [e["type"] for e in seen] == ["add", "update", "remove", "remove_many", "clear_data", "data"]
    assert seen[0]["start_index"] == 5 and [r.id for r in seen[0]["items"].collect()] == [6]
    assert (seen[1]["field"], seen[1]["index"], seen[1]["previous_item"]["name"], seen[1]["next_item"]["name"]) == ("id", 5, "F", "G")
    one = seen[2]
    assert (one["value"], one["removed_item"]["id"], one["removed_index"], one["moved_item"]["id"], one["moved_from_index"]) == (2, 2, 1, 6, 5)
    # rows are 1, 6, 3, 4, 5: the last takes the place of 1, and is deleted there itself
    assert [(e["value"], e["removed_index"], e["moved_item"] and e["moved_item"]["id"], e["moved_from_index"]) for e in seen[3]["entries"]] == [(1, 0, 5, 4), (5, 0, 4, 3)]
    assert seen[5]["data"].count() == 5


def test_many_keys_are_joined(spark, monkeypatch):
    rows = [(k, f"n{k}") for k in range(500)]
    data = spark.createDataFrame(rows, "id long, name string").repartition(5)
    few = [k for k in range(0, 500, 2)]
    plans = []
    for literals in (stores.LITERALS, 1000):
        monkeypatch.setattr(stores, "LITERALS", literals)
        store = Store(data, ["id"])
        store.delete("id", few)
        plans.append([r.id for r in store.rows().collect()])
        assert store.count == 250
    assert plans[0] == plans[1] and sorted(plans[0]) == list(range(1, 500, 2))


def test_positions_by_order(spark):
    data = spark.createDataFrame([(k, (k * 37) % 101) for k in range(101)], "id int, x int").repartition(7)
    placed, n = with_positions(data, order=[data.x.desc()])
    assert n == 101 and [r.x for r in placed.orderBy(POS).collect()] == list(range(100, -1, -1))
    assert with_positions(data.limit(0))[0].count() == 0


def test_grams_of_two_and_three(spark):
    data = spark.createDataFrame([(1, "Red"), (2, "gReen"), (3, "x"), (4, None), (5, "er")], "id int, name string")
    plain, held = (SearchEngine(data, fields=["name"], keys=["id"], silent=True, gram_index=g) for g in (False, True))
    for q in ("re", "red", "ree", "reen", "r", "zz", "e", "RED ", ""):
        assert ids(plain.search("name", q)) == ids(held.search("name", q))
    held.add([{"id": 6, "name": "Fred"}])
    assert ids(held.search("name", "red")) == [1, 6] and ids(held.clear_indexes().search("name", "re")) == [1, 2, 6]
    with pytest.raises(ValueError):
        X.gram_candidates(X.grams(held.store.need(), "name"), "r")


def test_narrowing_is_by_rows_not_by_field(spark):
    rows = [(1, "small", "big"), (2, "tall", "small"), (3, "smart", "small")]
    s = SearchEngine(spark.createDataFrame(rows, "id int, a string, b string"), fields=["a", "b"], keys=["id"], filter_by_previous_result=True, silent=True)
    assert ids(s.search("a", "sma")) == [1, 3]
    assert ids(s.search("b", "small")) == [3]
    assert ids(s.reset_search_state().search("b", "small")) == [2, 3]
    assert ids(s.search("a", "t")) == [2, 3]  # no extension of the query before
    s.search("a", "sm", limit=1)  # a window leaves no state
    assert ids(s.search("a", "tall")) == [2]
    s.add([{"id": 4, "a": "tallest", "b": ""}])
    assert ids(s.search("a", "talle")) == [4]


def test_search_statistics_and_warnings(users):
    s = SearchEngine(users, fields=["name"], keys=["id"])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        s.search("name", "va"), s.search("name", "v"), s.search("v"), s.search("va")
        free = SearchEngine(users, keys=["id"])
        free.search("ky"), free.search("ky")
    assert s.stats()["total"] == 4 and s.stats()["indexed"] == 2 and s.stats()["rate"] == 0.5
    assert sum("scans all rows" in str(w.message) for w in seen) == 1 and len(free.warnings()) == 1 and not s.warnings()
    s.reset_stats()
    assert s.stats()["total"] == 0
    near = SearchEngine(users, keys=["id"], filter_by_previous_result=True)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        near.search("ky"), near.search("kyi")
    assert len(near.warnings()) == 1 and near.stats()["fallback"] == 2


def test_nested_fields_in_all_fields(spark):
    data = spark.createDataFrame([(1, "zed", [("alpha",)]), (2, "alphabet", []), (3, "x", None)], "id int, name string, tags array<struct<label string>>")
    s = SearchEngine(data, fields=["name"], nested_fields=["tags.label", "plain"], keys=["id"], silent=True)
    assert s.nested == ("tags.label",) and ids(s.search("alph")) == [2, 1]


def test_sequential_filters(users):
    f = FilterEngine(users, keys=["id"], filter_by_previous_result=True)
    city, age = (lambda *v: {"field": "city", "values": list(v)}), (lambda *v: {"field": "age", "values": list(v)})
    first = f.filter([city("Kyiv")])
    assert f.filter([city("Kyiv")]) is first
    for k in range(14):
        f.filter([city("Kyiv"), age(k)])
    assert len(f._history) == 12
    assert ids(f.filter([])) == [1, 2, 3, 4, 5] and not f._history
    f.filter([city("Kyiv")])
    f.add([{"id": 9, "name": "N", "city": "Kyiv", "age": 1}])
    assert ids(f.filter([city("Kyiv"), age(1)])) == [9]


def test_repeated_criteria_give_the_same_result(users):
    f = FilterEngine(users, keys=["id"])
    age = lambda *v: [{"field": "age", "values": list(v)}]
    first = f.filter(age(30, 25))
    assert f.filter(age(25, 30)) is first and f.filter(users, age(25, 30)) is not first
    for k in range(31):
        f.filter(age(100 + k))
    assert f.filter(age(25, 30)) is first and len(f._results) == 32
    f.filter(age(999))
    assert f.filter(age(100)) is not first and len(f._results) == 32
    f.add([{"id": 9, "name": "N", "city": "X", "age": 30}])
    assert ids(f.filter(age(25, 30))) == [1, 2, 3, 9]
    assert not f.clear_indexes()._results


def test_empty_descriptors_and_adhoc_data(users, spark):
    s = SortEngine(users, keys=["id"])
    assert ids(s.sort([])) == [1, 2, 3, 4, 5]
    other = spark.createDataFrame(USERS[::-1], SCHEMA).coalesce(1)
    assert ids(s.sort(other, [{"field": "city"}])) == [3, 1, 5, 2, 4]
    assert ids(FilterEngine().filter(other, [{"field": "city", "values": ["Lviv"]}])) == [5, 2]


def test_facade_options_and_caches(users):
    f = Facade(users, keys=["id"], SearchEngine={"fields": ["name"], "silent": True}, sort={"fields": ["age"]})
    assert f.engines["search"].fields == ("name",) and f.engines["sort"].fields == ("age",)
    assert f.search("v") is f.search("v") and f.sort([{"field": "age"}]) is f.sort([{"field": "age"}])
    held = f.search("v")
    f.add([])
    assert f.search("v") is held
    f.update("id", {"id": 1, "name": "Anna", "city": "Kyiv", "age": 25})
    assert f.search("v") is not held and 1 not in ids(f.search("v"))
    assert f.clear_indexes("sort") is f and f.clear_data("sort") is f and f.origin().count() == 0


def test_random_operations_against_a_list(spark):
    rng = random.Random(41)
    for _ in range(3):
        rows = [{"id": k, "name": rng.choice(["Ann", "bob", "Bo", None]), "age": rng.choice([1, 2, 3, None])} for k in range(8)]
        data = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, name string, age int").coalesce(1)
        f, fresh = Facade(data, search={"fields": ["name"], "silent": True}), 100
        for _ in range(6):
            do = rng.choice(["add", "update", "delete", "delete"])
            if do == "add":
                new = [{"id": fresh + k, "name": rng.choice(["Bob", "ann"]), "age": rng.choice([1, 2, None])} for k in range(rng.randint(1, 2))]
                fresh += 2
                f.add(new)
                rows += new
            elif do == "update":
                new = {"id": rng.choice([r["id"] for r in rows] + [-1]), "name": "Zed", "age": 2}
                f.update("id", new)
                rows = [new if r["id"] == new["id"] else r for r in rows]
            else:
                wanted = [rng.choice([r["id"] for r in rows] + [-1]) for _ in range(rng.randint(1, 3))]
                f.delete("id", wanted)
                for w in wanted:
                    at = next((k for k, r in enumerate(rows) if r["id"] == w), None)
                    if at is not None:
                        rows[at] = rows[-1]
                        rows.pop()
        assert [r.asDict() for r in f.origin().collect()] == rows
        assert ids(f.search("bo")) == [r["id"] for r in rows if "bo" in (r["name"] or "").lower()]
        assert ids(f.filter([{"field": "age", "exclude": [2]}])) == [r["id"] for r in rows if r["age"] != 2]
        assert ids(f.sort([{"field": "age"}])) == [r["id"] for r in sorted(rows, key=lambda r: r["age"] or 0)]
